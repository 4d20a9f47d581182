"""Views of statements, structural pairs, partner ranks, additive controls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpairs.functions import statements as S
from farpairs.functions import text as T
from farpairs.operators import pairs as P
from farpairs.operators.products import entries, product
from farpairs.operators.views import cosine_pairs
from farpairs.tables import materialize

KS = [1, 5, 10]


def statement_views(decls: DataFrame) -> DataFrame:
    """(id, full_name, module, name, kind, ordinal, digest, parsed, form, proposition, free, named, near), written once.

    ``id`` tells declarations of one full name apart; the helper reads each signature once.
    """
    full = F.concat_ws(".", "module", "name")
    read = decls.select(F.concat_ws("#", full, "ordinal").alias("id"), full.alias("full_name"), "module", "name", "kind", "ordinal", "raw_sig", T.digest(F.col("raw_sig")).alias("digest"), S.statement_view("raw_sig").alias("v"))
    return materialize(read.select("id", "full_name", "module", "name", "kind", "ordinal", "raw_sig", "digest", "v.*"))


def unit_vectors(counted: DataFrame) -> DataFrame:
    """(doc, term, w): feature counts of length 1."""
    norms = counted.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counted.join(norms, "id").select(F.col("id").alias("doc"), F.col("feature").alias("term"), (F.col("n") / F.col("norm")).alias("w"))


def structural_pairs(views: DataFrame, above: float) -> DataFrame:
    """(left, right, left_module, right_module, cosine, named_cosine, same_form, same_digest, primary).

    Theorems and lemmas of different modules whose name-free cosine is above ``above``, or
    whose forms are equal. Others are not made: they come after all of these in W3's order
    as long as either ``above`` or a cosine beyond it ranks first. ``primary`` is the mean of
    the cosine scaled from 0 to the largest one, and of form equality; scaling from the
    least cosine instead changes no order, since equal forms come first either way.
    """
    rows = views.where(F.col("kind").isin("theorem", "lemma"))
    counted = materialize(S.features(rows.select("id", "digest", F.col("free").alias("labels"), "near"), "labels"))
    near = cosine_pairs(materialize(unit_vectors(counted)), rows.select(F.col("id").alias("doc"), "module"), above).select("left", "right")
    alike = P.class_pairs(rows.select("form", F.col("id").alias("full_name"), "module")).select("left", "right")
    met = materialize(near.union(alike).distinct())
    free = S.cosines(met, counted)
    ends = met.select(F.explode(F.array("left", "right")).alias("id")).distinct()
    kept = rows.join(ends, "id", "left_semi")
    named = S.features(kept.select("id", "digest", F.col("named").alias("labels"), "near"), "labels")
    both = free.join(S.cosines(met, named).withColumnRenamed("cosine", "named_cosine"), ["left", "right"])
    of = lambda side: rows.select(F.col("id").alias(side), F.col("module").alias(f"{side}_module"), F.col("form").alias(f"{side}_form"), F.col("digest").alias(f"{side}_digest"))
    out = both.join(of("left"), "left").join(of("right"), "right")
    same = F.coalesce(F.col("left_form") == F.col("right_form"), F.lit(False))
    found = materialize(out.select("left", "right", "left_module", "right_module", "cosine", "named_cosine", same.alias("same_form"), (F.col("left_digest") == F.col("right_digest")).alias("same_digest")))
    top = found.agg(F.max("cosine").alias("top"))
    scaled = F.when(F.col("top") > 0, F.col("cosine") / F.col("top")).otherwise(0.0)
    return found.crossJoin(F.broadcast(top)).withColumn("primary", (scaled + F.col("same_form").cast("double")) / 2).drop("top")  # one row


def ranking_order() -> list:
    """Primary score and form equality descending, then both names."""
    return [F.desc("primary"), F.desc("same_form"), F.asc("left"), F.asc("right")]


#: Queries, and classes, of a block of ``counts_above``.
BLOCK = 1024


def counts_above(asked: DataFrame, classes: DataFrame, counted: DataFrame) -> DataFrame:
    """(old_digest, new_digest, inside, outside, itself): declarations nearer to a query than its partner, whose cosine is ``own``.

    ``asked`` (old_digest, new_digest, own), ``classes`` (digest, n, form), ``counted`` their
    features. Queries are scored block against block, and a task hands on counts alone: of
    the query's form, of others, and whether the query's own class is among them. So what
    many queries share with many classes is never a row.
    """
    vectors = counted.groupBy(F.col("id").alias("digest")).agg(F.collect_list(F.struct(F.xxhash64("feature").alias("t"), "n")).alias("x"))
    form = F.when(F.col("form").isNull(), 0).otherwise(F.xxhash64("form"))
    packed = materialize(classes.join(vectors, "digest").select("digest", form.alias("form"), F.col("n").cast("double").alias("n"), F.col("x.t").alias("terms"), F.col("x.n").alias("counts")))
    partners = asked.groupBy(F.col("old_digest").alias("digest")).agg(F.collect_list(F.struct("new_digest", "own")).alias("p"))
    queries = materialize(packed.join(partners, "digest").select(packed.columns + [F.col("p.new_digest").alias("partners"), F.col("p.own").alias("owns")]))
    parts = [max(1, -(-df.count() // BLOCK)) for df in (queries, packed)]
    dealt = lambda df, own, other, k: df.withColumn(own, F.pmod(F.xxhash64("digest"), F.lit(parts[k])).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(parts[1 - k] - 1))))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    there = packed.select("*", none("partners", "array<string>"), none("owns", "array<double>"))
    both = dealt(queries, "q", "c", 0).unionByName(dealt(there, "q2", "q", 1).withColumnRenamed("q2", "c"))

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["owns"].notna()
        a, b = rows[asks].reset_index(drop=True), rows[~asks].reset_index(drop=True)
        out: list[tuple] = []
        if len(a) and len(b):
            x, y = entries(a["terms"], a["counts"]), entries(b["terms"], b["counts"])
            length = lambda e, n: np.sqrt(np.bincount(e[0], e[2] ** 2, minlength=n))
            cosine = product(x, y, len(a), len(b)) / np.outer(length(x, len(a)), length(y, len(b)))
            n, form, ids = b["n"].to_numpy(), b["form"].to_numpy(), b["digest"].to_numpy()
            for i in range(len(a)):
                order = np.argsort(cosine[i])
                # equal quotients may differ in their last bits
                at = np.searchsorted(cosine[i][order], np.asarray(a["owns"][i]) + 1e-12, side="right")
                upto = lambda w: np.concatenate([[0.0], np.cumsum(w)])
                own_form, all_ = upto(np.where((form[order] == a["form"][i]) & (form[order] != 0), n[order], 0)), upto(n[order])
                self_ = upto(ids[order] == a["digest"][i])
                for new, k in zip(a["partners"][i], at):
                    if k < len(b):
                        inside = int(own_form[-1] - own_form[k])
                        out.append((a["digest"][i], new, inside, int(all_[-1] - all_[k]) - inside, int(self_[-1] - self_[k])))
        return pd.DataFrame(out, columns=["old_digest", "new_digest", "inside", "outside", "itself"])

    found = both.groupBy("q", "c").applyInPandas(scored, "old_digest string, new_digest string, inside long, outside long, itself long")
    return found.groupBy("old_digest", "new_digest").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "itself")])


def partner_ranks(views: DataFrame, frozen: DataFrame) -> DataFrame:
    """(old, new, since, status, rank) of each frozen pair.

    Missing: a name that no declaration has; unparsed: one of the two; else the rank of the
    new statement among all parsed declarations but the old one. Those with the old one's
    form come first; inside and outside of them the cosine orders. Only strictly better
    ones push a partner down. The frozen pairs' statements are the queries, run against
    the features of all.
    """
    last = P.last_of(views.select("full_name", "id", "parsed", "form", "ordinal"), ["full_name"], "ordinal")
    side = lambda s: last.select(F.col("full_name").alias(s), F.col("id").alias(f"{s}_id"), F.col("parsed").alias(f"{s}_parsed"), F.col("form").alias(f"{s}_form"))
    found = frozen.select("old", "new", "since").join(side("old"), "old", "left").join(side("new"), "new", "left")
    status = F.when(F.col("old_id").isNull() | F.col("new_id").isNull(), "missing").when(F.col("old_parsed") & F.col("new_parsed"), "ranked").otherwise("unparsed")
    found = materialize(found.withColumn("status", status))
    parsed = views.where("parsed")
    digest = lambda c: parsed.select(F.col("id").alias(c), F.col("digest").alias(c.replace("_id", "_digest")))
    asked = materialize(found.where("status = 'ranked'").select("old_id", "new_id", "old_form", "new_form").distinct().join(digest("old_id"), "old_id").join(digest("new_id"), "new_id"))
    # declarations of one digest are one class with a count
    classes = materialize(parsed.groupBy("digest").agg(F.count("*").alias("n"), F.first(F.struct("form", "free", "near")).alias("x")).select("digest", "n", "x.*"))
    counted = materialize(S.features(classes.select(F.col("digest").alias("id"), "digest", F.col("free").alias("labels"), "near"), "labels"))
    own = S.cosines(asked.select(F.col("old_digest").alias("left"), F.col("new_digest").alias("right")).distinct(), counted)
    counts = counts_above(own.select(F.col("left").alias("old_digest"), F.col("right").alias("new_digest"), F.col("cosine").alias("own")), classes, counted)
    sizes = classes.groupBy(F.col("form").alias("old_form")).agg((F.sum("n") - 1).alias("others"))
    ranked = asked.join(sizes, "old_form").join(counts, ["old_digest", "new_digest"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # the query itself is no other, though its class may beat the partner
    rank = 1 + F.when(F.col("new_form") == F.col("old_form"), zero("inside") - zero("itself")).otherwise(F.col("others") + zero("outside"))
    return found.join(ranked.select("old_id", "new_id", rank.alias("rank")), ["old_id", "new_id"], "left").select("old", "new", "since", "status", "rank")


#: Index rows of one profile that meet its queries in one task.
LOOK_ROWS = 2000


def _profiles(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows by key with their profile, profiles by digest): what rows of one key hold, most often one digest."""
    keyed = rows.select(*key, F.coalesce("digest", F.lit("")).alias("digest"), "form")
    told = F.transform(F.array_sort(F.collect_list(F.struct("digest", "form"))), lambda x: F.to_json(x))
    each = materialize(keyed.groupBy(*key).agg(F.array_join(told, "|").alias("profile"), F.collect_list(F.struct("digest", "form")).alias("held")))
    parts = each.groupBy("profile").agg(F.first("held").alias("held")).select("profile", F.explode("held").alias("x")).select("profile", "x.digest", "x.form")
    return each.drop("held"), materialize(parts)


def _matched(own: DataFrame, there: DataFrame) -> DataFrame:
    """(lp, rp, via) of profiles that share a digest, or a form."""
    by = lambda c, via: own.where(F.col(c).isNotNull()).select(F.col("profile").alias("lp"), c).join(there.select(F.col("profile").alias("rp"), c), c).select("lp", "rp", F.lit(via).alias("via"))
    return by("digest", "exact_digest").union(by("form", "normal_form")).groupBy("lp", "rp").agg(F.min("via").alias("via"))


def lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, corpus, module, name, via, cosine): equal digests first, then equal forms; the cosine is no gate.

    Both sides are views (digest, form, free, near), ``queries`` with ``query``, ``index``
    with ``corpus``. Profiles are matched and scored, which are few; only then do queries
    meet the index, a part of a profile's rows in a task, and no row is dealt after that.
    """
    key = ["corpus", "module", "name"]
    own, mine = _profiles(queries, ["query"])
    there, held = _profiles(index, key)
    met = materialize(_matched(mine, held))
    # a query is scored by each row it has, a place of the index by one
    right = held.groupBy(F.col("profile").alias("rp")).agg(F.min("digest").alias("right"))
    some = materialize(met.join(mine.select(F.col("profile").alias("lp"), F.col("digest").alias("left")), "lp").join(right, "rp"))
    asked = some.select("left", "right").distinct()
    used = asked.select(F.explode(F.array("left", "right")).alias("digest")).distinct()
    known = lambda df: df.select(F.coalesce("digest", F.lit("")).alias("digest"), "free", "near")
    classes = known(queries).union(known(index)).join(used, "digest", "left_semi").groupBy("digest").agg(F.first(F.struct("free", "near")).alias("x")).select("digest", "x.*")
    counted = S.features(classes.select(F.col("digest").alias("id"), "digest", F.col("free").alias("labels"), "near"), "labels")
    scored = materialize(S.cosines(some, materialize(counted)).select("lp", "rp", "via", "cosine"))
    sizes = there.groupBy(F.col("profile").alias("rp")).agg(F.ceil(F.count("*") / LOOK_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(*key), F.col("parts")).cast("int").alias("part")
    rows = there.withColumnRenamed("profile", "rp").join(sizes, "rp").select(*key, "rp", part)
    asks = own.withColumnRenamed("profile", "lp").join(scored, "lp").join(sizes, "rp").select("query", "rp", "via", "cosine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return asks.join(rows, ["rp", "part"]).select("query", *key, "via", "cosine")


def looked_up(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query) with a match of another name in any corpus; matches are not made.

    A key's least and largest name tell whether it has one that is not the query's own.
    """
    out = None
    for c in ("digest", "form"):
        key = (lambda df: df.withColumn("key", F.coalesce("digest", F.lit("")))) if c == "digest" else (lambda df: df.where("form is not null").withColumn("key", F.col("form")))
        names = key(index).groupBy("key").agg(F.min("name").alias("least"), F.max("name").alias("largest"))
        some = key(queries).select("query", "key").join(names, "key").where("least <> query or largest <> query").select("query")
        out = some if out is None else out.union(some)
    return out.distinct()


def look_fractions(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(corpus, fraction) of queries with a match of another name there, by profiles; null without queries."""
    own, mine = _profiles(queries, ["query"])
    n = own.count()
    # queries of one profile match alike, but for those that a corpus has under their own name alone
    rows = index.select("corpus", "name", F.coalesce("digest", F.lit("")).alias("digest"), "form")
    by = lambda c: mine.where(F.col(c).isNotNull()).select("profile", c).distinct().join(rows.where(F.col(c).isNotNull()).groupBy(c, "corpus").agg(F.min("name").alias("least"), F.max("name").alias("largest")), c).select("profile", "corpus", "least", "largest")
    met = by("digest").union(by("form")).groupBy("profile", "corpus").agg(F.min("least").alias("least"), F.max("largest").alias("largest"))
    sizes = own.groupBy("profile").agg(F.count("*").alias("n"))
    alone = F.when(F.col("least") == F.col("largest"), F.col("least"))
    self_ = own.select("profile", F.col("query").alias("alone"), F.lit(1).alias("itself"))
    counts = met.withColumn("alone", alone).join(sizes, "profile").join(self_, ["profile", "alone"], "left")
    share = counts.groupBy("corpus").agg(F.sum(F.col("n") - F.coalesce("itself", F.lit(0))).alias("met"))
    value = F.when(F.lit(n) > 0, F.coalesce("met", F.lit(0)) / F.lit(float(max(n, 1))))
    return index.select("corpus").distinct().join(share, "corpus", "left").select("corpus", value.alias("fraction"))


def class_ranks(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``asked`` (query, digest, form, free, near, partner) with the rank of ``partner`` in its form's class.

    ``index`` is a table of views (id, digest, form, free, near). An equal digest ranks 1;
    another form is no rank; a sole member ranks 1; else one more than those of the class
    that are strictly nearer.
    """
    known = index.select(F.col("id").alias("partner"), F.col("digest").alias("p_digest"), F.col("form").alias("p_form"))
    met = materialize(asked.join(known, "partner").withColumn("inside", F.coalesce(F.col("form") == F.col("p_form"), F.lit(False)) & (F.col("digest") != F.col("p_digest"))))
    inside = met.where("inside")
    # members of one digest have one vector: they are one row with a count
    members = index.join(inside.select("form").distinct(), "form", "left_semi").withColumn("digest", F.coalesce("digest", F.lit("")))
    vectors = members.groupBy("form", "digest").agg(F.count("*").alias("n"), F.first(F.struct("free", "near")).alias("x"))
    asked_ = inside.select("form", F.concat(F.lit("q"), "digest").alias("left"), "free", "near", "query", "partner", "p_digest")
    labelled = vectors.select(F.concat(F.lit("m"), "digest").alias("id"), "digest", "x.free", "x.near").union(asked_.select(F.col("left").alias("id"), F.col("left").alias("digest"), "free", "near")).dropDuplicates(["id"])
    counted = materialize(S.features(labelled, "free"))
    pairs = asked_.select("form", "left").distinct().join(vectors.select("form", F.concat(F.lit("m"), "digest").alias("right"), "n"), "form")
    scored = materialize(S.cosines(pairs, counted).select("form", "left", "right", "n", F.round("cosine", 12).alias("cosine")))
    each = asked_.select("form", "left", "query", "partner", F.concat(F.lit("m"), "p_digest").alias("mine"))
    own = each.join(scored, ["form", "left"]).where("right = mine").select("query", "partner", "form", "left", F.col("cosine").alias("own"))
    ranks = own.join(scored, ["form", "left"]).groupBy("query", "partner").agg((1 + F.coalesce(F.sum(F.when(F.col("cosine") > F.col("own"), F.col("n"))), F.lit(0))).alias("rank"))
    out = met.join(ranks, ["query", "partner"], "left")
    return out.select("query", "partner", F.when(F.col("digest") == F.col("p_digest"), F.lit(1)).otherwise(F.col("rank")).alias("rank"))


def found_by_name(names: DataFrame, decls: DataFrame) -> DataFrame:
    """(name, module, id): declarations named by the last part of ``name``, seen from ``module``.

    A dotted name prefers those whose full name ends with it. One such is taken, else the
    only one of the same module, else none (null).
    """
    index = decls.select(F.col("name").alias("short"), F.col("module").alias("of"), "id", F.concat_ws(".", "module", "name").alias("full"))
    asked = names.select("name", "module").distinct().withColumn("short", F.substring_index("name", ".", -1))
    fits = F.col("name").contains(".") & (F.endswith("full", "name") | (F.col("short") == F.col("name")))
    hits = asked.join(index, "short").select("name", "module", "id", fits.alias("fits"), (F.col("of") == F.col("module")).alias("near"))
    # one row for each name and module; ids are kept for counts of one only
    one = lambda where: F.struct(F.count_if(where).alias("n"), F.min(F.when(where, F.col("id"))).alias("id"))
    fit, near = F.col("fits"), F.col("near")
    summed = hits.groupBy("name", "module").agg(one(fit).alias("f"), one(F.lit(True)).alias("a"), one(fit & near).alias("fn"), one(near).alias("an"))
    pick = lambda all_, own: F.when(F.col(f"{all_}.n") == 1, F.col(f"{all_}.id")).when(F.col(f"{own}.n") == 1, F.col(f"{own}.id"))
    chosen = F.when(F.col("f.n") > 0, pick("f", "fn")).otherwise(pick("a", "an"))
    return asked.select("name", "module").join(summed.select("name", "module", chosen.alias("id")), ["name", "module"], "left")


def additive_partners(attributes: DataFrame, decls: DataFrame) -> DataFrame:
    """``attributes`` with ``source`` and ``partner`` (ids, or null).

    The partner's name is the explicit one, else the source's last part by the segment map;
    a partner that is the source itself is none.
    """
    guessed = T.additive_name(F.substring_index("name", ".", -1))
    rows = attributes.withColumn("wanted", F.coalesce("explicit", guessed))
    by = lambda c, into: found_by_name(rows.select(F.col(c).alias("name"), "module"), decls).select(F.col("name").alias(c), "module", F.col("id").alias(into))
    both = rows.join(by("wanted", "partner"), ["wanted", "module"], "left").join(by("name", "source"), ["name", "module"], "left")
    named = decls.select(F.col("id").alias("partner"), F.col("name").alias("p_name"), F.col("module").alias("p_module"))
    itself = F.coalesce((F.col("p_name") == F.substring_index("name", ".", -1)) & (F.col("p_module") == F.col("module")), F.lit(False))
    return both.join(named, "partner", "left").withColumn("partner", F.when(~itself, F.col("partner"))).drop("wanted", "p_name", "p_module")


def additive_ranks(attributes: DataFrame, views: DataFrame) -> DataFrame:
    """(module, name, kind, is_private, resolved, rank): W7 of each additive partner for the source's moved statement."""
    rows = additive_partners(attributes.where("kind <> 'instance' and not is_private"), views)
    moved = T.additive_signature(F.col("raw_sig"))
    sources = views.select(F.col("id").alias("source"), "raw_sig")
    asked = rows.join(sources, "source", "left").withColumn("moved", F.when(F.col("partner").isNotNull(), moved))
    asked = materialize(asked.withColumn("query", F.concat_ws("|", "module", "name", "partner")))
    read = asked.where("moved is not null").select("query", "partner", "moved").dropDuplicates(["query"]).select("query", "partner", T.digest(F.col("moved")).alias("digest"), S.statement_view("moved").alias("v"))
    ranks = class_ranks(read.select("query", "partner", "digest", "v.form", "v.free", "v.near"), views)
    return asked.join(ranks.select("query", "rank"), "query", "left").select("module", "name", "kind", "is_private", F.col("moved").isNotNull().alias("resolved"), "rank")


def additive_controls(attributes: DataFrame, ranks: DataFrame, ks: list[int] = KS) -> DataFrame:
    """One row of counts; recall over the denominator and among ranked ones is null when there are none."""
    all_ = attributes.agg(F.count("*").alias("attributes"), F.count_if(F.col("kind") == "instance").alias("instances_excluded"), F.count_if(F.col("is_private") & (F.col("kind") != "instance")).alias("private_excluded"))
    counts = ranks.agg(F.count("*").alias("denominator"), F.count_if("resolved").alias("resolved"), F.count("rank").alias("ranked"), *[F.count_if(F.col("rank") <= k).alias(f"recovered_{k}") for k in ks])
    share = lambda k, n: F.when(F.col(n) > 0, F.col(f"recovered_{k}") / F.col(n))
    one = all_.crossJoin(F.broadcast(counts)).withColumn("status", F.when(F.col("attributes") > 0, "measured").otherwise("absent"))  # one row each
    return one.select("status", "attributes", "instances_excluded", "private_excluded", "denominator", "resolved", "ranked", *[f"recovered_{k}" for k in ks], *[share(k, "denominator").alias(f"recall_{k}") for k in ks], *[share(k, "ranked").alias(f"ranked_recall_{k}") for k in ks])
