"""Rankings of all pairs by classes with counts.

Statements of one digest have one form and one feature vector, so they are one class. All
scores are of class pairs, made block against block; a class pair stands for as many
pairs as its members have in different modules, and members are named only for the rows
that a ranking shows. Scores order by the square of the cosine, a quotient of integers,
so equal scores are equal to the bit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpairs.functions import statements as S
from farpairs.operators import evaluate, graph
from farpairs.operators.pairs import top_per_bucket
from farpairs.operators.products import entries, product
from farpairs.operators.views import cosine_pairs
from farpairs.tables import materialize

#: Classes of a block; bins of a score in a survey.
BLOCK, BINS = 1024, 50
#: Class pairs that a ranking looks at first; each further look takes so many times more.
FIRST, MORE = 256, 16


THEOREMS = ("theorem", "lemma")


def statement_classes(views: DataFrame, k: int, kinds: tuple[str, ...] | None = THEOREMS) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of the declarations of these kinds (None: of all).

    Classes: (class, form, vector): hashed feature labels with repeats (F20, F22). Members:
    (class, module, n, first): how many, and the first ``k`` ids in order.
    """
    rows = (views if kinds is None else views.where(F.col("kind").isin(*kinds))).withColumn("class", F.coalesce("digest", F.lit("")))
    one = rows.groupBy("class").agg(F.first(F.struct("form", "digest", "free", "near")).alias("x")).select("class", "x.*")
    labels = F.coalesce(S.kernel_labels(F.col("free"), F.col("near")), F.array(F.concat(F.lit("unparsed:"), F.col("digest"))))
    vector = F.transform(F.filter(labels, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))
    classes = materialize(one.select("class", "form", vector.alias("vector")))
    return classes, materialize(members_of(rows, k))


def members_of(rows: DataFrame, k: int) -> DataFrame:
    """(class, module, n, last, first) of rows (class, module, id): the largest id, and the first ``k`` ids are those that a list of k pairs can show."""
    place = F.row_number().over(Window.partitionBy("class", "module").orderBy("id"))
    first = rows.select("class", "module", "id", place.alias("p")).where(F.col("p") <= k).groupBy("class", "module").agg(F.array_sort(F.collect_list("id")).alias("first"))
    return rows.groupBy("class", "module").agg(F.count("*").alias("n"), F.max("id").alias("last")).join(first, ["class", "module"])


class _Side:
    """One block of classes: count matrices by columns, forms, numbers of members."""

    def __init__(self, rows: pd.DataFrame):
        self.names = rows["class"].tolist()
        self.form = rows["form"].to_numpy(np.int64)  # 0: none
        self.vector = entries(rows["vector"])
        self.modules = entries(rows["modules"], rows["counts"])
        self.later = entries(rows["modules"], rows["laters"])
        own, n = self.vector[1], self.vector[2]
        self.norm = np.bincount(self.vector[0], n.astype(np.float64) ** 2, minlength=len(rows)) if len(own) else np.zeros(len(rows))


def _scored(rows: pd.DataFrame) -> tuple[_Side, _Side, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(side, side, squared cosines, equal forms, pairs, pairs among later members) of a pair of blocks."""
    low = rows["block"].min()
    a = _Side(rows[rows["block"] == low])
    diagonal = (rows["block"] == low).all() and rows["low"].iloc[0] == rows["high"].iloc[0]
    if not diagonal and (rows["block"] == low).all():
        return a, a, *[np.zeros((0, 0))] * 4  # the other block has no class
    b = a if diagonal else _Side(rows[rows["block"] != low])
    na, nb = len(a.names), len(b.names)
    dot = product(a.vector, b.vector, na, nb)
    scale = np.outer(a.norm, b.norm)
    square = np.divide(dot * dot, scale, out=np.zeros_like(dot), where=scale > 0)
    same = (a.form[:, None] == b.form[None, :]) & (a.form[:, None] != 0)

    def pairs(x: tuple, y: tuple) -> np.ndarray:
        size = lambda e, n: np.bincount(e[0], e[2], minlength=n) if len(e[0]) else np.zeros(n)
        sx, sy = size(x, na), size(y, nb)
        n = np.outer(sx, sy) - product(x, y, na, nb)
        if diagonal:
            own = np.bincount(x[0], x[2] ** 2, minlength=na) if len(x[0]) else np.zeros(na)
            n = np.triu(n, 1) + np.diag((sx**2 - own) / 2)
        return n

    return a, b, square, same, pairs(a.modules, b.modules), pairs(a.later, b.later)


def _blocked(classes: DataFrame, members: DataFrame, later: str | None = None) -> DataFrame:
    """Every class once for each pair of blocks that its own is in; ``later`` counts members from that id on."""
    shape = members.groupBy("class").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("module").alias("m"), "n", "later"))).alias("x"))
    n = classes.count()
    blocks = max(1, -(-n // BLOCK))
    rows = classes.join(shape, "class").select("class", F.when(F.col("form").isNull(), 0).otherwise(F.xxhash64("form")).alias("form"), "vector", F.col("x.m").alias("modules"), F.col("x.n").alias("counts"), F.col("x.later").alias("laters"), F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each = rows.withColumn("other", other)
    return each.select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).drop("other")


def _by_blocks(blocked: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return blocked.groupBy("low", "high").applyInPandas(f, schema)


def _survey(rows: pd.DataFrame) -> pd.DataFrame:
    """(same, bin, classes, pairs, least, largest) of the class pairs of two blocks that stand for any pair."""
    *_, square, same, n, _ = _scored(rows)
    out = []
    for form in (False, True):
        held = (n > 0) & (same == form) if n.size else np.zeros(n.shape, bool)
        if held.any():
            own, count = square[held], n[held]
            bins = np.minimum(BINS - 1, (own * BINS).astype(np.int64))
            for k in np.unique(bins):
                out.append((form, int(k), int((bins == k).sum()), int(count[bins == k].sum()), float(own[bins == k].min()), float(own[bins == k].max())))
    return pd.DataFrame(out, columns=["same", "bin", "classes", "pairs", "least", "largest"])


def _above(bounds: dict[bool, int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Class pairs whose bin is at least the bound for equal, or other, forms."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, square, same, n, _ = _scored(rows)
        if not n.size:
            return pd.DataFrame([], columns=["ca", "cb", "same", "square"])
        bins = np.minimum(BINS - 1, (square * BINS).astype(np.int64))
        i, j = np.nonzero((n > 0) & (bins >= np.where(same, bounds[True], bounds[False])))
        return pd.DataFrame({"ca": [a.names[k] for k in i], "cb": [b.names[k] for k in j], "same": same[i, j], "square": square[i, j]})

    return f


def survey(classes: DataFrame, members: DataFrame) -> tuple[DataFrame, list]:
    """(blocked classes, rows (same, bin, classes, pairs, least, largest)); at most two rows for each bin."""
    blocked = materialize(_blocked(classes, members.withColumn("later", F.lit(0))))
    found = _by_blocks(blocked, _survey, "same boolean, bin int, classes long, pairs long, least double, largest double")
    rows = found.groupBy("same", "bin").agg(F.sum("classes").alias("classes"), F.sum("pairs").alias("pairs"), F.min("least").alias("least"), F.max("largest").alias("largest")).collect()
    return blocked, sorted(rows, key=lambda r: (not r["same"], -r["bin"]))


def cells(met: DataFrame, members: DataFrame) -> DataFrame:
    """Class pairs by pairs of different modules, with the number of their pairs and the first one's names.

    A class of many modules is cut into blocks by module, so that no class pair is one task.
    """
    sizes = members.groupBy("class").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / 500).cast("int")
    dealt = members.join(sizes, "class").select("class", "module", "n", "first", blocks.alias("of"), F.pmod(F.xxhash64("module"), blocks).cast("int").alias("at"))
    of = sizes.select("class", blocks.alias("of"))
    wide = met.join(of.toDF("ca", "oa"), "ca").join(of.toDF("cb", "ob"), "cb")
    wide = wide.withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("oa") - 1))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("ob") - 1)))
    side = lambda s: dealt.select(F.col("class").alias(f"c{s}"), F.col("at").alias(f"b{s}"), F.col("module").alias(f"m{s}"), F.col("n").alias(f"n{s}"), F.col("first").alias(f"f{s}"))
    both = wide.join(side("a"), ["ca", "ba"]).join(side("b"), ["cb", "bb"]).where("ma <> mb and (ca <> cb or ma < mb)")
    la, lb = F.col("fa")[0], F.col("fb")[0]
    return both.select("ca", "cb", "same", "square", F.col("ma").alias("left_module"), F.col("mb").alias("right_module"), (F.col("na") * F.col("nb")).alias("n"), F.least(la, lb).alias("left"), F.greatest(la, lb).alias("right"))


def by_module(members: DataFrame) -> DataFrame:
    """(module, classes, counts, firsts): what ``by_blocks`` needs of members."""
    one = members.groupBy("module").agg(F.collect_list(F.struct("class", "n", F.col("first")[0].alias("f"))).alias("x"))
    return one.select("module", F.col("x.class").alias("classes"), F.col("x.n").alias("counts"), F.col("x.f").alias("firsts"))


def _reach(left: pd.DataFrame, right: pd.DataFrame, hops: np.ndarray, _: pd.DataFrame) -> pd.DataFrame:
    """(bucket, left_module, n): pairs of one class between two blocks, by the module of the lesser name; near: any path."""
    codes, _names = pd.factorize(np.concatenate([np.concatenate([np.asarray(x, object) for x in s["classes"]]) for s in (left, right) if len(s)])) if len(left) and len(right) else (np.zeros(0, int), [])
    if not len(codes):
        return pd.DataFrame([], columns=["bucket", "left_module", "n"])
    at, sides = 0, []
    for s in (left, right):
        sizes = np.cumsum([0, *map(len, s["classes"])]) + at
        sides.append(entries([codes[i:j] for i, j in zip(sizes, sizes[1:])], s["counts"]))
        at = sizes[-1]
    n = product(*sides, len(left), len(right))
    if left is right:
        n = np.triu(n, 1)
    ranks = pd.factorize(np.concatenate([left["module"].to_numpy(), right["module"].to_numpy()]), sort=True)[0]
    less = ranks[: len(left), None] < ranks[None, len(left) :]
    out = []
    for bucket, mask in (("ge4", hops >= 4), ("ge8", hops >= 8), ("near", hops > 0)):
        own = np.where(mask, n, 0)
        for names, sums in ((left["module"], np.where(less, own, 0).sum(1)), (right["module"], np.where(less, 0, own).sum(0))):
            out.append(pd.DataFrame({"bucket": bucket, "left_module": names, "n": sums.astype(np.int64)})[sums > 0])
    return pd.concat(out)


def class_buckets(members: DataFrame, index: DataFrame, levels: DataFrame) -> DataFrame:
    """(bucket, left_module, n): pairs of one class in different modules by bucket and the module of the lesser name.

    Pairs with a path are counted block against block; those without are all but them.
    """
    near = graph.by_blocks(index, levels, by_module(members), _reach, "bucket string, left_module string, n long").groupBy("bucket", "left_module").agg(F.sum("n").alias("n"))
    behind = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("module").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    every = members.select("module", (F.col("n") * behind).alias("n")).groupBy(F.col("module").alias("left_module")).agg(F.sum("n").alias("n"))
    near = materialize(near)
    rest = every.join(near.where("bucket = 'near'").select("left_module", F.col("n").alias("met")), "left_module", "left").select(F.lit("no_path").alias("bucket"), "left_module", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n"))
    return materialize(near.where("bucket <> 'near'").unionByName(rest).where("n > 0"))


def bucket_totals(members: DataFrame, index: DataFrame, levels: DataFrame) -> dict[str, int]:
    """Pairs of members in each bucket, all taken as one class."""
    held = members.groupBy("module").agg(F.sum("n").alias("n")).select(F.lit("").alias("class"), "module", "n", F.array(F.lit("")).alias("first"))
    found = class_buckets(materialize(held), index, levels).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {b: 0 for b in graph.BUCKETS} | {r["bucket"]: r["n"] for r in found}


CELL = "bucket string, ca string, cb string, same boolean, square double, left_module string, right_module string, hops int, n long, left string, right string"


def _first_cells(k: int, by_hops: bool) -> Callable:
    """The first ``k`` cells of a pair of blocks in each bucket of hops, by scores or by hops, then by their first names."""

    def f(left: pd.DataFrame, right: pd.DataFrame, hops: np.ndarray, met: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame([], columns=[x.split()[0] for x in CELL.split(", ")])
        if not (len(left) and len(right) and len(met)):
            return none
        firsts = [np.concatenate([np.asarray(x, object) for x in s["firsts"]]) for s in (left, right)]
        ranks, names = pd.factorize(np.concatenate(firsts), sort=True)
        sides, at = [], 0
        for s in (left, right):
            classes = np.concatenate([np.asarray(x, object) for x in s["classes"]])
            row = np.repeat(np.arange(len(s)), [len(x) for x in s["classes"]])
            n = np.concatenate([np.asarray(x, np.int64) for x in s["counts"]])
            sides.append({c: (row[i], ranks[at + i], n[i]) for c, i in pd.Series(classes).groupby(classes).indices.items()})
            at += len(classes)
        own, r = [], len(names)
        for p, (ca, cb) in enumerate(zip(met["ca"], met["cb"])):
            for turned, (x, y) in enumerate([(ca, cb)] if ca == cb or left is right else [(ca, cb), (cb, ca)]):
                if x not in sides[0] or y not in sides[1]:
                    continue
                (i, ri, ni), (j, rj, nj) = sides[0][x], sides[1][y]
                h = hops[np.ix_(i, j)]
                mask = h >= 4
                if left is right and ca == cb:
                    mask &= i[:, None] < j[None, :]
                u, v = np.nonzero(mask)
                key = np.minimum(ri[u], rj[v]).astype(np.int64) * r + np.maximum(ri[u], rj[v])
                far = -h[u, v].astype(np.int64) if by_hops else np.zeros(len(u), np.int64)
                for bucket, least in (("ge4", 4), ("ge8", 8)):
                    held = np.flatnonzero(h[u, v] >= least)
                    if len(held) > k:
                        bound = np.partition(far[held], k - 1)[k - 1]
                        held = held[far[held] <= bound]
                        # of the last hops only the first names
                        surely, edge = held[far[held] < bound], held[far[held] == bound]
                        held = np.concatenate([surely, edge[np.argsort(key[edge])[:k]]])
                    if len(held):
                        own.append(pd.DataFrame({"bucket": bucket, "pair": p, "turned": bool(turned), "i": i[u[held]], "j": j[v[held]], "hops": h[u[held], v[held]], "n": ni[u[held]] * nj[v[held]], "far": far[held], "key": key[held]}))
        if not own:
            return none
        every = pd.concat(own, ignore_index=True)
        every["same"], every["square"] = met["same"].to_numpy()[every["pair"]], met["square"].to_numpy()[every["pair"]]
        every = every.sort_values(["far", "key"] if by_hops else ["same", "square", "key"], ascending=[True, True] if by_hops else [False, False, True], kind="stable")
        every = every.groupby("bucket", sort=False).head(k)
        ca, cb, turned = met["ca"].to_numpy()[every["pair"]], met["cb"].to_numpy()[every["pair"]], every["turned"].to_numpy()
        ml, mr = left["module"].to_numpy()[every["i"]], right["module"].to_numpy()[every["j"]]
        out = every[["bucket", "same", "square", "hops", "n"]].assign(ca=ca, cb=cb, left_module=np.where(turned, mr, ml), right_module=np.where(turned, ml, mr), left=names[every["key"] // r], right=names[every["key"] % r])
        return out[none.columns]

    return f


def first_cells(met: DataFrame, members: DataFrame, index: DataFrame, levels: DataFrame, k: int, by_hops: bool = False) -> DataFrame:
    """Cells with a path among which the first ``k`` of ge4 and ge8 lie: ``k`` of each pair of blocks; no others are made."""
    used = met.select(F.explode(F.array("ca", "cb")).alias("class")).distinct()
    held = by_module(members.join(used, "class", "left_semi"))
    return materialize(graph.by_blocks(index, levels, held, _first_cells(k, by_hops), CELL, met.select("ca", "cb", "same", "square")))


def first_apart(met: DataFrame, members: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The first ``k`` named pairs without a path, in W3's order; rows as ``named_pairs`` has them, without rank.

    The lesser names of these are among the first ``k`` that have any later partner of
    their score in another component; that is known from the two largest ids of a class's
    partners in different components. Only partners of those names are looked at.
    """
    of = members.join(index.select("module", "component"), "module", "left").withColumn("component", F.coalesce("component", "module"))
    of = materialize(of.select("class", "module", "component", "last", "first"))
    both = materialize(met.select("same", "square", F.col("ca").alias("class"), F.col("cb").alias("with")).union(met.where("ca <> cb").select("same", "square", "cb", "ca")))
    level = ["same", "square", "class"]
    lasts = of.groupBy(F.col("class").alias("with"), "component").agg(F.max("last").alias("last"))
    late = materialize(both.join(lasts, "with").groupBy(*level, "component").agg(F.max("last").alias("last")))
    top = late.groupBy(*level).agg(F.max(F.struct("last", "component")).alias("t"))
    rest = late.join(top, level).where("component <> t.component").groupBy(*level).agg(F.max("last").alias("second"))
    bound = top.join(rest, level).select(*level, F.col("t.last").alias("top"), F.col("t.component").alias("at"), "second")  # one component alone has no such pair, seen from itself
    alone = top.join(rest, level, "left_anti").select(*level, F.col("t.last").alias("top"), F.col("t.component").alias("at"), F.lit(None).cast("string").alias("second"))
    ids = of.select("class", F.col("module").alias("left_module"), F.col("component").alias("own"), F.explode("first").alias("left"))
    known = ids.join(bound.union(alone), "class").where(F.when(F.col("own") != F.col("at"), F.col("left") < F.col("top")).otherwise(F.col("left") < F.col("second")))
    lefts = materialize(known.select(*level, "left_module", "own", "left").orderBy(F.desc("same"), F.desc("square"), "left").limit(k))
    asked = lefts.join(both, level).select("same", "square", "with", (F.col("with") == F.col("class")).alias("same_digest"), "left_module", "own", "left")
    met_ = of.select(F.col("class").alias("with"), F.col("module").alias("right_module"), "component", F.explode("first").alias("right")).join(F.broadcast(asked), "with").where("right > left and component <> own")
    first = met_.orderBy(*score_order()).limit(k)
    return first.select(F.lit("no_path").alias("bucket"), "same", "square", F.lit(None).cast("int").alias("hops"), "left", "right", "left_module", "right_module", "same_digest")


def score_order() -> list:
    """W3 on squares: equal forms first, then the cosine, then both names."""
    return [F.desc("same"), F.desc("square"), F.asc("left"), F.asc("right")]


def _first_of_buckets(classes: DataFrame, members: DataFrame, index: DataFrame, levels: DataFrame, k: int, equal_forms: bool) -> tuple[DataFrame, list]:
    """The first ``k`` pairs of each bucket, named, and the survey; looks at the best class pairs until all buckets are full."""
    blocked, bins = survey(classes, members)
    wanted = [r for r in bins if r["same"] or not equal_forms]
    totals: dict[str, int] | None = None
    want = FIRST
    while True:
        taken, seen = 0, 0
        while taken < len(wanted) and seen < want:
            seen += wanted[taken]["classes"]
            taken += 1
        bounds = {form: min([r["bin"] for r in wanted[:taken] if r["same"] == form], default=BINS) for form in (True, False)}
        met = materialize(_by_blocks(blocked, _above(bounds), "ca string, cb string, same boolean, square double"))
        found = first_cells(met, members, index, levels, k)
        apart = materialize(first_apart(met, members, index, k))
        if taken == len(wanted):
            break
        full = {r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()} | {"no_path": apart.count()}
        short = [b for b in graph.BUCKETS if full.get(b, 0) < k]
        if short:
            totals = totals or bucket_totals(members, index, levels)
            short = [b for b in short if full.get(b, 0) < totals[b]]
        if not short:
            break
        want *= MORE
    return named_pairs(found, members, k, apart=apart), bins


def named_pairs(found: DataFrame, members: DataFrame, k: int, order: list | None = None, apart: DataFrame | None = None) -> DataFrame:
    """The first ``k`` pairs of each bucket of bucketed cells, in ``order`` of columns that a cell's pairs share, then names.

    They lie in the ``k`` cells whose own first pairs come first, among each side's first ``k`` members.
    ``apart``: named pairs that come with them.
    """
    order = order or score_order()
    best = top_per_bucket(found, k, order).drop("rank", "left", "right", "n")
    names = members.select("class", "module", "first")
    pick = lambda s, m: names.select(F.col("class").alias(f"c{s}"), F.col("module").alias(m), F.explode("first").alias(f"i{s}"))
    pairs = best.join(pick("a", "left_module"), ["ca", "left_module"]).join(pick("b", "right_module"), ["cb", "right_module"])
    turned = F.col("ia") > F.col("ib")
    side = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    named = pairs.select("bucket", "same", "square", "hops", F.least("ia", "ib").alias("left"), F.greatest("ia", "ib").alias("right"), side("right_module", "left_module").alias("left_module"), side("left_module", "right_module").alias("right_module"), (F.col("ca") == F.col("cb")).alias("same_digest"))
    named = named if apart is None else named.unionByName(apart)
    return materialize(top_per_bucket(named, k, order))


def structural_ranking(views: DataFrame, index: DataFrame, levels: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` of all pairs of theorems and lemmas in each distance bucket.

    (bucket, rank, left, right, left_module, right_module, hops, cosine, named_cosine,
    same_form, same_digest, primary): no pair is left out of the order, whatever its cosine.
    ``primary`` is the mean of cosine and form equality, each scaled over all pairs of
    different modules; a constant one is 0. ``index`` and ``levels`` are packed distances
    from all modules.
    """
    classes, members = statement_classes(views, k)
    shown, bins = _first_of_buckets(classes, members, index, levels, k, False)
    ends = shown.select(F.explode(F.array("left", "right")).alias("id")).distinct()
    rows = views.join(F.broadcast(ends), "id", "left_semi")  # 2k names a bucket at most
    counted = S.features(rows.select("id", "digest", F.col("named").alias("labels"), "near"), "labels")
    kept = S.cosines(shown.select("left", "right").distinct(), counted).withColumnRenamed("cosine", "named_cosine")
    out = shown.withColumn("cosine", F.sqrt("square")).join(kept, ["left", "right"])
    low, high = (min(r["least"] for r in bins) ** 0.5, max(r["largest"] for r in bins) ** 0.5) if bins else (0.0, 0.0)
    of, equal = sum(r["pairs"] for r in bins), sum(r["pairs"] for r in bins if r["same"])
    scaled = (F.col("cosine") - F.lit(low)) / F.lit(high - low) if high > low else F.lit(0.0)
    form = F.col("same").cast("double") if 0 < equal < of else F.lit(0.0)
    return out.select("bucket", "rank", "left", "right", "left_module", "right_module", "hops", "cosine", "named_cosine", F.col("same").alias("same_form"), "same_digest", ((scaled + form) / 2).alias("primary"))


def form_ranking(views: DataFrame, index: DataFrame, levels: DataFrame, k: int = 100) -> DataFrame:
    """(bucket, rank, left, right, cosine, hops): the first ``k`` pairs of one normal form in each bucket.

    All kinds, different modules, unparsed ones excluded; cosine descending, then names.
    No class makes all its pairs: classes are scored, and ``k`` members of each side named.
    """
    shared = views.where("form is not null").groupBy("form").agg(F.count_distinct("module").alias("m")).where("m > 1")
    rows = views.join(shared, "form", "left_semi")
    classes, members = statement_classes(rows, k, None)
    shown, _ = _first_of_buckets(classes, members, index, levels, k, True)
    return shown.select("bucket", "rank", "left", "right", F.sqrt("square").alias("cosine"), "hops")


def form_members(views: DataFrame, k: int = 1) -> DataFrame:
    """Members by normal form (class = form), of forms in more than one module."""
    rows = views.where("form is not null").select(F.col("form").alias("class"), "module", "id")
    members = materialize(members_of(rows, k))
    return members.join(members.groupBy("class").agg(F.count("*").alias("m")).where("m > 1"), "class", "left_semi")


def farthest_pairs(views: DataFrame, index: DataFrame, levels: DataFrame, k: int) -> DataFrame:
    """The first ``k`` pairs of one form in each bucket: most hops, then names; cells are not listed."""
    members = form_members(views, k)
    met = members.select(F.col("class").alias("ca"), F.col("class").alias("cb")).distinct().withColumns({"same": F.lit(True), "square": F.lit(1.0)})
    found = first_cells(met, members, index, levels, k, by_hops=True)
    return named_pairs(found, members, k, [F.desc("hops"), F.asc("left"), F.asc("right")], first_apart(met, members, index, k))


def form_cells(views: DataFrame, index: DataFrame, levels: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """J7, J6, G4 by form and pair of modules, in buckets, with the number of pairs; and the members (class = form)."""
    rows = views.where("form is not null").select(F.col("form").alias("class"), "module", "id")
    members = materialize(members_of(rows, k))
    met = members.groupBy("class").agg(F.count("*").alias("m")).where("m > 1")
    one = met.select(F.col("class").alias("ca"), F.col("class").alias("cb"), F.lit(True).alias("same"), F.lit(1.0).alias("square"))
    return materialize(graph.bucketed(graph.hops_between(cells(one, members), index, levels))), members


def random_form_pairs(views: DataFrame, found: DataFrame, k: int, seed: str) -> DataFrame:
    """R1 without making pairs: (bucket, rank, left, right): a seeded draw of ``k`` of each bucket's pairs of one form.

    ``found`` are the cells of ``form_cells``. The pairs of a bucket are numbered by cells
    in order of modules and of a cell's first names, and by members inside. Up to 1000 pairs are permuted by
    md5(seed|bucket|number); of more, numbers md5(seed|bucket|draw) modulo their count are
    drawn, each counted once. Prefixes nest, and no calendar window enters.
    """
    return _drawn(views, found.groupBy("bucket", "left_module").agg(F.sum("n").alias("n")), lambda left: found.join(F.broadcast(left), ["bucket", "left_module"], "left_semi"), k, seed)


def random_pairs(views: DataFrame, index: DataFrame, levels: DataFrame, k: int, seed: str) -> DataFrame:
    """The draw of ``random_form_pairs``, with cells made for the modules alone in which a drawn pair lies."""
    members = materialize(form_members(views))

    def cells_of(left: DataFrame) -> DataFrame:
        some = F.broadcast(left.select("left_module").distinct())  # k for a bucket
        own = materialize(members.select(F.col("class").alias("ca"), F.col("module").alias("left_module"), F.col("n").alias("na"), F.col("first")[0].alias("la")).join(some, "left_module"))
        there = members.select(F.col("class").alias("ca"), F.col("module").alias("right_module"), F.col("n").alias("nb"), F.col("first")[0].alias("lb"))
        each = there.join(F.broadcast(own), "ca").where("left_module < right_module")
        words = index.select(F.col("module").alias("left_module"), "word", "bit").join(some, "left_module")
        hops = levels.join(F.broadcast(words), "word").where("shiftrightunsigned(bits, bit) & 1 = 1").select("left_module", F.col("module").alias("right_module"), "hops")
        met = graph.bucketed(each.join(hops, ["left_module", "right_module"], "left"))
        cells_ = met.join(F.broadcast(left), ["bucket", "left_module"], "left_semi")
        return cells_.select("bucket", "left_module", "right_module", "ca", (F.col("na") * F.col("nb")).alias("n"), F.least("la", "lb").alias("left"), F.greatest("la", "lb").alias("right"))

    return _drawn(views, class_buckets(members, index, levels), cells_of, k, seed)


def _drawn(views: DataFrame, by_left: DataFrame, cells_of: Callable[[DataFrame], DataFrame], k: int, seed: str) -> DataFrame:
    """``by_left``: pairs by bucket and left module; ``cells_of`` gives the cells of some of these."""
    number = lambda x: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "bucket", x.cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    # prefix sums: over left modules, then inside each
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("left_module").rowsBetween(Window.unboundedPreceding, -1))
    outer = materialize(by_left.select("bucket", "left_module", F.coalesce(upto, F.lit(0)).alias("before"), "n"))
    totals = outer.groupBy("bucket").agg(F.sum("n").alias("total"))
    few = F.col("total") <= 1000
    tries = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(few, F.col("total") - 1).otherwise(F.lit(10 * k)).cast("long"))))
    drawn = tries.select("bucket", F.when(few, F.col("i")).otherwise(number(F.col("i")) % F.col("total")).alias("at"), F.when(few, number(F.col("i"))).otherwise(F.col("i")).alias("o"))
    once = drawn.groupBy("bucket", "at").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("o", "at"))
    taken = once.select("bucket", "at", place.alias("rank")).where(F.col("rank") <= k)  # k rows a bucket
    left = materialize(outer.join(F.broadcast(taken), "bucket").where("at >= before and at < before + n").select("bucket", "rank", "left_module", (F.col("at") - F.col("before")).alias("at")))
    inner = F.sum("n").over(Window.partitionBy("bucket", "left_module").orderBy("right_module", "left", "right").rowsBetween(Window.unboundedPreceding, -1))
    near = cells_of(left.select("bucket", "left_module").distinct()).select("bucket", "left_module", "right_module", "ca", "n", F.coalesce(inner, F.lit(0)).alias("before"))
    cell = materialize(near.join(F.broadcast(left), ["bucket", "left_module"]).where("at >= before and at < before + n").select("bucket", "rank", "ca", "left_module", "right_module", (F.col("at") - F.col("before")).alias("at")))
    used = cell.select(F.col("ca").alias("form"), F.explode(F.array("left_module", "right_module")).alias("module")).distinct()
    numbered = views.join(F.broadcast(used), ["form", "module"], "left_semi").select("form", "module", "id", (F.row_number().over(Window.partitionBy("form", "module").orderBy("id")) - 1).alias("p"), F.count("*").over(Window.partitionBy("form", "module")).alias("m"))
    a = numbered.select(F.col("form").alias("ca"), F.col("module").alias("left_module"), F.col("id").alias("ia"), F.col("p").alias("pa"))
    b = numbered.select(F.col("form").alias("ca"), F.col("module").alias("right_module"), F.col("id").alias("ib"), F.col("p").alias("pb"), F.col("m").alias("mb"))
    both = cell.join(a, ["ca", "left_module"]).join(b, ["ca", "right_module"]).where("pa = at div mb and pb = at % mb")
    return both.select("bucket", "rank", F.least("ia", "ib").alias("left"), F.greatest("ia", "ib").alias("right"))


def precision_report(views: DataFrame, index: DataFrame, levels: DataFrame, links: DataFrame, start: str, months: list[int], seed: str = "s1", ks: list[int] = evaluate.PREFIXES) -> DataFrame:
    """J7, F21, G4, W8, J8, A13, R1, R2 as one job, on names that declarations have once.

    (bucket, months, k, source, rows, precision, low, mid, high): precision of the first k
    pairs of one normal form in each bucket, and of as many random ones, where a hit is a
    pair that is linked (old, new, since) inside the window; with the interval of 1000
    resamples. Buckets without pairs have no row.
    """
    k = max(ks)
    ranked = form_ranking(views, index, levels, k)
    random = random_pairs(views, index, levels, k, seed)
    both = ranked.select("bucket", "rank", "left", "right", F.lit("ranked").alias("source")).union(random.select("bucket", "rank", "left", "right", F.lit("random").alias("source")))
    name = lambda c: F.substring_index(c, "#", 1).alias(c)
    flagged = materialize(evaluate.linked_within(both.select("bucket", "rank", "source", name("left"), name("right")), links, start, months))
    by = ["bucket", "months", "source"]
    rates = evaluate.precision_at(flagged, by, ks)
    each = flagged.withColumn("k", F.explode(F.array(*[F.lit(x) for x in ks]))).where("rank <= k")
    keyed = each.select(F.concat_ws("|", *by, "k").alias("g"), (F.col("rank") - 1).cast("long").alias("at"), "flag")
    spread = evaluate.bootstrap(keyed, "g")
    return rates.withColumn("g", F.concat_ws("|", *by, "k")).join(spread, "g").drop("g")


def structural_pair_rank(views: DataFrame, left: str, right: str) -> DataFrame:
    """(rank, of, cosine, same_form) of the pair of ids ``left`` < ``right`` in W3's order.

    Pairs before it are counted by class pairs: all of a better score, and of an equal one
    those with earlier names. No rank if either id is no theorem or lemma, or both are of
    one module.
    """
    classes, members = statement_classes(views, 1)
    rows = views.where(F.col("kind").isin("theorem", "lemma")).select("id", "module", F.coalesce("digest", F.lit("")).alias("class"))
    ends = {r["id"]: r for r in rows.where(F.col("id").isin(left, right)).collect()}  # ids are unique
    later = rows.where(F.col("id") >= left).groupBy("class", "module").agg(F.count("*").alias("later"))
    blocked = materialize(_blocked(classes, members.join(later, ["class", "module"], "left").withColumn("later", F.coalesce("later", F.lit(0)))))
    known = left in ends and right in ends and ends[left]["module"] != ends[right]["module"]
    spark = views.sparkSession
    schema = "rank long, of long, cosine double, same_form boolean"
    if not known:
        of = _by_blocks(blocked, lambda x: pd.DataFrame({"n": [int(_scored(x)[4].sum())]}), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return spark.createDataFrame([(None, of, None, None)], schema)
    c, d = ends[left]["class"], ends[right]["class"]

    def own(x: pd.DataFrame) -> pd.DataFrame:
        a, b, square, same, n, _ = _scored(x)
        found = [(float(square[i, j]), bool(same[i, j])) for p, q in {(c, d), (d, c)} for i in [k for k, v in enumerate(a.names) if v == p] for j in [k for k, v in enumerate(b.names) if v == q] if n.size and n[i, j] > 0]
        return pd.DataFrame(found[:1], columns=["square", "same"])

    level = _by_blocks(blocked.where(F.col("class").isin(c, d)), own, "square double, same boolean").first()

    def before(x: pd.DataFrame) -> pd.DataFrame:
        a, b, square, same, n, ge = _scored(x)
        if not n.size:
            return pd.DataFrame([(0, 0, [])], columns=["before", "of", "ties"])
        better = (same > level["same"]) | (same == level["same"]) & (square > level["square"])
        tie = (same == level["same"]) & (square == level["square"]) & (n > 0)
        ties = {b.names[j] for i, j in zip(*np.nonzero(tie)) if a.names[i] == c} | {a.names[i] for i, j in zip(*np.nonzero(tie)) if b.names[j] == c}
        # of equal pairs, those whose first name is earlier: all but those with both names from ``left`` on
        return pd.DataFrame([(int(n[better].sum() + (n - ge)[tie].sum()), int(n.sum()), sorted(ties))], columns=["before", "of", "ties"])

    counted = materialize(_by_blocks(blocked, before, "before long, of long, ties array<string>"))
    tied = counted.select(F.explode("ties").alias("class")).distinct()
    # and those of the same first name whose second one is earlier
    beside = rows.join(tied, "class", "left_semi").where((F.col("id") > left) & (F.col("id") < right) & (F.col("module") != ends[left]["module"])).agg(F.count("*").alias("beside"))
    total = counted.agg(F.sum("before").alias("before"), F.sum("of").alias("of"))
    return total.crossJoin(F.broadcast(beside)).select((1 + F.col("before") + F.col("beside")).alias("rank"), "of", F.lit(level["square"] ** 0.5).alias("cosine"), F.lit(level["same"]).alias("same_form"))  # one row each


def text_pair_rank(vectors: DataFrame, modules: DataFrame, left: int, right: int, above: float = 0.25) -> DataFrame:
    """W5 on the text view: (rank, of, score) of a pair among those of different modules with cosine > ``above``.

    ``vectors`` (doc, term, w) as J1 has them; docs without a path between their modules, so
    equal scores (at six digits) order by left and right, descending. Docs of one vector
    are a class; class pairs are met by J1's bound and counted by their members. Rank and
    score are null where the pair is not among them.
    """
    same = [F.sum(F.xxhash64("term", "w").cast("decimal(20,0)")).alias("h"), F.count("*").alias("m"), F.sum(F.hash("term", "w").cast("long")).alias("g")]
    keyed = materialize(vectors.groupBy("doc").agg(*same).join(modules, "doc"))
    # a class goes by its least doc
    named = keyed.groupBy("h", "m", "g").agg(F.min("doc").alias("class"))
    docs = materialize(keyed.join(named, ["h", "m", "g"]).select("doc", "module", "class"))
    ends = {r["doc"]: r for r in docs.where(F.col("doc").isin(left, right)).collect()}
    heads = docs.select("class").distinct()
    own = vectors.join(heads.withColumnRenamed("class", "doc"), "doc", "left_semi")
    met = cosine_pairs(materialize(own), heads.select(F.col("class").alias("doc"), F.col("class").alias("module")), above).select(F.col("left").alias("ca"), F.col("right").alias("cb"), F.round("score", 6).alias("score"))
    alone = heads.select(F.col("class").alias("ca"), F.col("class").alias("cb"), F.lit(1.0).alias("score"))
    met = materialize(met.union(alone) if above < 1 else met)
    # how many pairs of different modules a class pair stands for
    sums = docs.groupBy("class", "module").agg(F.count("*").alias("n"))
    sizes = sums.groupBy("class").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    wide = met.join(sizes.toDF("ca", "na", "nna"), "ca").join(sizes.select(F.col("class").alias("cb"), F.col("n").alias("nb")), "cb")
    shared = met.where("ca <> cb").select("ca", "cb").join(sums.toDF("ca", "module", "xa"), "ca").join(sums.toDF("cb", "module", "xb"), ["cb", "module"]).groupBy("ca", "cb").agg(F.sum(F.col("xa") * F.col("xb")).alias("xn"))
    twin = F.col("ca") == F.col("cb")
    pairs = F.when(twin, F.expr("(na * na - nna) div 2")).otherwise(F.col("na") * F.col("nb") - F.coalesce("xn", F.lit(0)))
    counted = materialize(wide.join(shared, ["ca", "cb"], "left").select("ca", "cb", "score", pairs.alias("n")).where("n > 0"))
    pair = [ends[x]["class"] for x in (left, right)] if len(ends) == 2 and ends[left]["module"] != ends[right]["module"] else [None, None]
    level = counted.where(((F.col("ca") == pair[0]) & (F.col("cb") == pair[1])) | ((F.col("ca") == pair[1]) & (F.col("cb") == pair[0]))).agg(F.max("score")).first()[0]
    if level is None:
        return counted.agg(F.lit(None).cast("long").alias("rank"), F.coalesce(F.sum("n"), F.lit(0)).alias("of"), F.lit(None).cast("double").alias("score"))
    tie = F.col("score") == level
    # of equal pairs, those whose lesser name is later than ``left``, or is ``left`` with a later partner
    one = counted.agg(F.coalesce(F.sum(F.when(F.col("score") > level, F.col("n"))), F.lit(0)).alias("before"), F.sum("n").alias("of"))
    tied = counted.where(tie).select("ca", "cb")
    both = tied.union(tied.where("ca <> cb").select("cb", "ca")).toDF("ca", "cb")
    after = lambda df, x: df.where(F.col("doc") > x).groupBy("class", "module").agg(F.count("*").alias("n"))
    late = materialize(after(docs, left))
    total = late.groupBy("class").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    apart = both.join(total.toDF("ca", "na", "nna"), "ca").join(total.select(F.col("class").alias("cb"), F.col("n").alias("nb")), "cb")
    same = both.where("ca <> cb").join(late.toDF("ca", "module", "xa"), "ca").join(late.toDF("cb", "module", "xb"), ["cb", "module"]).agg(F.coalesce(F.sum(F.col("xa") * F.col("xb")), F.lit(0)).alias("s"))
    beyond = apart.agg(F.coalesce(F.sum(F.when(twin, F.col("na") * F.col("na") - F.col("nna")).otherwise(F.col("na") * F.col("nb"))), F.lit(0)).alias("p"))
    beside = docs.join(both.where(F.col("ca") == pair[0]).select(F.col("cb").alias("class")), "class", "left_semi").where((F.col("doc") > right) & (F.col("module") != ends[left]["module"])).agg(F.count("*").alias("beside"))
    rank = F.expr("1 + before + (p - s) div 2 + beside")
    return one.crossJoin(F.broadcast(beyond)).crossJoin(F.broadcast(same)).crossJoin(F.broadcast(beside)).select(rank.alias("rank"), "of", F.lit(level).alias("score"))  # one row each
