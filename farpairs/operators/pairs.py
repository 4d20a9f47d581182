"""Statement classes, far pairs, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpairs.functions import text as T


def last_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """For each key the row with the largest ``order``; aggregated before the exchange."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def class_pairs(views: DataFrame, form: str = "form", block_rows: int = 2000) -> DataFrame:
    """(left, right, left_module, right_module): equal forms in different modules.

    Forms of one row are pruned first. A large class is cut into blocks of about
    ``block_rows`` rows by row hash, and block pairs are the join key, so that a hot form's
    pairs spread over tasks; a class of one block is not copied.
    """
    counted = views.where(F.col(form).isNotNull()).groupBy(form).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    rows = views.join(counted, form).select(F.col(form).alias("form"), "full_name", "module", blocks.alias("blocks"), F.pmod(F.xxhash64("full_name"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = rows.select("form", F.col("full_name").alias("left"), F.col("module").alias("left_module"), F.col("block").alias("ba"), other.alias("bb"))
    b = rows.select("form", F.col("full_name").alias("right"), F.col("module").alias("right_module"), F.col("block").alias("bb"), other.alias("ba"))
    return a.join(b, ["form", "ba", "bb"]).where("left < right and left_module <> right_module").select("left", "right", "left_module", "right_module")


def class_module_pairs(views: DataFrame, form: str = "form") -> DataFrame:
    """(left_module, right_module, n): how many pairs J7 has between two modules, counted and not made.

    Rows are counted by form and module first, so one row stands for all equal forms of a module.
    """
    counted = views.where(F.col(form).isNotNull()).groupBy(F.col(form).alias("form"), "module").agg(F.count("*").alias("n"))
    a, b = counted.toDF("form", "left_module", "na"), counted.toDF("form", "right_module", "nb")
    met = a.join(b, "form").where("left_module < right_module")
    return met.groupBy("left_module", "right_module").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))


def with_hops(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """Pairs with the hops between their modules; null without a path."""
    return pairs.join(distances.toDF("left_module", "right_module", "hops"), ["left_module", "right_module"], "left")


def precision_order() -> list:
    """Cosine descending, then the two names in order."""
    return [F.desc("cosine"), F.least("left", "right"), F.greatest("left", "right")]


def top_per_bucket(pairs: DataFrame, k: int, order: list) -> DataFrame:
    """The first ``k`` of each bucket, with their rank.

    The ranking limit is pushed below the exchange by the planner.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def min_max(pairs: DataFrame, column: str, of: int = 0) -> DataFrame:
    """``column``_norm over all pairs; a constant column is 0.

    If there are more pairs (``of``) than rows, those left out have the value 0.
    """
    lo, hi = F.min(column), F.max(column)
    more = F.count("*") < of
    ends = pairs.agg(F.when(more, F.least(lo, F.lit(0.0))).otherwise(lo).alias("lo"), F.when(more, F.greatest(hi, F.lit(0.0))).otherwise(hi).alias("hi"))
    out = F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return pairs.crossJoin(F.broadcast(ends)).withColumn(f"{column}_norm", out).drop("lo", "hi")


def resolved(names: DataFrame, decls: DataFrame) -> DataFrame:
    """(name, hits, module, full_name, statement): a short name, or module suffix and short name.

    ``module``, ``full_name`` and ``statement`` are null unless there is exactly one hit.
    """
    wanted = names.select("name").distinct().select("name", F.substring_index("name", ".", -1).alias("short"), T.qualifier(F.col("name")).alias("suffix"))
    found = decls.select(F.col("name").alias("short"), "module", "statement")
    fits = F.col("suffix").isNull() | T.module_matches(F.col("module"), F.col("suffix"))
    hits = wanted.join(found, "short").where(fits).groupBy("name", "short").agg(F.count("*").alias("n"), F.min(F.struct("module", "statement")).alias("x"))
    one = lambda c: F.when(F.col("n") == 1, c)
    return wanted.select("name").join(hits, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("hits"), one(F.col("x.module")).alias("module"), one(F.concat_ws(".", "x.module", "short")).alias("full_name"), one(F.col("x.statement")).alias("statement"))


def named_once(resolutions: DataFrame) -> DataFrame:
    """The same rows; a job that reads one with no hit or several fails."""
    told = F.raise_error(F.concat(F.col("name"), F.lit(": "), F.col("hits").cast("string"), F.lit(" matches"))).cast("string")
    return resolutions.withColumn("module", F.when(F.col("hits") == 1, F.col("module")).otherwise(told))


def lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, corpus, module, name, via): equal digests first, then equal forms."""
    by = lambda c, via: queries.where(F.col(c).isNotNull()).select("query", c).join(index.select("corpus", "module", "name", c), c).select("query", "corpus", "module", "name", F.lit(via).alias("via"))
    both = by("digest", "exact_digest").union(by("form", "normal_form"))
    return both.groupBy("query", "corpus", "module", "name").agg(F.min("via").alias("via"))


def gaps(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Queries without a match in any corpus."""
    return queries.join(matches.select("query").distinct(), "query", "left_anti")


def match_fractions(queries: DataFrame, matches: DataFrame, corpora: DataFrame) -> DataFrame:
    """(corpus, fraction) of queries with a match there; null without queries."""
    n = queries.select("query").distinct().count()
    met = matches.groupBy("corpus").agg(F.count_distinct("query").alias("met"))
    share = F.when(F.lit(n) > 0, F.coalesce("met", F.lit(0)) / F.lit(float(max(n, 1))))
    return corpora.join(met, "corpus", "left").select("corpus", share.alias("fraction"))
