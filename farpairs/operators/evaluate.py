"""Freezes, windows, recall, precision, controls, intervals, probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from farpairs.functions import text as T
from farpairs.functions.draws import resampled
from farpairs.operators.pairs import resolved
from farpairs.tables import materialize

KS = [1, 5, 10, 50]
PREFIXES = [10, 50, 100]
MONTHS = [1, 3, 6, 12]


def freeze(deprecations: DataFrame, decls: DataFrame) -> DataFrame:
    """Deprecations with their class: alias, no_replacement, unresolved, identical or kept.

    ``old`` and ``new`` are full names; ``new`` is null where nothing was resolved.
    """
    known = resolved(deprecations.where("class is null and replacement is not null").select(F.col("replacement").alias("name")), decls)
    joined = deprecations.withColumnRenamed("module", "old_module").join(known, (F.col("replacement") == known["name"]) & F.col("class").isNull(), "left")
    old, new = T.one_spaced(F.col("old_sig")), T.one_spaced(F.col("statement"))
    kind = F.coalesce(F.col("class"), F.when(F.coalesce("hits", F.lit(0)) != 1, "unresolved"), F.when(old == new, "identical"), F.lit("kept"))
    return joined.select(F.concat_ws(".", "old_module", "old").alias("old"), F.col("full_name").alias("new"), "since", old.alias("old_statement"), new.alias("new_statement"), kind.alias("class"))


def freeze_counts(frozen: DataFrame) -> DataFrame:
    """A10: (class, n)."""
    return frozen.groupBy("class").agg(F.count("*").alias("n"))


def freeze_hash(frozen: DataFrame) -> DataFrame:
    """One hash of the kept pairs, whatever their order."""
    line = F.concat_ws("\x1f", "old", "new", F.coalesce(F.col("since").cast("string"), F.lit("")), "old_statement", "new_statement")
    # row hashes add up in any order and without one large group
    part = lambda k: F.sum(F.conv(F.substring(F.sha2(line, 256), 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)"))
    kept = frozen.where("class = 'kept'").agg(F.count("*").alias("n"), *[part(k).alias(f"p{k}") for k in range(8)])
    return kept.select(F.sha2(F.concat_ws("-", "n", *[F.coalesce(F.col(f"p{k}").cast("string"), F.lit("0")) for k in range(8)]), 256).alias("hash"))


def windows(rows: DataFrame, start: str, since: str = "since", months: list[int] = MONTHS) -> DataFrame:
    """A row for each window that holds its date: start < since <= start + m months."""
    ends = F.array(*[F.struct(F.lit(m).alias("months"), F.add_months(F.lit(start).cast("date"), m).alias("end")) for m in months])
    return rows.withColumn("__w", F.explode(ends)).where((F.col(since) > F.lit(start).cast("date")) & (F.col(since) <= F.col("__w.end"))).select(*rows.columns, F.col("__w.months").alias("months"))


def recall_at(outcomes: DataFrame, by: list[str], ks: list[int] = KS) -> DataFrame:
    """Frozen, missing, evaluated, unparsed, and hits and recall for each k.

    Evaluated counts unparsed rows too; recall is null when nothing was evaluated.
    """
    status = F.col("status")
    counts = [F.count("*").alias("frozen"), F.count_if(status == "missing").alias("missing"), F.count_if(status != "missing").alias("evaluated"), F.count_if(status == "unparsed").alias("unparsed")]
    hits = [F.count_if((status == "ranked") & (F.col("rank") <= k)).alias(f"h{k}") for k in ks]
    one = outcomes.groupBy(*by).agg(*counts, *hits)
    long = one.withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])))
    return long.select(*by, "frozen", "missing", "evaluated", "unparsed", F.col("x.k").alias("k"), F.col("x.hits").alias("hits"), F.when(F.col("evaluated") > 0, F.col("x.hits") / F.col("evaluated")).alias("recall"))


def precision_at(ranked: DataFrame, by: list[str], ks: list[int] = PREFIXES) -> DataFrame:
    """(by, k, rows, precision) over the rows with rank <= k that are there."""
    within = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    return within.groupBy(*by, "k").agg(F.count("*").alias("rows"), F.avg(F.col("flag").cast("double")).alias("precision"))


def random_recall(views: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """(by, parsed, random_recall): k places among all other parsed rows; null for one row or none."""
    return views.groupBy(*by).agg(F.count_if("parsed").alias("parsed")).withColumn("random_recall", F.when(F.col("parsed") > 1, F.lit(float(k)) / (F.col("parsed") - 1)))


def linked_within(pairs: DataFrame, links: DataFrame, start: str, months: list[int] = MONTHS) -> DataFrame:
    """Each pair in each window with a flag: a link's last date lies in start < since <= start + m months."""
    dated = later_linked(pairs, links)
    first = F.lit(start).cast("date")
    each = dated.withColumn("months", F.explode(F.array(*[F.lit(m) for m in months])))
    flag = (F.col("since") > first) & (F.col("since") <= F.add_months(first, F.col("months")))
    return each.withColumn("flag", F.coalesce(flag, F.lit(False)))


def targets(gaps: DataFrame, rollup: DataFrame) -> DataFrame:
    """Gaps (query) whose direct probe (query, outcome) did not close; one never tried is a target."""
    return gaps.join(rollup.where("outcome = 'closed'").select("query").distinct(), "query", "left_anti")


def unportable(rows: DataFrame, closed: list[str]) -> DataFrame:
    """Every row of the neighbourhood once for each corpus that cannot be elaborated, given by name."""
    return rows.withColumn("corpus", F.explode(F.array(*[F.lit(c) for c in sorted(set(closed))]).cast("array<string>")))


def probe_jobs(recovered: DataFrame, frozen: DataFrame) -> DataFrame:
    """(old, new) with both statements of the frozen set; a job that reads a pair that is not frozen fails."""
    kept = frozen.where("class = 'kept'").groupBy("old", "new").agg(F.min(F.struct("old_statement", "new_statement")).alias("x"))
    told = F.raise_error(F.concat_ws(" ", F.lit("not frozen:"), "old", "new")).cast("string")
    return recovered.select("old", "new").join(kept, ["old", "new"], "left").select("old", "new", F.when(F.col("x").isNull(), told).otherwise(F.col("x.old_statement")).alias("old_statement"), F.col("x.new_statement").alias("new_statement"))


def later_linked(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs with the last date of an (unordered) link between them, or null."""
    dated = links.groupBy(F.least("old", "new").alias("a"), F.greatest("old", "new").alias("b")).agg(F.max("since").alias("since"))
    return pairs.withColumns({"a": F.least("left", "right"), "b": F.greatest("left", "right")}).join(dated, ["a", "b"], "left").drop("a", "b")


def random_control(pairs: DataFrame, by: str, key: str, seed: str, k: int) -> DataFrame:
    """A seeded permutation of each bucket's rows; prefixes nest, windows share it."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"), F.col(key).cast("string")).cast("binary"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("rank") <= k)


#: Draws of a task's row in ``bootstrap``.
DRAWS = 25


def bootstrap(flags: DataFrame, by: str, draws: int = 1000, seed: str = "b") -> DataFrame:
    """R2: (by, low, mid, high): percentiles of the mean of resampled flags (by, at, flag).

    ``at`` numbers a group's rows from 0. Picks are hashes of draw and slot, so any engine
    makes the same ones. A group is one array of flags, 64 to a long, which stands once for
    every 25 draws; those are hashed many slots at a time inside tasks, and a draw is a row.
    """
    word = F.expr("at div 64").alias("word")
    bit = F.when(F.col("flag"), F.expr("shiftleft(1L, cast(at % 64 as int))")).otherwise(F.lit(0).cast("long"))
    words = flags.select(by, word, bit.alias("bit")).groupBy(by, "word").agg(F.expr("bit_or(bit)").alias("bits"), F.count("*").alias("n"))
    packed = materialize(words.groupBy(by).agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("flags")))
    head = F.concat(F.concat_ws("|", F.lit(seed), F.col(by).cast("string")), F.lit("|")).alias("head")
    steps = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS))).alias("first")
    # few small rows with much work each: a number, else they are put together again
    tasks = max(48, 4 * flags.sparkSession.sparkContext.defaultParallelism)
    each = packed.select(by, head, "n", steps, F.lit(draws).alias("draws"), "flags").repartition(tasks)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                bits = np.unpackbits(np.asarray(r.flags, np.int64).astype("<i8").view(np.uint8), count=r.n, bitorder="little")
                hits = resampled(r.head.encode(), bits, r.first, min(r.draws, r.first + DRAWS))
                yield pd.DataFrame({by: [r[0]] * len(hits), "m": hits / r.n})

    means = each.mapInPandas(drawn, StructType([packed.schema[by], StructField("m", DoubleType())]))
    listed = means.groupBy(by).agg(F.array_sort(F.collect_list("m")).alias("v"))
    at = lambda i: F.element_at("v", i + 1)
    return listed.select(by, at(int(0.025 * draws)).alias("low"), at(draws // 2).alias("mid"), at(min(draws - 1, int(0.975 * draws))).alias("high"))


#: Rank of an unparsed row (R3): never a hit, whatever k.
UNPARSED = 10**9


def recall_bootstrap(outcomes: DataFrame, by: str, key: str, k: int = 10, draws: int = 1000, seed: str = "b") -> DataFrame:
    """(by, evaluated, recall, low, mid, high) of recall@k over outcomes (by, key, status, rank).

    Missing rows are not evaluated; unparsed ones are, with a rank that never hits.
    """
    rank = F.when(F.col("status") == "unparsed", F.lit(UNPARSED)).otherwise(F.col("rank"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1
    flags = outcomes.where("status <> 'missing'").select(by, place.cast("long").alias("at"), (rank <= k).alias("flag"))
    rates = flags.groupBy(by).agg(F.count("*").alias("evaluated"), F.avg(F.col("flag").cast("double")).alias("recall"))
    return rates.join(bootstrap(flags, by, draws, seed), by)


def probe_rollup(attempts: DataFrame, by: list[str]) -> DataFrame:
    """(by, outcome, tactic): closed by the first closing tactic, else timeout, else open."""
    closed = F.col("outcome") == "closed"
    one = attempts.groupBy(*by).agg(F.min_by("tactic", F.when(closed, F.col("tactic_order"))).alias("first"), F.max(closed).alias("closed"), F.max(F.col("outcome") == "timeout").alias("late"))
    return one.select(*by, F.when(F.col("closed"), "closed").when(F.col("late"), "timeout").otherwise("open").alias("outcome"), F.when(F.col("closed"), F.col("first")).alias("tactic"))


def job_list(lists: DataFrame) -> DataFrame:
    """Each unordered pair once, with the label of its first list (priority, position)."""
    a, b = F.least("left", "right"), F.greatest("left", "right")
    return lists.groupBy(a.alias("a"), b.alias("b")).agg(F.min_by(F.struct("left", "right", "label"), F.struct("priority", "position")).alias("x")).select("x.left", "x.right", "x.label")


def closed_directions(rollup: DataFrame) -> DataFrame:
    """U4: one row for each closed direction."""
    return rollup.where("outcome = 'closed'")
