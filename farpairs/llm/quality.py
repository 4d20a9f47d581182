"""7. Quality rules: adaptive thresholds from mergeable quantile sketches.

Each text gets a few integer measures. For each group (language and source by
default) and measure a sketch counts texts in integer bins (a grid that is exact up to
1000 and keeps three digits beyond, so sketches of parts merge by adding counts; a
quantile is exact to one bin and nothing is clipped). Tukey-like fences from the sketch's quantiles replace fixed cutoffs:

    upper = q75 + spread * (q75 - q50) + slack
    lower = q25 - spread * (q50 - q25) - slack    (mean word length only)

A text is rejected if a measure lies beyond the fence of its group, or if it
fails one of two base rules (under 50 words; over half of its words in repeated
three-word windows).

Defined results: a null text has no words (and so fails the base rule); null
language or source is a group of its own; repeated rows are judged each alike; an
empty table gives an empty result. Long texts cost n log n. Extra columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.common import fresh, materialize
from farpairs.tables import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Width of the fence in quartile distances, and what is added in bins.
SPREAD = 6
#: Measures: slack in bins above q75, and below q25 (None: no lower fence).
MEASURES = {"symbol_pm": (40, None), "dup_line_pm": (350, None), "repeat_pm": (300, None), "word_len_x10": (30, 20)}
BINS = 1000


def measured(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct of counts and binned measures of ``text``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    w, h, s, base = (fresh(n, docs.columns) for n in ("__w", "__h", "__s", "__base"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn(w, F.array_remove(F.split(t, SPACE), ""))
    out = out.withColumn(
        base,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))[0].alias("lines"),
        ),
    )
    words = F.col(w)
    out = out.withColumn(h, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))))
    hashes = F.col(h)
    # only texts that repeat a window pay for the sort that finds which
    out = out.withColumn(s, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    sorted_ = F.col(s)
    repeated = F.filter(sorted_, lambda e, i: F.coalesce(F.get(sorted_, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(sorted_, i + 1)["h"] == e["h"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    b = F.col(base)
    out = out.withColumn(s, F.when(sorted_.isNull(), F.lit(0)).otherwise(covered).cast("long"))
    n_repeat = F.col(s)

    def ratio(a: Column, of: Column, scale: int) -> Column:
        return F.when(of > 0, F.floor(a * scale / of)).otherwise(0).cast("long")

    def binned(x: Column) -> Column:
        """Three digits of a larger number than ``BINS``."""
        step = F.pow(F.lit(10.0), F.length(x.cast("string")) - 3).cast("long")
        return F.when(x > BINS, x - x % step).otherwise(x)

    found = F.struct(
        b["n_words"].alias("n_words"),
        b["word_chars"].alias("word_chars"),
        b["n_symbols"].alias("n_symbols"),
        b["lines"]["dup"].alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        ((b["n_words"] < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * b["n_words"])).alias("base_failed"),
        ratio(b["n_symbols"], b["word_chars"], 1000).alias("symbol_pm"),
        ratio(b["lines"]["dup"], b["lines"]["n"], 1000).alias("dup_line_pm"),
        ratio(n_repeat, b["n_words"], 1000).alias("repeat_pm"),
        binned(ratio(b["word_chars"], b["n_words"], 10)).alias("word_len_x10"),
    )
    return out.withColumn(into, found).drop(w, h, s, base)


def sketches(found: DataFrame, groups: list[str], quality: str) -> DataFrame:
    """(groups, measure, bin, n): bin counts, which add up over parts of the data."""
    binned = found.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(quality)[m].alias("bin")) for m in MEASURES])).alias("__m"))
    return binned.groupBy(*groups, F.col("__m.measure").alias("measure"), F.col("__m.bin").alias("bin")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, groups: list[str], spread: int = SPREAD) -> DataFrame:
    """(groups, fences): a struct of lower and upper bounds per measure and group."""
    part = ", ".join([f"`{g}`" for g in groups] + ["measure"])
    run = sketch.withColumn("__run", F.expr(f"sum(n) over (partition by {part} order by bin)")).withColumn("__all", F.expr(f"sum(n) over (partition by {part})"))
    at = lambda percent: F.min(F.when(100 * F.col("__run") >= percent * F.col("__all"), F.col("bin")))
    q = run.groupBy(*groups, "measure").agg(at(25).alias("q25"), at(50).alias("q50"), at(75).alias("q75"))
    one = []
    for m, (above, below) in MEASURES.items():
        here = lambda c, m=m: F.max(F.when(F.col("measure") == m, c))
        one.append(here(F.col("q75") + spread * (F.col("q75") - F.col("q50")) + above).alias(f"{m}_max"))
        if below is not None:
            one.append(here(F.col("q25") - spread * (F.col("q50") - F.col("q25")) - below).alias(f"{m}_min"))
    return q.groupBy(*groups).agg(*one)


def quality_rules(docs: DataFrame, *, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), carry: list[str] | None = None, into: str = "quality") -> DataFrame:
    """``carry`` columns of ``docs`` (all by default) with a struct ``into`` of counts and ``kept``.

    One pass measures the texts and writes the result to the shared folder; the
    sketches and the join with their fences read that table.
    """
    carry = docs.columns if carry is None else carry
    into = fresh(into, carry)
    keys = [fresh(f"__g{i}", carry) for i in range(len(groups))]
    found = measured(docs, text, into).select(*[F.col(f"`{c}`") for c in carry], *[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)], into)
    found = materialize(found)
    bounds = materialize(fences(sketches(found, keys, into), keys))
    other = [f"{k}_r" for k in keys]
    bounds = bounds.toDF(*other, *bounds.columns[len(keys):])
    q = F.col(into)
    fits = ~q["base_failed"]
    for m, (_, below) in MEASURES.items():
        fits &= q[m] <= F.col(f"{m}_max")
        if below is not None:
            fits &= q[m] >= F.col(f"{m}_min")
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, other)]
    joined = found.join(bounds, on, "left")
    return joined.select(*[F.col(f"`{c}`") for c in carry], q.withField("kept", F.coalesce(fits, F.lit(False))).alias(into))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    quality = fresh("quality", docs.columns)
    return quality_rules(docs, into=quality).where(F.col(quality)["kept"]).drop(quality)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


_RATIO = "cast(case when {of} > 0 then ({a} * {k}) // {of} else 0 end as bigint)"
_LENGTH = _RATIO.format(a="word_chars", k=10, of="n_words")
_BINNED = f"case when {_LENGTH} > {BINS} then {_LENGTH} - {_LENGTH} % cast(pow(10, length(cast({_LENGTH} as varchar)) - 3) as bigint) else {_LENGTH} end"
OP7_SQL = f"""
with t as (select doc_id, lang, source, coalesce(text, '') as x from documents),
s as (select *, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as l from t),
c as (select doc_id, lang, source, w, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) as bigint) as word_chars,
        length(x) - length(translate(x, '{SYMBOLS}', '')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
        row_number() over () as rid from s),
g as (select rid, i, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as k from (select rid, w, unnest(range(1, n_words - 1)) as i from c)),
d as (select rid, i from (select *, count(*) over (partition by rid, k) as m from g) where m > 1),
r as (select rid, count(distinct i + j) as n from d, (values (0), (1), (2)) v(j) group by rid),
m as (select c.*, coalesce(r.n, 0) as n_repeat_words from c left join r using (rid)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed,
        {_RATIO.format(a="n_symbols", k=1000, of="word_chars")} as symbol_pm, {_RATIO.format(a="n_dup_lines", k=1000, of="n_lines")} as dup_line_pm,
        {_RATIO.format(a="n_repeat_words", k=1000, of="n_words")} as repeat_pm, {_BINNED} as word_len_x10 from m),
f as (select lang, source, {", ".join(f"quantile_disc({m}, 0.75) + {SPREAD} * (quantile_disc({m}, 0.75) - quantile_disc({m}, 0.5)) + {up} as {m}_max" for m, (up, _) in MEASURES.items())},
        {", ".join(f"quantile_disc({m}, 0.25) - {SPREAD} * (quantile_disc({m}, 0.5) - quantile_disc({m}, 0.25)) - {low} as {m}_min" for m, (_, low) in MEASURES.items() if low is not None)}
      from b group by lang, source)
select doc_id, cast(n_words as bigint) as n_words, word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and {" and ".join(f"{m} <= {m}_max" for m in MEASURES)} and {" and ".join(f"{m} >= {m}_min" for m, (_, low) in MEASURES.items() if low is not None)} as kept
from b join f on b.lang is not distinct from f.lang and b.source is not distinct from f.source
"""
