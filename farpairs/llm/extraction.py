"""Main text of web pages by minimum-cut labelling (op11).

A page is cut into blocks. A naive Bayes classifier over a block's kind, length, link
share and ending gives its cost for either label; marks in the page (article, main; nav,
footer, aside, form, classes such as ad or cookie) add a fixed cost. These costs are the
terminal capacities. Neighbouring blocks are joined by edges, stronger below the same
container, and every block hangs on its container, containers on theirs, so that blocks
near one another in the document tree lean to one label. The maximum flow separates the
article from the rest; a tie goes to the rest.

The classifier learns from the marked blocks of at most ``SAMPLE`` pages, those first in
the order of a hash of their html; its marks are not among its features. Everything
else reads all pages, each whole.

Defined results: null or empty html, and pages without an article's text, give an empty
text; repeated rows count each; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.blocks import Block, features, read
from farpairs.llm.mincut import Cut
from farpairs.tables import table

#: Pages that the classifier learns from.
SAMPLE = 2000
#: Added to every count, so that a feature never seen decides nothing.
SMOOTH = 5.0
#: Cost of a label against the page's marks; most that the classifier's score may cost.
MARKED, MOST = 12.0, 6.0
#: Capacities: neighbours below one container, other neighbours, block to container, container to container.
NEXT, ACROSS, HANGS, ABOVE = 1.0, 0.3, 0.5, 0.25


def learned(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Log-odds of each feature for the article, from marked blocks; ``""`` has the prior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, bool], int] = {}
            for page in batch.column(0):
                blocks = read(page.as_py() or "")
                for k, b in enumerate(blocks):
                    if b.side:
                        for f in ["", *features(blocks, k)]:
                            key = (f, b.side > 0)
                            seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["feature", "article", "n"])

    hashed = pages.select("html", F.xxhash64("html").alias("h")).where("html is not null")
    # only hashes are ordered; a page that is there often is taken once
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    taken = hashed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]) if last is not None else hashed.where("false")
    counted = taken.select("html").mapInArrow(run, "feature string, article boolean, n long")
    rows = counted.groupBy("feature").agg(F.sum(F.when(F.col("article"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("article"), F.lit(0)).otherwise(F.col("n"))).alias("no")).collect()
    by = {r["feature"]: (r["yes"], r["no"]) for r in rows}  # a row for each of some fifty features
    yes, no = by.pop("", (0, 0))
    odds = {f: math.log((a + SMOOTH) / (yes + 2 * SMOOTH)) - math.log((b + SMOOTH) / (no + 2 * SMOOTH)) for f, (a, b) in by.items()}
    return odds | {"": math.log((yes + SMOOTH) / (no + SMOOTH))}


def cost(blocks: list[Block], k: int, odds: dict[str, float]) -> float:
    """How much dearer a block is as boilerplate than as article."""
    score = odds.get("", 0.0) + sum(odds.get(f, 0.0) for f in features(blocks, k))
    return max(-MOST, min(MOST, score)) + MARKED * blocks[k].side


def labels(blocks: list[Block], odds: dict[str, float]) -> list[bool]:
    """Blocks on the article's side of the minimum cut."""
    inside = {c: len(blocks) + i for i, c in enumerate(dict.fromkeys(c for b in blocks for c in b.inside))}
    cut = Cut(len(blocks) + len(inside))
    up: set[tuple[int, int]] = set()
    for k, b in enumerate(blocks):
        d = cost(blocks, k, odds)
        cut.costs(k, max(d, 0.0), max(-d, 0.0))
        # the innermost container is the block's own element; its neighbours hang on the next one
        if b.inside:
            cut.edge(k, inside[b.inside[-1]], HANGS, HANGS)
            up.update(zip(b.inside[1:], b.inside))
        if k:
            w = NEXT if blocks[k - 1].inside[:-1] == b.inside[:-1] else ACROSS
            cut.edge(k - 1, k, w, w)
    for a, b in sorted(up):
        cut.edge(inside[a], inside[b], ABOVE, ABOVE)
    return cut.source_side()[: len(blocks)]


def main_text(page: str | None, odds: dict[str, float]) -> tuple[str, int, int]:
    """(text, blocks, blocks of the article) of a page."""
    blocks = read(page or "")
    kept = [b.text for b, x in zip(blocks, labels(blocks, odds)) if x] if blocks else []
    return "\n\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of each row of ``pages`` (page_id, url, html)."""
    narrow = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").cast("string").alias("html"))
    odds = learned(narrow, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [main_text(x.as_py(), odds) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: For tables whose articles are marked by their element, as the given ones are: its blocks, cut at their tags.
OP11_SQL = r"""with a as (select page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>')) as x, generate_subscripts(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'), 1) as k from pages),
b as (select page_id, url, k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as t from a),
c as (select page_id, url, coalesce(string_agg(t, chr(10) || chr(10) order by k) filter (where t <> ''), '') as text from b group by page_id, url)
select page_id, url, text, length(text) as n_chars from c"""
