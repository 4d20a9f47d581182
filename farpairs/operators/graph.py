"""Module graph: distances, components, degrees, hubs, buckets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpairs.tables import materialize

#: Buckets overlap: far pairs are in both of the first two.
BUCKETS = ["ge4", "ge8", "no_path"]


def internal(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges with both ends in the graph; repeated edges stay."""
    names = modules.select("module").distinct()
    return imports.join(names.withColumnRenamed("module", "dst"), "dst", "left_semi").join(names.withColumnRenamed("module", "src"), "src", "left_semi").select("src", "dst")


def packed(modules: DataFrame, imports: DataFrame, sources: DataFrame | None = None, most: int | None = None, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """G1, G2 with 64 sources to a long: (index, levels).

    Index: (module, word, bit) of each source; with all modules as sources also the
    component. Levels: (module, word, hops, bits): the sources of that word which first
    reach the module after so many hops. A round is ``bit_or`` over the neighbours. Sources
    of one component stand side by side, so a component of m modules has m * m / 64 rows
    for each of its distances at most. ``sources`` limits the starting modules, ``most`` the
    hops; with ``target`` the walk ends in the round that reaches it.
    """
    edges = materialize(internal(modules, imports))
    both = materialize(edges.union(edges.select("dst", "src")).where("src <> dst").distinct().toDF("at", "dst"))
    start = modules.select("module").distinct()
    if sources is None:
        index = materialize(_numbered(components(modules, imports)))
    else:
        start = start.join(sources.select("module").distinct(), "module", "left_semi")
        groups = max(1, -(-start.count() // 256))
        group = F.pmod(F.xxhash64("module"), F.lit(groups))
        place = F.row_number().over(Window.partitionBy("g").orderBy("module")) - 1
        # a group's words are its number and every further step of the number of groups
        index = materialize(start.withColumn("g", group).withColumn("p", place).select("module", (F.col("g") + F.lit(groups) * F.expr("p div 64")).cast("long").alias("word"), (F.col("p") % 64).cast("int").alias("bit")))
    frontier = materialize(index.select("module", "word", F.lit(0).alias("hops"), F.expr("shiftleft(1L, bit)").alias("bits")).groupBy("module", "word", "hops").agg(F.expr("bit_or(bits)").alias("bits")))
    rounds, hops = [frontier], 0
    none = F.lit(0).cast("long")
    while (most is None or hops < most) and (target is None or rounds[-1].where(F.col("module") == target).isEmpty()):
        hops += 1
        step = frontier.withColumnRenamed("module", "at").join(both, "at").select(F.col("dst").alias("module"), "word", F.col("bits").alias("reached"), none.alias("known"))
        # undirected: whatever is already known lies in the last two rounds
        for r in rounds[-2:]:
            step = step.union(r.select("module", "word", none, "bits"))
        met = step.groupBy("module", "word").agg(F.expr("bit_or(reached) & ~bit_or(known)").alias("bits"))
        frontier = materialize(met.where("bits <> 0").select("module", "word", F.lit(hops).alias("hops"), "bits"))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return index, out


def _numbered(labels: DataFrame) -> DataFrame:
    """(module, component, word, bit): modules numbered by component and name, in ranges of components."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    # components lie in order of groups by hash; sums over groups, then inside each, so no task sees all
    groups = max(1, -(-labels.count() // 4096))
    dealt = sizes.withColumn("g", F.pmod(F.xxhash64("component"), F.lit(groups)))
    before = lambda by, order: F.coalesce(F.sum("n").over((Window.partitionBy(by) if by else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = dealt.groupBy("g").agg(F.sum("n").alias("n")).select("g", before(None, "g").alias("outer"))  # a row for 4096 modules
    starts = dealt.withColumn("inner", before("g", "component")).join(upto, "g").select("component", (F.col("outer") + F.col("inner")).alias("start"))
    place = F.row_number().over(Window.partitionBy("component").orderBy("module")) - 1
    at = labels.withColumn("p", place).join(starts, "component").select("module", "component", (F.col("start") + F.col("p")).alias("at"))
    return at.select("module", "component", F.expr("at div 64").alias("word"), (F.col("at") % 64).cast("int").alias("bit"))


#: Modules of a block of ``by_blocks``, 64 to a word.
BLOCK = 1024


def by_blocks(index: DataFrame, levels: DataFrame, payload: DataFrame, f: Callable, schema: str, met: DataFrame | None = None) -> DataFrame:
    """Applies ``f`` to each pair of blocks of modules between which there are paths.

    ``payload``: (module, ...) with what ``f`` needs of a module; others take no part.
    ``f`` gets (left rows, right rows, hops, class pairs): the payload of both blocks, the
    hops between them (-1: no path), and the rows (ca, cb, ...) of ``met`` whose classes are
    among the ``classes`` of the two. On the diagonal both blocks are the same frame.
    """
    words = max(1, BLOCK // 64)
    number = index.select("module", (F.col("word") * 64 + F.col("bit")).alias("no"))
    held = materialize(payload.join(number, "module").withColumn("block", F.floor(F.col("no") / (64 * words)).cast("long")).withColumn("at", (F.col("no") % (64 * words)).cast("int")).drop("no"))
    ends = held.select("module", F.col("block").alias("high"), "at")
    near = levels.where("hops > 0").join(ends, "module").withColumn("low", F.floor(F.col("word") / words).cast("long")).where("low <= high").select("low", "high", F.struct((F.col("word") % words).cast("int").alias("word"), "at", F.col("hops").cast("int").alias("hops"), F.expr("bits & 4294967295").alias("lo"), F.expr("shiftrightunsigned(bits, 32)").alias("hi")).alias("x"))  # halves, since numbers of a column with nulls may come as floats
    near = materialize(near)
    pairs = near.select("low", "high").distinct()
    # an end of a pair of blocks without modules of its own gives nothing
    inside = pairs.join(held.select(F.col("block").alias("low")).distinct(), "low", "left_semi")
    a = inside.join(held.withColumnRenamed("block", "low"), "low").withColumn("side", F.lit(0))
    b = inside.where("low < high").join(held.withColumnRenamed("block", "high"), "high").withColumn("side", F.lit(1))
    rest = [c for c in held.columns if c != "block"]
    parts = [a.unionByName(b).select("low", "high", "side", F.struct(*rest).alias("y")), near.join(inside, ["low", "high"], "left_semi").select("low", "high", F.lit(2).alias("side"), "x")]
    wanted = [] if met is None else met.columns
    if met is not None:
        of = held.select("block", F.explode("classes").alias("class")).distinct()
        reach = materialize(inside.union(inside.select("high", "low")).distinct().toDF("ba", "bb"))
        both = met.join(of.toDF("ba", "ca"), "ca").join(reach, "ba").join(of.toDF("bb", "cb"), ["bb", "cb"], "left_semi")
        parts.append(both.select(F.least("ba", "bb").alias("low"), F.greatest("ba", "bb").alias("high"), F.lit(3).alias("side"), F.struct(*wanted).alias("z")).distinct())
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    names = {"x": ["word", "at", "hops", "lo", "hi"], "y": rest, "z": wanted}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        def part(side: int, c: str) -> pd.DataFrame:
            own = rows.loc[rows["side"] == side, c].tolist() if c in rows else []
            own = [tuple(x.values()) if isinstance(x, dict) else x for x in own]
            return pd.DataFrame(dict(zip(names[c], zip(*own)))) if own else pd.DataFrame([], columns=names[c])

        left = part(0, "y")
        right = left if rows["low"].iloc[0] == rows["high"].iloc[0] else part(1, "y")
        steps = part(2, "x")
        hops = np.full((64 * words, 64 * words), -1, np.int16)
        halves = np.ascontiguousarray(steps[["lo", "hi"]].to_numpy(np.int64).astype("<u4"))
        bits = np.unpackbits(halves.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(steps) else np.zeros((0, 64), np.uint8)
        r, b = np.nonzero(bits)
        hops[steps["word"].to_numpy(np.int64)[r] * 64 + b, steps["at"].to_numpy(np.int64)[r]] = steps["hops"].to_numpy(np.int64)[r]
        own = hops[np.ix_(left["at"].to_numpy(np.int64), right["at"].to_numpy(np.int64))]
        return f(left, right, own, part(3, "z"))

    return every.groupBy("low", "high").applyInPandas(run, schema)


def unpacked(index: DataFrame, levels: DataFrame) -> DataFrame:
    """(src, dst, hops), a row for each source that reaches a module."""
    bit = F.explode(F.expr("filter(sequence(0, 63), b -> shiftrightunsigned(bits, b) & 1 = 1)"))
    each = levels.select("word", bit.alias("bit"), F.col("module").alias("dst"), "hops")
    return each.join(index.withColumnRenamed("module", "src"), ["word", "bit"]).select("src", "dst", "hops")


def hops_between(pairs: DataFrame, index: DataFrame, levels: DataFrame) -> DataFrame:
    """J6 on packed distances: ``pairs`` (left_module, right_module, ...) with hops; null without a path.

    The left module has to be a source; a module's levels are one array a word.
    """
    arrays = levels.groupBy(F.col("module").alias("right_module"), "word").agg(F.collect_list(F.struct("hops", "bits")).alias("levels"))
    met = pairs.join(index.withColumnRenamed("module", "left_module"), "left_module", "left").join(arrays, ["right_module", "word"], "left")
    hops = F.get(F.expr("filter(levels, x -> shiftrightunsigned(x.bits, bit) & 1 = 1)"), 0)["hops"]
    return met.select(*pairs.columns, hops.alias("hops"))


def distances(modules: DataFrame, imports: DataFrame, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(src, dst, hops) over undirected internal edges; no row means no path."""
    return unpacked(*packed(modules, imports, sources, most))


def pair_hops(modules: DataFrame, imports: DataFrame, left: str, right: str) -> DataFrame:
    """One row, hops of a named pair: the walk stops at the round that meets it; null without a path."""
    _, levels = packed(modules, imports, modules.where(F.col("module") == left), target=right)
    return levels.where(F.col("module") == right).agg(F.min("hops").alias("hops"))


def components(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, component): the least module name reachable, by labels and pointer jumping."""
    edges = materialize(internal(modules, imports).where("src <> dst"))
    both = materialize(edges.union(edges.select("dst", "src")).distinct().toDF("at", "to"))
    labels = materialize(modules.select("module").distinct().withColumn("component", F.col("module")))
    while True:
        near = both.join(labels, both["to"] == labels["module"]).groupBy("at").agg(F.min("component").alias("m"))
        low = labels.join(near, labels["module"] == near["at"], "left").select("module", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("low"))
        step = materialize(low.join(labels.toDF("low", "next"), "low").select("module", "was", F.least("low", "next").alias("component")))
        labels = step.select("module", "component")
        if step.where("was <> component").isEmpty():
            return labels


def in_degrees(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, in_degree) over internal edges, 0 for none."""
    counted = internal(modules, imports).groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("n"))
    return modules.select("module").distinct().join(counted, "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("in_degree"))


def summary(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """One row of counts. Isolated: no internal edge at either end."""
    inside = internal(modules, imports)
    degree = in_degrees(modules, imports)
    out = inside.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("out_degree"))
    per = degree.join(out, "module", "left").select("module", "in_degree", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    counts = per.agg(F.count("*").alias("modules"), F.sum("in_degree").alias("internal_edges"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated"), F.max("in_degree").alias("max_in_degree"), F.count_if(F.col("in_degree") > 0).alias("reused"))
    edges = imports.agg(F.count("*").alias("edges"))
    return counts.crossJoin(edges).select("modules", "internal_edges", (F.col("edges") - F.col("internal_edges")).alias("external_edges"), F.round(F.col("internal_edges") / F.col("modules"), 3).alias("internal_per_module"), "isolated", "max_in_degree", "reused")


def without_hubs(modules: DataFrame, imports: DataFrame, fraction: float) -> tuple[DataFrame, DataFrame]:
    """(modules, imports) less the top ``round(fraction * n)`` by in-degree, then by name."""
    degree = materialize(in_degrees(modules, imports))
    k = round(fraction * degree.count())
    # degrees with how many modules have more: the one where the k-th lies is cut by name, all above it go
    more = F.sum("n").over(Window.orderBy(F.desc("in_degree"))) - F.col("n")  # a row for each degree
    cut = degree.groupBy("in_degree").agg(F.count("*").alias("n")).withColumn("more", more).where(F.col("more") < k)
    ranked = degree.join(F.broadcast(cut), "in_degree")
    whole = F.col("more") + F.col("n") <= k
    edge = ranked.where(~whole).withColumn("p", F.col("more") + F.row_number().over(Window.partitionBy("in_degree").orderBy("module")))
    hubs = ranked.where(whole).select("module").union(edge.where(F.col("p") <= k).select("module"))
    kept = modules.join(hubs, "module", "left_anti")
    return kept, internal(kept, imports)


def hub_report(modules: DataFrame, imports: DataFrame, left: str, right: str, fractions: tuple[float, ...] = (0.0, 0.01, 0.05)) -> DataFrame:
    """(fraction, hubs_removed, modules_left, hops) of a named pair for each fraction."""
    n = modules.select("module").distinct().count()
    out = None
    for f in fractions:
        kept, edges = without_hubs(modules, imports, f)
        kept = materialize(kept.select("module"))
        far = pair_hops(kept, edges, left, right)
        row = kept.agg(F.count("*").alias("modules_left")).crossJoin(far).select(F.lit(f).alias("fraction"), (F.lit(n) - F.col("modules_left")).alias("hubs_removed"), "modules_left", "hops")
        out = row if out is None else out.union(row)
    return out


def bucketed(pairs: DataFrame, hops: str = "hops") -> DataFrame:
    """One row for each bucket that a pair is in; a null distance is no path."""
    h = F.col(hops)
    return pairs.withColumn("bucket", F.explode(F.array_compact(F.array(F.when(h >= 4, "ge4"), F.when(h >= 8, "ge8"), F.when(h.isNull(), "no_path")))))


def coverage(views: DataFrame, sources: DataFrame, imports: DataFrame, packages: list[str]) -> DataFrame:
    """A5: (corpus, files, declarations, parsed, modules, internal_edges) of each corpus in ``sources``.

    ``views`` has a corpus and a parsed flag for each declaration. The last two are null
    where the corpus is not one package; an edge is internal if both ends are of one corpus.
    """
    files = sources.groupBy("corpus").agg(F.count("*").alias("files"))
    found = views.groupBy("corpus").agg(F.count("*").alias("declarations"), F.count_if("parsed").alias("parsed"))
    modules = sources.where(F.col("corpus").isin(packages)).select("corpus", "module").distinct()
    inside = imports.join(modules.toDF("corpus", "src"), "src").join(modules.toDF("corpus", "dst"), ["corpus", "dst"])
    nodes, edges = modules.groupBy("corpus").agg(F.count("*").alias("modules")), inside.groupBy("corpus").agg(F.count("*").alias("internal_edges"))
    graph = nodes.join(edges, "corpus", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.join(found, "corpus", "left").join(graph, "corpus", "left").select("corpus", "files", zero("declarations"), zero("parsed"), "modules", "internal_edges")


def top_in_degrees(modules: DataFrame, imports: DataFrame, k: int) -> DataFrame:
    """(module, in_degree) of the ``k`` most imported modules, names breaking ties."""
    return in_degrees(modules, imports).where("in_degree > 0").orderBy(F.desc("in_degree"), "module").limit(k)


def pair_distances(graphs: dict[str, tuple[DataFrame, DataFrame]], left: str, right: str) -> DataFrame:
    """(graph, hops) of a named pair under several graphs (modules, imports), such as naive and corrected scans.

    Null without a path, and where one of the two is no module of the graph.
    """
    out = None
    for name, (modules, imports) in graphs.items():
        row = pair_hops(modules, imports, left, right).select(F.lit(name).alias("graph"), "hops")
        out = row if out is None else out.union(row)
    return out
