"""Blocks, draws and counts of round 4 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpairs.functions import draws
from farpairs.operators import evaluate, graph, ranking, structural
from farpairs.operators import views as views_
from tests.test_structural import TEXTS


@pytest.fixture(scope="module")
def views(spark):
    rows = [(f"M{i % 5}", f"t{i}", "lemma", t, t, i) for i, t in enumerate(TEXTS * 2)]
    return structural.statement_views(spark.createDataFrame(rows, "module string, name string, kind string, statement string, raw_sig string, ordinal long"))


def test_partner_ranks_in_blocks(spark, monkeypatch, views):
    """F1, F8: queries against classes, block by block; no row for what a query and a class share."""
    names = [r["full_name"] for r in views.where("parsed").select("full_name").collect()]
    r = random.Random(4)
    frozen = spark.createDataFrame([(*r.sample(names, 2), None) for _ in range(30)], "old string, new string, since date")
    whole = sorted(map(str, structural.partner_ranks(views, frozen).collect()))
    monkeypatch.setattr(structural, "BLOCK", 3)
    assert sorted(map(str, structural.partner_ranks(views, frozen).collect())) == whole


def pick(head, draw, slot, n):
    return int(hashlib.md5(head + f"{draw}|{slot}".encode()).hexdigest()[:12], 16) % n


@pytest.mark.parametrize("head", [b"b|g|", b"b|" + b"x" * 53 + b"|", b"b|" + "é".encode() * 70 + b"|"])
def test_draws_by_many(monkeypatch, head):
    """the hashes of one message, of one and of several blocks."""
    monkeypatch.setattr(draws, "CHUNK", 64)
    for n in (1, 7, 120):
        flags = np.arange(n) % 3 == 0
        assert list(draws.resampled(head, flags, 5, 103)) == [sum(bool(flags[pick(head, d, s, n)]) for s in range(n)) for d in range(5, 103)]


def test_resamples_of_packed_flags(spark):
    """a row that a task reads has a bit for a flag, and one array of them stands for many draws."""
    r = random.Random(6)
    rows = [(g, k, r.random() < 0.3) for g, n in (("g", 150), (None, 70)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, at long, flag boolean")
    got = {x["g"]: (x["low"], x["mid"], x["high"]) for x in evaluate.bootstrap(df, "g", 60).collect()}
    for g, head in (("g", b"b|g|"), (None, b"b|")):
        own = [f for x, _, f in rows if x == g]
        means = sorted(sum(own[pick(head, d, s, len(own))] for s in range(len(own))) / len(own) for d in range(60))
        assert got[g] == pytest.approx((means[1], means[30], means[58]))
    plan = evaluate.bootstrap(df, "g")._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "md5" not in plan


def test_lookups_by_profiles(spark, monkeypatch, views):
    """profiles meet, and queries and places only at the end; gaps and fractions make no matches."""
    monkeypatch.setattr(structural, "LOOK_ROWS", 2)
    rows = [r for r in views.collect()]
    own = views.where("ordinal % 3 = 0 and parsed").withColumn("query", F.col("name"))
    # two declarations of one name in a corpus, and one query of two rows
    index = views.withColumn("corpus", F.col("module")).withColumn("name", F.when(F.col("name") == "t1", "t6").otherwise(F.col("name"))).withColumn("module", F.lit("m"))
    own = own.withColumn("query", F.when(F.col("name") == "t3", "t0").otherwise(F.col("name")))
    there, asks = index.collect(), own.collect()
    alike = lambda a, b: (a["digest"] or "") == (b["digest"] or "") or a["form"] is not None and a["form"] == b["form"]
    want = {(a["query"], b["corpus"], b["name"]) for a in asks for b in there if alike(a, b)}
    got = structural.lookup(own, index).collect()
    assert {(r["query"], r["corpus"], r["name"]) for r in got} == want and len(rows) > len(asks) > 3
    times = Counter(a["query"] for a in asks)
    assert Counter((r["query"], r["corpus"], r["name"]) for r in got) == {k: times[k[0]] for k in want}
    other = {k for k in want if k[0] != k[2]}
    assert {r[0] for r in structural.looked_up(own, index).collect()} == {k[0] for k in other}
    met = defaultdict(set)
    for q, c, _ in other:
        met[c].add(q)
    assert {r["corpus"]: r["fraction"] for r in structural.look_fractions(own, index).collect()} == pytest.approx({c: len(met[c]) / len(times) for c in {b["corpus"] for b in there}})


def test_classes_over_blocks_of_modules(spark, monkeypatch):
    """sizes, first pairs and draws without cells, over several blocks and words whose last bits count."""
    monkeypatch.setattr(graph, "BLOCK", 64)
    r = random.Random(12)
    modules = [f"m{i:03}" for i in range(200)]
    edges = [(modules[i], modules[i // 2]) for i in range(200) if i % 7]
    df, imports = spark.createDataFrame([(m,) for m in modules], "module string"), spark.createDataFrame(edges, "src string, dst string")
    index, levels = graph.packed(df, imports)
    hops = {(x["src"], x["dst"]): x["hops"] for x in graph.unpacked(index, levels).collect()}
    rows = [(f"{m}.t{i}#{i}", m, r.choice("aabcd")) for i, m in enumerate(r.choices(modules, k=260))] + [("m000.one#1", "m000", "alone")]
    stated = spark.createDataFrame(rows, "id string, module string, form string")
    by = defaultdict(list)
    for i, x in enumerate(rows):
        for y in rows[:i]:
            if x[2] == y[2] and x[1] != y[1]:
                h = hops.get((x[1], y[1]))
                for b in ["no_path"] if h is None else [b for b, least in (("ge4", 4), ("ge8", 8)) if h >= least]:
                    by[b].append((-(h or 0), min(x[0], y[0]), max(x[0], y[0])))
    assert set(by) == set(graph.BUCKETS)
    members = ranking.form_members(stated)
    got = ranking.class_buckets(members, index, levels).groupBy("bucket").agg(F.sum("n").alias("n"))
    assert {x["bucket"]: x["n"] for x in got.collect()} == {b: len(x) for b, x in by.items()}
    first = defaultdict(list)
    for x in sorted(ranking.farthest_pairs(stated, index, levels, 9).collect(), key=lambda x: x["rank"]):
        first[x["bucket"]].append((-(x["hops"] or 0), x["left"], x["right"]))
    assert first == {b: sorted(x)[:9] for b, x in by.items()}
    cells = ranking.form_cells(stated, index, levels)[0]
    draw = lambda df: sorted((x["bucket"], x["rank"], x["left"], x["right"]) for x in df.collect())
    assert draw(ranking.random_pairs(stated, index, levels, 20, "s")) == draw(ranking.random_form_pairs(stated, cells, 20, "s"))


def test_jaccard_by_lists(spark, monkeypatch):
    """Lists of numbers meet, in blocks where a constant is hot; no row for a meeting."""
    r = random.Random(15)
    deps = [(e * 7, f"c{min(int(r.expovariate(0.2)), 30)}") for e in range(40) for _ in range(r.randint(1, 9))] + [(e * 7, "all") for e in range(40)]
    df = spark.createDataFrame(deps, "entry long, constant string")
    held = defaultdict(set)
    for e, c in deps:
        held[c].add(e)
    idf = {c: np.log(40 / len(x)) for c, x in held.items()}
    own = {e: {c for x, c in deps if x == e and idf[c] > 0} for e in {e for e, _ in deps}}
    weigh = lambda s: sum(idf[c] for c in s)
    want = {(a, b): weigh(own[a] & own[b]) / weigh(own[a] | own[b]) for a in own for b in own if a < b and own[a] & own[b]}
    for postings, sent in ((2000, 500_000), (4, 0)):
        monkeypatch.setattr(views_, "POSTINGS", postings)
        monkeypatch.setattr(views_, "SENT", sent)
        got = views_.jaccard_pairs(df)
        assert {(x["left"], x["right"]): x["score"] for x in got.collect()} == pytest.approx(want) and got.count() == len(want)
    assert views_.jaccard_pairs(df, 0.3).count() == sum(s >= 0.3 - 1e-9 for s in want.values())
