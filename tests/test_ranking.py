"""Rankings by classes, packed hops, precision job, folds and blocks against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from farpairs.functions import statements as S
from farpairs.functions import text as T
from farpairs.operators import evaluate, graph, pairs, products, ranking, structural, views
from farpairs.tables import SCOPE, materialize, scope
from tests.test_structural import TEXTS, cosine, counts

MODULES = [f"M{i:02}" for i in range(14)]
#: A path of ten modules and a pair apart.
EDGES = [(f"M{i:02}", f"M{i + 1:02}") for i in range(9)] + [("M10", "M11"), ("M12", "M13"), ("M00", "M00"), ("M03", "Other")]


def bfs(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a in MODULES and b in MODULES:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for s in MODULES:
        seen, now, hops = {s: 0}, [s], 0
        while now:
            hops += 1
            now = [b for a in now for b in near[a] if b not in seen and not seen.update({b: hops})]
        out.update({(s, b): h for b, h in seen.items()})
    return out


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(m,) for m in MODULES], "module string"), spark.createDataFrame(EDGES, "src string, dst string")


@pytest.fixture(scope="module")
def packed(tree):
    return graph.packed(*tree)


@pytest.fixture(scope="module")
def stated(spark):
    r = random.Random(7)
    texts = [t for t in TEXTS if t is not None]
    rows = [(MODULES[r.randrange(14)], f"t{i}", r.choice(["theorem", "lemma", "lemma", "def"]), t, t, i) for i, t in enumerate(r.choice(texts) for _ in range(70))]
    return structural.statement_views(spark.createDataFrame(rows, "module string, name string, kind string, statement string, raw_sig string, ordinal long"))


def all_pairs(stated, kinds):
    rows = sorted((r for r in stated.collect() if kinds is None or r["kind"] in kinds), key=lambda r: r["id"])
    vectors = {x: counts(x) for x in {r["raw_sig"] for r in rows}}
    named = {x: counts(x, "named") for x in {r["raw_sig"] for r in rows}}
    out = []
    for a, b in itertools.combinations(rows, 2):
        if a["module"] != b["module"]:
            same = a["form"] is not None and a["form"] == b["form"]
            out.append((a, b, round(cosine(vectors[a["raw_sig"]], vectors[b["raw_sig"]]), 10), same, cosine(named[a["raw_sig"]], named[b["raw_sig"]])))
    return out


def buckets(h):
    return ["no_path"] if h is None else [b for b, k in (("ge4", 4), ("ge8", 8)) if h >= k]


def test_packed_hops(spark, tree, packed):
    want = bfs(EDGES)
    assert {(r["src"], r["dst"]): r["hops"] for r in graph.unpacked(*packed).collect()} == want
    every = spark.createDataFrame(list(itertools.product(MODULES, MODULES)), "left_module string, right_module string")
    assert all(r["hops"] == want.get((r["left_module"], r["right_module"])) for r in graph.hops_between(every, *packed).collect())
    some = tree[0].where("module in ('M00', 'M12')")
    assert {(r["src"], r["dst"], r["hops"]) for r in graph.distances(*tree, some, 3).collect()} == {(*k, h) for k, h in want.items() if k[0] in ("M00", "M12") and h <= 3}
    assert graph.pair_hops(*tree, "M01", "M04").first()[0] == 3 and graph.pair_hops(*tree, "M01", "M12").first()[0] is None and graph.pair_hops(*tree, "gone", "M12").first()[0] is None
    # more sources than one long holds
    big = spark.range(700).select(F.format_string("m%03d", "id").alias("module"))
    ring = spark.range(700).select(F.format_string("m%03d", "id").alias("src"), F.format_string("m%03d", (F.col("id") * 7 + 1) % 700).alias("dst"))
    met = graph.distances(big, ring, most=2).collect()
    near = defaultdict(set)
    for i in range(700):
        near[i].add((i * 7 + 1) % 700)
        near[(i * 7 + 1) % 700].add(i)
    for i in range(0, 700, 50):
        one, two = near[i] - {i}, {k for j in near[i] for k in near[j]} - near[i] - {i}
        assert {(r["dst"], r["hops"]) for r in met if r["src"] == f"m{i:03}"} == {(f"m{i:03}", 0)} | {(f"m{k:03}", 1) for k in one} | {(f"m{k:03}", 2) for k in two}


@pytest.mark.parametrize("k,first", [(10, 256), (200, 1)])
def test_structural_ranking(monkeypatch, stated, packed, k, first):
    """All pairs are in the order, near ones or not; looks at few class pairs first where they are few."""
    monkeypatch.setattr(ranking, "FIRST", first)
    want, hops = all_pairs(stated, ranking.THEOREMS), bfs(EDGES)
    low, high = min(p[2] for p in want), max(p[2] for p in want)
    by = defaultdict(list)
    for a, b, c, same, named in want:
        primary = ((c - low) / (high - low) + same) / 2
        for bucket in buckets(hops.get((a["module"], b["module"]))):
            by[bucket].append((-round(primary, 8), -same, a["id"], b["id"], round(c, 8), round(named, 8), a["module"], b["module"]))
    got = defaultdict(list)
    for r in sorted(ranking.structural_ranking(stated, *packed, k).collect(), key=lambda r: (r["bucket"], r["rank"])):
        got[r["bucket"]].append((-round(r["primary"], 8), -r["same_form"], r["left"], r["right"], round(r["cosine"], 8), round(r["named_cosine"], 8), r["left_module"], r["right_module"]))
    assert set(got) == set(by)
    for b in by:
        assert got[b] == sorted(by[b])[:k]


def test_structural_pair_rank(stated):
    want = sorted(all_pairs(stated, ranking.THEOREMS), key=lambda p: (-p[3], -p[2], p[0]["id"], p[1]["id"]))
    for at in (0, 3, len(want) // 3, len(want) // 2, len(want) - 1):
        a, b, c, same, _ = want[at]
        got = ranking.structural_pair_rank(stated, a["id"], b["id"]).first()
        assert (got["rank"], got["of"], round(got["cosine"], 9), got["same_form"]) == (at + 1, len(want), round(c, 9), same)
    none = ranking.structural_pair_rank(stated, "gone", want[0][0]["id"]).first()
    assert none["rank"] is None and none["of"] == len(want)


def test_blocks_of_classes(monkeypatch, stated, packed):
    whole = ranking.structural_ranking(stated, *packed, 10).collect()
    monkeypatch.setattr(ranking, "BLOCK", 4)
    monkeypatch.setattr(products, "COLUMNS", 7)
    key = lambda r: (r["bucket"], r["rank"])
    assert sorted(whole, key=key) == sorted(ranking.structural_ranking(stated, *packed, 10).collect(), key=key)


def test_form_ranking_and_random(stated, packed):
    hops = bfs(EDGES)
    by = defaultdict(list)
    for a, b, c, same, _ in all_pairs(stated, None):
        if same:
            for bucket in buckets(hops.get((a["module"], b["module"]))):
                by[bucket].append((-c, a["id"], b["id"]))
    got = defaultdict(list)
    for r in sorted(ranking.form_ranking(stated, *packed, 12).collect(), key=lambda r: (r["bucket"], r["rank"])):
        got[r["bucket"]].append((-round(r["cosine"], 10), r["left"], r["right"]))
    assert dict(got) == {b: sorted(x)[:12] for b, x in by.items()}
    cells, _ = ranking.form_cells(stated, *packed)
    assert {r["bucket"]: r["n"] for r in cells.groupBy("bucket").agg(F.sum("n").alias("n")).collect()} == {b: len(x) for b, x in by.items()}
    small, large = ({b: [(r["left"], r["right"]) for r in sorted(ranking.random_form_pairs(stated, cells, k, "s").where(F.col("bucket") == b).collect(), key=lambda r: r["rank"])] for b in by} for k in (3, 1000))
    for b in by:
        assert sorted(large[b]) == sorted((x, y) for _, x, y in by[b]) and small[b] == large[b][:3]


def test_precision_report(spark, stated, packed):
    import datetime

    ranked = sorted(ranking.form_ranking(stated, *packed, 10).where("bucket = 'ge4'").collect(), key=lambda r: r["rank"])
    name = lambda x: x.split("#")[0]
    hits = {0: "2026-01-20", 2: "2026-03-05", 3: "2025-12-31"}
    links = spark.createDataFrame([(name(ranked[k]["right"]), name(ranked[k]["left"]), datetime.date.fromisoformat(d)) for k, d in hits.items()], "old string, new string, since date")
    out = {(r["bucket"], r["months"], r["k"], r["source"]): r for r in ranking.precision_report(stated, *packed, links, "2026-01-01", [1, 3], ks=[2, 10]).collect()}
    n = len(ranked)
    assert out["ge4", 1, 2, "ranked"]["precision"] == 0.5 and out["ge4", 1, 10, "ranked"]["precision"] == pytest.approx(1 / n) and out["ge4", 3, 10, "ranked"]["precision"] == pytest.approx(2 / n)
    assert out["ge4", 3, 10, "ranked"]["low"] <= 2 / n <= out["ge4", 3, 10, "ranked"]["high"] and ("ge4", 3, 10, "random") in out


@pytest.mark.parametrize("pair", [(0, 1), (2, 9), (5, 30), (7, 8), (1, 40)])
def test_text_pair_rank(spark, pair):
    r = random.Random(11)
    words = [f"term{c}x" for c in "abcdefghij"]
    docs = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(10)], k=r.randint(2, 7))), f"m{r.randrange(4)}") for i in range(45)]
    docs += [(100 + i, t, m) for i, t, m in docs[:9]] + [(200, "", "m0")]
    df = spark.createDataFrame(docs, "doc long, text string, module string")
    w = materialize(views.weights(df.select("doc", "text")))
    by = defaultdict(dict)
    for x in w.collect():
        by[x["doc"]][x["term"]] = x["w"]
    module = {i: m for i, _, m in docs}
    scored = [(round(s, 6), a, b) for a, b in itertools.combinations(sorted(module), 2) if module[a] != module[b] and (s := sum(x * by[b].get(t, 0) for t, x in by[a].items())) > 0.25]
    order = sorted(scored, reverse=True)
    chosen = pair if any(p[1:] == pair for p in order) else order[pair[1] % len(order)][1:]
    got = ranking.text_pair_rank(w, df.select("doc", "module"), *chosen).first()
    at = next(k for k, p in enumerate(order) if p[1:] == chosen)
    assert (got["rank"], got["of"], round(got["score"], 6)) == (at + 1, len(order), order[at][0])
    assert ranking.text_pair_rank(w, df.select("doc", "module"), 0, 200).first()["rank"] is None


def test_meetings_in_blocks(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b"]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, doc long")
    sized = df.join(df.groupBy("k").agg(F.count("*").alias("n")), "k")
    for block in (4, 1000):
        got = Counter((x["k"], x["l_doc"], x["r_doc"]) for x in views.meetings(sized, "k", "doc", "n", block).collect())
        assert got == Counter((a, i, j) for a, i in rows for b, j in rows if a == b and i < j)


def test_cosines_in_blocks(spark, monkeypatch):
    r = random.Random(8)
    docs = {i: {f"t{k}": r.random() for k in r.sample(range(30), r.randint(0, 6))} for i in range(40)}
    df = spark.createDataFrame([(i, t, w) for i, x in docs.items() for t, w in x.items()], "doc long, term string, w double")
    modules = spark.createDataFrame([(i, f"m{i % 3}") for i in docs], "doc long, module string")
    want = {(i, j): s for i, j in itertools.combinations(docs, 2) if i % 3 != j % 3 and (s := sum(w * docs[j].get(t, 0) for t, w in docs[i].items())) > 0.4}
    for block in (7, 1024):
        monkeypatch.setattr(views, "BLOCK", block)
        got = views.cosine_pairs(df, modules, 0.4).collect()
        assert {(x["left"], x["right"]): x["score"] for x in got} == pytest.approx(want) and len(got) == len(want) > 20


def test_jaccard_from_a_score(spark):
    r = random.Random(5)
    deps = [(e, f"c{min(int(r.expovariate(0.25)), 25)}") for e in range(30) for _ in range(r.randint(1, 9))]
    df = spark.createDataFrame(deps, "entry long, constant string")
    every = {(x["left"], x["right"]): x["score"] for x in views.jaccard_pairs(df).collect()}
    for least in (0.05, 0.3, 0.8):
        got = {(x["left"], x["right"]): x["score"] for x in views.jaccard_pairs(df, least).collect()}
        assert got == pytest.approx({k: v for k, v in every.items() if v >= least - 1e-9})
    n = df.select("entry").distinct().count()
    whole = {p: round(every.get(p, 0.0), 6) for p in itertools.combinations(range(30), 2)}
    for p in ((0, 1), (3, 17), (28, 29)):
        row = views.dependency_pair_rank(df, *p).first()
        assert (row["rank"], row["of"]) == (1 + sum((v, *q) > (whole[p], *p) for q, v in whole.items()), n * (n - 1) // 2)


def test_kernel_on_tables(spark, stated):
    """Labels of tables are equal just where those of arrays are."""
    one = stated.where("parsed").dropDuplicates(["digest"]).select("digest", "free", "near")
    arrays = {(r["digest"], k, i): r["l"][k * len(r["free"]) + i] for r in one.select("digest", "free", S.kernel_labels(F.col("free"), F.col("near")).alias("l")).collect() for k in range(4) for i in range(len(r["free"]))}
    nodes = one.select(F.col("digest").alias("doc"), F.posexplode("free").alias("node", "label"))
    edges = one.select(F.col("digest").alias("doc"), F.posexplode("near").alias("node", "x")).select("doc", "node", F.explode("x").alias("e")).select("doc", "node", "e.edge", "e.to")
    tables = {(r["doc"], r["round"], r["node"]): f"r{r['round']}:{r['label']}" for r in S.kernel_rounds(nodes, edges).collect()}
    assert tables.keys() == arrays.keys() and len(arrays) > 200
    assert len(set(zip(tables.values(), (arrays[k] for k in tables)))) == len(set(tables.values())) == len(set(arrays.values()))


def test_resampling_in_a_fold(spark):
    rows = [("g", k, k % 3 == 0) for k in range(7)] + [("h", 0, True)]
    got = {r["g"]: (r["low"], r["mid"], r["high"]) for r in evaluate.bootstrap(spark.createDataFrame(rows, "g string, at long, flag boolean"), "g", 100).collect()}
    pick = lambda g, d, s, n: int(hashlib.md5(f"b|{g}|{d}|{s}".encode()).hexdigest()[:12], 16) % n
    means = sorted(sum(pick("g", d, s, 7) % 3 == 0 for s in range(7)) / 7 for d in range(100))
    assert got["g"] == pytest.approx((means[2], means[50], means[97])) and got["h"] == (1.0, 1.0, 1.0)
    out = [("g", i, s, rank) for i, (s, rank) in enumerate([("ranked", 1), ("ranked", 11), ("unparsed", None), ("missing", None)])]
    one = evaluate.recall_bootstrap(spark.createDataFrame(out, "g string, id long, status string, rank long"), "g", "id").first()
    assert one["evaluated"] == 3 and one["recall"] == pytest.approx(1 / 3)


def strip_all(s):
    out, depth, i = [], 0, 0
    while i < len(s):
        if not depth and s.startswith("--", i):
            i = s.find("\n", i) if "\n" in s[i:] else len(s)
        elif s.startswith("/-", i):
            depth, i = depth + 1, i + 2
        elif depth and s.startswith("-/", i):
            depth, i = depth - 1, i + 2
        else:
            out += [s[i]] if not depth or s[i] == "\n" else []
            i += 1
    return "".join(out)


def strip_lines(s):
    def one(line):
        for i in range(len(line) - 1):
            if line[i : i + 2] == "--" and (not i or line[i - 1] not in "/-") and line[i + 2 : i + 3] != "-":
                return line[:i]
        return line

    return "\n".join(map(one, s.split("\n")))


def test_comments_on_random_texts(spark):
    r = random.Random(9)
    made = ["".join(r.choices("-/a\n ", [4, 3, 2, 1, 1], k=r.randint(0, 30))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in made] + [(None,)], "t string").select("t", T.without_comments(F.col("t")).alias("a"), T.without_line_comments(F.col("t")).alias("b"))
    assert "Python" not in df._jdf.queryExecution().toString()
    for x in df.collect():
        assert (x["a"], x["b"]) == ((strip_all(x["t"]), strip_lines(x["t"])) if x["t"] is not None else (None, None)), x["t"]


def test_names(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    replaced = {'new.name (since := "2026-01-01")': "new.name", '"say so" (since := "x") foo\'': "foo'", 'since := "x", bar': "bar", "(since := old) bar": "bar", "since": "since", '"x"': None, "(since := a, b) c": "c", "": None, "[x] y": "x"}
    for text, name in replaced.items():
        assert one(T.replacement_name, text) == name, text
    explicit = {"(attr := simp, to_additive) dite_smul": "dite_smul", "(attr := simp) (attr := x) a.b": "a.b", "/-- a doc -/ c": "c", "attr": "attr", "(attr := simp)": None, " _x'": "_x'"}
    for text, name in explicit.items():
        assert one(T.explicit_name, text) == name, text
    for text, name in {"MulOneClass": "AddZeroClass", "mulABC": "addABC", "AB2mul": "AB2mul", "HMul.h_Mul": "HAdd.h_Add", "é_mul": "é_add", "mul.": "add.", "_mul__one": "_add__zero", "smul_Semigroup": "vadd_AddSemigroup"}.items():
        assert one(T.additive_name, text) == name, text


def test_lookup_with_cosine(spark, stated):
    own = stated.withColumn("query", F.col("id"))
    got = structural.lookup(own, stated.withColumn("corpus", F.lit("k"))).collect()
    rows = {r["id"]: r for r in stated.collect()}
    full = defaultdict(list)
    for r in rows.values():
        full[r["module"], r["name"]].append(r)
    want = {(a["id"], b["module"], b["name"]) for a in rows.values() for b in rows.values() if a["digest"] == b["digest"] or a["form"] is not None and a["form"] == b["form"]}
    assert {(r["query"], r["module"], r["name"]) for r in got} == want
    for r in got:
        a, b = rows[r["query"]], full[r["module"], r["name"]][0]
        assert r["via"] == ("exact_digest" if a["digest"] == b["digest"] else "normal_form") and r["cosine"] == pytest.approx(cosine(counts(a["raw_sig"]), counts(b["raw_sig"])))


def test_scopes(spark):
    import pathlib

    base = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    with scope(spark) as name:
        materialize(spark.range(3))
        with scope(spark) as inner:
            assert materialize(spark.range(3)).count() == 3 and inner.startswith(name) and (base / inner).exists()
        assert not (base / inner).exists() and len(list((base / name).iterdir())) == 1
    assert not (base / name).exists() and spark.conf.get(SCOPE) == ""


def test_hubs_by_degree(spark):
    names = [f"h{i:02}" for i in range(20)]
    edges = [(a, b) for k, b in enumerate(names[:8]) for a in names[: 3 + k % 3]]
    modules, imports = spark.createDataFrame([(n,) for n in names], "module string"), spark.createDataFrame(edges, "src string, dst string")
    degree = Counter(b for _, b in edges)
    for fraction in (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 1.0):
        kept, left = graph.without_hubs(modules, imports, fraction)
        gone = sorted(names, key=lambda n: (-degree[n], n))[: round(fraction * 20)]
        assert sorted(r[0] for r in kept.collect()) == sorted(set(names) - set(gone))
        assert left.count() == sum(a not in gone and b not in gone for a, b in edges)


def test_empty_tables(spark, stated, packed):
    none = stated.where("false")
    assert ranking.structural_ranking(none, *packed).count() == 0 and ranking.form_ranking(none, *packed).count() == 0
    assert pairs.class_pairs(stated.where("false").select("form", F.col("id").alias("full_name"), "module")).count() == 0
    assert graph.distances(spark.createDataFrame([], "module string"), spark.createDataFrame([], "src string, dst string")).count() == 0
