import datetime

from pyspark.sql import functions as F

from farpairs.functions import text as T
from farpairs.operators import evaluate, extract, graph, pairs, views
from farpairs.sources import trees


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_comments(spark):
    assert one(spark, T.without_line_comments, "a -- b\nc /-- doc -/ d") == "a \nc /-- doc -/ d"
    assert one(spark, T.without_comments, "a /- x /- y -/ z\n-/ b -- c\nd").split() == ["a", "b", "d"]


def test_names(spark):
    assert one(spark, T.additive_name, "comp_mul_left") == "comp_add_left" and one(spark, T.additive_name, "HMul") == "HAdd"
    assert one(spark, T.explicit_name, " (attr := simp, to_additive) dite_smul") == "dite_smul" and one(spark, T.explicit_name, "") is None
    assert [one(spark, T.is_instance, x) for x in ("instOfNatNat", "Rat.instField", "HPow.hPow", "Neg.neg")] == [True, True, False, False]
    fits = lambda m: one(spark, lambda v: T.module_matches(v, F.lit("PaleyZygmund")), m)
    assert fits("A.PaleyZygmund") and not fits("A.MeasurePaleyZygmund")


def test_bridge_and_tokens(spark):
    moved = one(spark, T.across_bridge, "(n : X) : IsSquare (-1 :  ZMod n.markovNumber.natAbs)")
    assert "ZMOD n.markovNumber" in moved and "IsSquare" not in moved and one(spark, T.across_bridge, "a = b") is None
    assert one(spark, T.tokens, "theorem isSquare_neg_one (XMLParser2) x² -1") == ["square", "neg", "one", "xml", "parser", "sq", "negone"]
    assert "∀" not in one(spark, T.one_spaced, " a \n b ") and one(spark, T.one_spaced, " a  \n b ") == "a b"


def test_extraction(spark):
    text = "/- import Hidden.X\nimport Hidden.Y -/\npublic import Pkg.B\n/-- doc -/\ntheorem a (x : N) : x = x := rfl\nprivate theorem b : 1 = 1 := rfl\nprivate noncomputable def c : N := 1\n"
    src = spark.createDataFrame([("k", "Pkg.A", "A", text), ("k", "Pkg.B", "B", "")], "corpus string, module string, path string, text string")
    assert [tuple(r) for r in extract.imports(src).collect()] == [("Pkg.A", "Pkg.B")]
    found = {r["name"]: r["docstring"] for r in extract.declarations(src).collect()}
    assert found == {"a": "doc", "c": ""}
    blank = {r["name"]: r["docstring"] for r in extract.declarations(src, blank_comments=True).collect()}
    assert blank["a"] == ""


def test_windows_and_precision(spark):
    rows = spark.createDataFrame([(1, datetime.date(2026, 2, 16)), (2, datetime.date(2026, 3, 16)), (3, datetime.date(2027, 2, 16))], "k int, since date")
    got = sorted(tuple(r) for r in evaluate.windows(rows, "2026-02-16").select("k", "months").collect())
    assert got == [(2, 1), (2, 3), (2, 6), (2, 12), (3, 12)]
    ranked = spark.createDataFrame([("b", 1, True), ("b", 2, False), ("b", 3, False)], "bucket string, rank int, flag boolean")
    assert {round(r["precision"], 6) for r in evaluate.precision_at(ranked, ["bucket"]).collect()} == {0.333333}


def test_graph_and_classes(spark):
    modules = spark.createDataFrame([(x,) for x in "abcdef"], "module string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "zz"), ("a", "b")], "src string, dst string")
    hops = {(r[0], r[1]): r[2] for r in graph.distances(modules, edges).collect()}
    assert hops["a", "e"] == hops["e", "a"] == 4 and hops["f", "f"] == 0 and ("a", "f") not in hops
    views = spark.createDataFrame([("x1", "a", "F"), ("x2", "e", "F"), ("x3", "f", "F"), ("x4", "a", "F"), ("x5", "a", None)], "full_name string, module string, form string")
    found = graph.bucketed(pairs.with_hops(pairs.class_pairs(views), graph.distances(modules, edges))).select("left", "right", "bucket").collect()
    assert {tuple(r) for r in found} == {("x1", "x2", "ge4"), ("x2", "x4", "ge4"), ("x1", "x3", "no_path"), ("x2", "x3", "no_path"), ("x3", "x4", "no_path")}
    whole = sorted(map(tuple, pairs.class_pairs(views).collect()))
    assert sorted(map(tuple, pairs.class_pairs(views, block_rows=1).collect())) == whole and len(whole) == 5
    assert sorted(map(tuple, pairs.class_module_pairs(views).collect())) == [("a", "e", 2), ("a", "f", 2), ("e", "f", 1)]


def test_pairs_of_score_zero(spark):
    deps = spark.createDataFrame([(1, "a"), (1, "z"), (2, "b"), (3, "a"), (3, "b"), (4, "c"), (5, "c"), (5, "b")], "entry long, constant string")
    found = views.jaccard_pairs(deps)
    score = {(r["left"], r["right"]): r["score"] for r in found.collect()}
    ordered = sorted(((score.get((i, j), 0.0), i, j) for i in range(1, 6) for j in range(i + 1, 6)), reverse=True)
    assert 0 < len(score) < len(ordered)
    for at, (s, i, j) in enumerate(ordered, 1):
        assert [tuple(r) for r in views.pair_rank(found, deps.select("entry").distinct(), i, j).collect()] == [(at, 10, s)]
    assert [tuple(r) for r in views.pair_rank(found, deps.select("entry").distinct(), 1, 9).collect()] == [(None, 10, None)]
    normed = {(r["left"], r["right"]): r["score_norm"] for r in pairs.min_max(found, "score", 10).collect()}
    assert normed == {k: s / max(score.values()) for k, s in score.items()}
    assert min(r["score_norm"] for r in pairs.min_max(found, "score").collect()) == 0


def test_sources(spark, tmp_path):
    (tmp_path / "Pkg" / "Sub").mkdir(parents=True)
    (tmp_path / "Pkg" / "Sub" / "A.lean").write_text("theorem a :\n x := y")
    (tmp_path / "obs").mkdir()
    for k, h in (("1", "old"), ("2", "new")):
        (tmp_path / "obs" / f"{k}.json").write_text('{"report":{"observed":{"entrypoints":{"e":{"statement_sha256":"' + h + '","type_dependencies":["x","x"]}}}}}')
    read = trees.read_tree(spark, str(tmp_path), "k", "Pkg").collect()
    assert [(r["module"], r["text"]) for r in read] == [("Pkg.Sub.A", "theorem a :\n x := y")]
    assert [tuple(r) for r in trees.read_observations(spark, f"{tmp_path}/obs/*.json").collect()] == [("e", "new", ["x"])]
    (tmp_path / "r.md").write_text("## far\n| 1 | `a` | `b` |\n\n## near\n| 1 | `c` | `d` |\n")
    assert [tuple(r) for r in trees.read_ranking(spark, f"{tmp_path}/r.md", "far").collect()] == [("a", "b")]
