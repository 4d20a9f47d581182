"""Statement views, structural pairs, partner ranks and controls against brute force."""

import datetime
import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from farpairs.functions import statements as S
from farpairs.functions import text as T
from farpairs.operators import evaluate, extract, graph, pairs, structural
from farpairs.sources import trees

SQUARE = " (n : OrientedNode) :\n    IsSquare (-1 : ZMod n.markovNumber.natAbs) "
CONGRUENCE = " (n : OrientedNode) :\n    ∃ r : ℤ, r ^ 2 ≡ -1 [ZMOD n.markovNumber] "
TEXTS = [
    SQUARE, CONGRUENCE, "(a b : ℕ) : a + b = b + a", "(x y : ℕ) : x + y = y + x", "(x y : ℕ) : x * y = y * x", "(h : p ∣ q) : p ≤ q", "(h : p ∣ q) : p ≤ q", "{G : Type*} [Group G] (a : G) : a⁻¹⁻¹ = a",
    "{H : Type*} [Group H] (b : H) : b⁻¹⁻¹ = b", "∀ x : ℝ, f x = 0 → g x = 0", "∀ y : ℝ, f y = 0 → g y = 0", "(l : List ℕ) : l[0] = l[0]", "(f : ℕ → ℕ) : ∑ i ∈ s, f i = 0", None, "", "(n : ℤ) : ∃ r : ℤ, r ^ 2 ≡ -1 [ZMOD n]", "(m : ℤ) : IsSquare (-1 : ZMod m.natAbs)",
]


def counts(text, labels="free"):
    parsed, _, _, free, named, near = S.read(text)
    if not parsed:
        return Counter({"unparsed:" + hashlib.sha256(" ".join(text.split()).encode()).hexdigest(): 1}) if text is not None else Counter()
    now = free if labels == "free" else named
    out = Counter(f"r0:{x}" for x in now)
    for k in range(1, 4):
        now = [hashlib.md5((x + "|" + ",".join(sorted(f"{e['edge']}:{now[e['to']]}" for e in near[i]))).encode()).hexdigest() for i, x in enumerate(now)]
        out.update(f"r{k}:{x}" for x in now)
    return out


def cosine(a, b):
    dot = sum(n * b[x] for x, n in a.items())
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


@pytest.fixture(scope="module")
def decls(spark):
    rows = [(f"M{i % 5}", f"t{i}", "lemma" if i % 4 else "theorem", t, t, i) for i, t in enumerate(TEXTS)]
    rows.append(("M0", "t0", "theorem", CONGRUENCE, CONGRUENCE, 99))  # a later declaration of one name
    return spark.createDataFrame(rows, "module string, name string, kind string, statement string, raw_sig string, ordinal long")


@pytest.fixture(scope="module")
def views(decls):
    return structural.statement_views(decls)


def test_golden_values(views):
    rows = {r["id"]: r for r in views.collect()}
    a, b = rows["M0.t0#0"], rows["M1.t1#1"]
    assert a["form"] == b["form"] and "[ZMOD v0.markovNumber]" in a["form"] and "IsSquare" not in a["form"] and a["digest"] != b["digest"]
    assert a["proposition"] == "∀ (n : OrientedNode), IsSquare (-1 : ZMod n.markovNumber.natAbs)"
    assert not rows["M0.t5#5"]["parsed"] and not rows["M3.t13#13"]["parsed"] and not rows["M4.t14#14"]["parsed"]
    assert rows["M2.t2#2"]["form"] == rows["M3.t3#3"]["form"] != rows["M4.t4#4"]["form"]
    assert cosine(counts(SQUARE), counts(CONGRUENCE)) == pytest.approx(0.42521003213538067) and cosine(counts(SQUARE, "named"), counts(CONGRUENCE, "named")) == pytest.approx(0.28)


@pytest.mark.parametrize(
    "text,form",
    [
        ("∃ x y, x = y", None), ("∃ x ∈ s, x = x", None), ("a = b = c", None), ("a ^ 2 ^ 3", None), ("(a : b", None), ("(" * 3000, None), ("a ≡ b [MOD 3]", "a ≡ b[MOD 3]"), ("(x) : x = ()", "(v0) : v0 = Unit"),
        ("(a b c : N) : a * (b + c) = a - b - c", "(v0 : N) (v1 : N) (v2 : N) : v0 * v1 + v2 = v0 - v1 - v2"), ("-a ^ 2 + f x (g y)", "-a ^ 2 + f x (g y)"), ("p ↔ q → r ∧ s", "p ↔ q → r ∧ s"),
        ("∏ i, f i", "∏ v0, f v0"), ("(s : Set A) : ∀ x : A, x ∉ s ∨ fun y => y", "(v0 : Set A) : ∀ v1 : A, v1 ∉ v0 ∨ fun v2 => v2"), ("[Ring R] : 2 < x.y.z", "(v0 : Ring R) : 2 < x.y.z"), ("(x : A) [Ring R] : 2 < x.y.z", "(v0 : A) (v1 : Ring R) : 2 < v0.y.z"),
        ("a ≡ b [ZMOD n.natAbs]", "a ≡ b [ZMOD n.natAbs]"), ("(n : ℤ) : a ≡ b [ZMOD n.natAbs]", "(v0 : ℤ) : a ≡ b [ZMOD v0]"), ("f →+* g →+* h = Sort*", "f →+* g →+* h = Sort*"),
    ],
)
def test_reading(text, form):
    assert S.read(text)[1] == form


def test_features(views):
    for labels in ("free", "named"):
        got: dict = {}
        for r in S.features(views.select("id", "digest", F.col(labels).alias("l"), "near"), "l").collect():
            got.setdefault(r["id"], {})[r["feature"]] = r["n"]
        for i, t in enumerate(TEXTS):
            assert got.get(f"M{i % 5}.t{i}#{i}", {}) == dict(counts(t, labels))


def test_structural_pairs(views):
    rows = {r["id"]: r for r in views.collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a < b and rows[a]["module"] != rows[b]["module"]:
                c = cosine(counts(rows[a]["raw_sig"]), counts(rows[b]["raw_sig"]))
                same = rows[a]["form"] is not None and rows[a]["form"] == rows[b]["form"]
                if c > 0.3 or same:
                    want[a, b] = (round(c, 9), round(cosine(counts(rows[a]["raw_sig"], "named"), counts(rows[b]["raw_sig"], "named")), 9), same)
    found = structural.structural_pairs(views, 0.3)
    got = {(r["left"], r["right"]): (round(r["cosine"], 9), round(r["named_cosine"], 9), r["same_form"]) for r in found.collect()}
    assert got == want and len(want) > 10
    top = max(c for c, _, _ in want.values())
    first = found.orderBy(*structural.ranking_order()).collect()
    assert [r["primary"] for r in first] == pytest.approx(sorted(((c / top + s) / 2 for c, _, s in want.values()), reverse=True))


def test_partner_ranks(spark, views):
    names = [f"M{i % 5}.t{i}" for i in range(len(TEXTS))]
    frozen = [(a, b, datetime.date(2026, 1, 1)) for a, b in [(0, 1), (2, 3), (2, 4), (4, 2), (7, 8), (7, 9), (9, 11), (5, 6), (15, 16), (16, 0), (12, 2)]]
    table_ = spark.createDataFrame([(names[a], names[b], d) for a, b, d in frozen] + [("M0.gone", names[1], None)], "old string, new string, since date")
    got = {(r["old"], r["new"]): (r["status"], r["rank"]) for r in structural.partner_ranks(views, table_).collect()}
    rows = [(r["id"], r["full_name"], r["raw_sig"], r["form"], r["parsed"], r["ordinal"]) for r in views.collect()]
    last = {r[1]: r for r in sorted(rows, key=lambda r: r[5])}
    for a, b, _ in frozen:
        x, y = last[names[a]], last[names[b]]
        if not (x[4] and y[4]):
            assert got[names[a], names[b]] == ("unparsed", None)
            continue
        own = cosine(counts(x[2]), counts(y[2]))
        others = [r for r in rows if r[4] and r[0] not in (x[0], y[0])]
        inside = [r for r in others if r[3] == x[3]]
        above = lambda rs: sum(cosine(counts(x[2]), counts(r[2])) > own + 1e-12 for r in rs)  # noqa: E731, B023
        rank = 1 + above(inside) if y[3] == x[3] else 1 + len(inside) + above([r for r in others if r[3] != x[3]])
        assert got[names[a], names[b]] == ("ranked", rank)
    assert got["M0.gone", names[1]] == ("missing", None)
    one = evaluate.random_recall(views.withColumn("of", F.lit(1)), ["of"]).first()
    assert one["random_recall"] == pytest.approx(10 / (one["parsed"] - 1))


def test_additive_controls(spark):
    src = """@[to_additive add_c]\ntheorem mul_c (a b : G) : a * b = b * a := by simp
theorem add_c (x y : G) : x + y = y + x := by simp
theorem add_d (x y : G) : y + x = x + y := by simp
@[to_additive]\nlemma mul_e (a : G) : a / a = one := by simp
lemma add_e (a : G) : a - a = zero := by simp
@[to_additive (attr := simp) gone]\nlemma mul_f (a : G) : a = a := rfl
@[to_additive add_h]\ninstance mul_h : Group G := x
@[to_additive add_i]\nprivate theorem mul_i (a : G) : a = a := rfl
@[to_additive]\ntheorem plain (a : G) : a = a := rfl
@[to_additive not_alike]\ntheorem mul_j (a : G) : a = a := rfl
theorem not_alike (a : G) : a = a + a := rfl
"""
    sources = spark.createDataFrame([("k", "P.A", "A", src), ("k", "P.B", "B", "theorem add_e (n : N) : n = n := rfl\n")], "corpus string, module string, path string, text string")
    views = structural.statement_views(extract.declarations(sources))
    attributes = extract.additive_attributes(sources)
    ranks = structural.additive_ranks(attributes, views)
    got = {r["name"]: (r["resolved"], r["rank"]) for r in ranks.collect()}
    assert got == {"mul_c": (True, 1), "mul_e": (True, 1), "mul_f": (False, None), "plain": (False, None), "mul_j": (True, None)}
    one = structural.additive_controls(attributes, ranks).first()
    assert (one["status"], one["attributes"], one["instances_excluded"], one["private_excluded"], one["denominator"], one["resolved"], one["recovered_1"]) == ("measured", 7, 1, 1, 5, 3, 2)
    assert one["recall_10"] == pytest.approx(0.4) and one["ranked_recall_10"] == 1.0
    none = structural.additive_controls(attributes.where("false"), ranks.where("false")).first()
    assert none["status"] == "absent" and none["recall_1"] is None


def test_found_by_name(spark):
    decls = spark.createDataFrame([("A.X", "f", 1), ("B.X", "f", 2), ("B.Y", "g", 3), ("C", "h", 4), ("D", "h", 5), ("C", "X.k", 6)], "module string, name string, id long")
    asked = spark.createDataFrame([("f", "A.X"), ("f", "Z"), ("B.X.f", "Z"), ("X.f", "B.X"), ("Q.g", "Z"), ("h", "D"), ("k", "C"), ("none", "C")], "name string, module string")
    got = {(r["name"], r["module"]): r["id"] for r in structural.found_by_name(asked, decls).collect()}
    assert got == {("f", "A.X"): 1, ("f", "Z"): None, ("B.X.f", "Z"): 2, ("X.f", "B.X"): 2, ("Q.g", "Z"): 3, ("h", "D"): 5, ("k", "C"): None, ("none", "C"): None}


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_propositions(spark):
    said = lambda x: one(spark, T.textual_proposition, x)
    assert said("(a : N)  {b : M} :\n a = b") == "∀ (a : N) {b : M}, a = b" and said(" : x = y ") == "x = y" and said("x ∣ y") == "x ∣ y"
    assert said("(a : N) : ") is None and said(" \n") is None and said(") : (x : y)") == "∀ ), (x : y)" and said("a : b : c") == "∀ a : b, c" and said(None) is None
    goal = lambda x: one(spark, lambda v: S.goal(S.statement_view(v)["proposition"], v), x)
    assert goal("(a : N) : a = a") == "∀ (a : N), a = a" and goal("(a : N) : a ∣ a") == "∀ (a : N), a ∣ a" and goal("(x) : x = x") == "∀ (x), x = x"


def test_strings_that_were_read_wrongly(spark):
    assert one(spark, T.additive_name, "mul2_one") == "mul2_zero" and one(spark, T.additive_name, "Mul.oneX_SMul") == "Add.zeroX_SAdd" and one(spark, T.additive_name, "Smul_Group") == "Vadd_AddGroup"
    assert one(spark, T.without_comments, "/- foo --/ import A\nimport B") == " import A\nimport B" and one(spark, T.without_comments, "a -- /- b\nc") == "a \nc" and one(spark, T.without_comments, "x /- open") == "x "
    moved = lambda x: one(spark, T.across_bridge, x)
    assert moved("h exists_sq_modEq_neg_one_markovNumber exists_sq_modEq_neg_one_markovNumber") == "h isSquare_neg_one_mod_markovNumber exists_sq_modEq_neg_one_markovNumber"
    assert moved("a.exists_sq_modEq_neg_one_markovNumber") is None and moved("exists_sq_modEq_neg_one_markovNumberx") is None
    src = lambda *texts: spark.createDataFrame([("k", f"M{i}", "", t) for i, t in enumerate(texts)], "corpus string, module string, path string, text string")
    decl = extract.declarations(src("/-- two\nlines\n-/\n@[simp] protected theorem a  (x : N) :\n  x = x  := rfl\nprivate noncomputable def b : N := 1\nnoncomputable private def c : N := 1\ndef d where\n  x := 1\nabbrev e : N\n  | 0 => 1\n")).collect()
    assert [(r["name"], r["kind"], r["statement"], r["docstring"]) for r in decl] == [("a", "theorem", "(x : N) :\n  x = x", "two\nlines"), ("b", "def", ": N", ""), ("d", "def", "", ""), ("e", "abbrev", ": N", "")]
    assert [r["name"] for r in extract.declarations(src("private noncomputable def b : N := 1\n"), strict_private=True).collect()] == []
    dep = src('@[deprecated new (since := "2026-01-02")]\ntheorem old1 : x where\n y\n@[deprecated "text"]\nlemma old2 : z := w\n@[deprecated foo]\nalias old3 := foo\n@[deprecated bar, since := "2025-01-01"] no header\n@[deprecated bar]\nprotected theorem old4 (a : N)')
    rows_ = {r["old"]: (r["kind"], r["replacement"], str(r["since"]), r["old_sig"], r["class"]) for r in extract.deprecations(dep).collect()}
    assert rows_["old1"] == ("theorem", "new", "2026-01-02", ' : x where\n y\n@[deprecated "text"]\nlemma old2 : z ', None)
    assert rows_["old2"] == ("lemma", None, "None", " : z ", "no_replacement") and rows_["old3"][4] == "alias" and rows_["old4"] == ("theorem", "bar", "None", None, "unresolved") and len(rows_) == 4


def test_freeze(spark):
    decls = spark.createDataFrame([("N.A", "new", "(a : N) :  a = a"), ("N.B", "twin", "x"), ("N.C", "twin", "x")], "module string, name string, statement string")
    dep = spark.createDataFrame([("M", "o1", "new", "(b : N) : b = b", None), ("M", "o2", "A.new", "(a : N) : a\n= a", None), ("M", "o3", "twin", "x", None), ("M", "o4", "B.twin", "y", None), ("M", "o5", None, "y", "alias")], "module string, old string, replacement string, old_sig string, class string").withColumn("since", F.lit(None).cast("date"))
    got = {r["old"]: (r["new"], r["class"]) for r in evaluate.freeze(dep, decls).collect()}
    assert got == {"M.o1": ("N.A.new", "kept"), "M.o2": ("N.A.new", "identical"), "M.o3": (None, "unresolved"), "M.o4": ("N.B.twin", "kept"), "M.o5": (None, "alias")}
    frozen = evaluate.freeze(dep, decls)
    assert evaluate.freeze_hash(frozen).first() == evaluate.freeze_hash(frozen.orderBy(F.desc("old"))).first() != evaluate.freeze_hash(frozen.where("old <> 'M.o1'")).first()
    jobs = evaluate.probe_jobs(spark.createDataFrame([("M.o1", "N.A.new")], "old string, new string"), frozen).first()
    assert jobs["old_statement"] == "(b : N) : b = b" and jobs["new_statement"] == "(a : N) : a = a"
    with pytest.raises(Exception, match="not frozen"):
        evaluate.probe_jobs(spark.createDataFrame([("M.o1", "gone")], "old string, new string"), frozen).collect()
    with pytest.raises(Exception, match="twin: 2 matches"):
        pairs.named_once(pairs.resolved(spark.createDataFrame([("twin",)], "name string"), decls)).collect()


def test_lists_and_links(spark):
    gaps = spark.createDataFrame([("a",), ("b",), ("c",)], "query string")
    rollup = spark.createDataFrame([("a", "closed"), ("b", "open")], "query string, outcome string")
    assert {r[0] for r in evaluate.targets(gaps, rollup).collect()} == {"b", "c"}
    assert sorted(map(tuple, evaluate.unportable(gaps, ["y", "x"]).collect()))[:2] == [("a", "x"), ("a", "y")] and evaluate.unportable(gaps, []).count() == 0
    assert [tuple(r) for r in evaluate.closed_directions(rollup).collect()] == [("a", "closed")]
    links = spark.createDataFrame([("p", "q", datetime.date(2026, 2, 16)), ("q", "p", datetime.date(2026, 4, 1)), ("p", "r", datetime.date(2026, 2, 16))], "old string, new string, since date")
    found = evaluate.linked_within(spark.createDataFrame([("q", "p"), ("p", "r"), ("r", "q")], "left string, right string"), links, "2026-02-16")
    assert {(r["left"], r["right"], r["months"]) for r in found.where("flag").collect()} == {("q", "p", 3), ("q", "p", 6), ("q", "p", 12)}
    assert one(spark, T.without_folders, "/a/b/C.lean:1: x /d/E.lean") == "C.lean:1: x E.lean"


def test_graphs_and_headers(spark, tmp_path):
    modules = spark.createDataFrame([(x,) for x in "abc"], "module string")
    edges = lambda *e: spark.createDataFrame(list(e), "src string, dst string")
    got = graph.pair_distances({"naive": (modules, edges(("a", "b"))), "corrected": (modules, edges(("a", "b"), ("c", "b"), ("b", "z")))}, "a", "c")
    assert {tuple(r) for r in got.collect()} == {("naive", None), ("corrected", 2)}
    assert [tuple(r) for r in graph.top_in_degrees(modules, edges(("a", "b"), ("c", "b"), ("a", "c")), 2).collect()] == [("b", 2), ("c", 1)]
    report = graph.hub_report(modules, edges(("a", "b"), ("c", "b")), "a", "c", (0.0, 0.34))
    assert {tuple(r) for r in report.collect()} == {(0.0, 0, 3, 2), (0.34, 1, 2, None)}
    sources = spark.createDataFrame([("k", "P.A", "A", "/-- theorem foo -/\ntheorem foo.bar : x := y\nlemma foo (a : N) :\n a = a := rfl"), ("k", "Q.A", "A", "lemma foo : z\nnamespace N\nnamespace M.O\nnamespace N\n@[to_dual] @[to_dual x]"), ("k", "R.B", "B", "theorem foo : q := r")], "corpus string, module string, path string, text string")
    names = spark.createDataFrame([("foo",), ("A.foo",), ("P.A.foo",), ("B.foo",), ("none",)], "name string")
    found = {r["name"]: tuple(r)[1:] for r in extract.named_headers(sources, names).collect()}
    assert found == {"foo": (2, None, None), "A.foo": (1, "P.A", ".bar : x "), "P.A.foo": (1, "P.A", ".bar : x "), "B.foo": (1, "R.B", " : q "), "none": (0, None, None)}
    assert extract.dual_count(sources).first()["n"] == 2 and {r["module"]: r["namespaces"] for r in extract.namespaces(sources).collect()}["Q.A"] == ["N", "M.O"]
    decls = extract.declarations(sources)
    assert extract.declaration_text(decls).where("name = 'foo' and module = 'R.B'").first()["text"] == "foo   : q "


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    for form in ("parquet", "json"):
        place = trees.write_report(df, f"{tmp_path}/{form}", form=form)
        assert spark.read.format(form).schema(df.schema).load(place).collect() == df.collect()
        with pytest.raises(Exception, match="already exists"):
            trees.write_report(df, f"{tmp_path}/{form}", form=form)
        trees.write_report(df, f"{tmp_path}/{form}", "again", form=form)
        trees.write_report(df, f"{tmp_path}/{form}", "again", form=form)
    for _ in range(2):
        trees.append_attempts(df, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    union, skipped = trees.all_corpora(spark, {"here": df, "gone": None})
    assert [tuple(r) for r in union.select("corpus", "k").collect()] == [("here", "a")] and [tuple(r) for r in skipped.collect()] == [("gone", "not found")]
    (tmp_path / "loose" / ".lake").mkdir(parents=True)
    (tmp_path / "loose" / "X.lean").write_bytes(b"theorem \xff : x := y")
    (tmp_path / "loose" / ".lake" / "Y.lean").write_text("def y := 1")
    assert [(r["module"], r["text"]) for r in trees.read_tree(spark, f"{tmp_path}/loose", "k").collect()] == [("X", "theorem � : x := y")]
