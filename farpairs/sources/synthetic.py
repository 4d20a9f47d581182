"""Source text made from `supplier` and `part`, so that the extractors run on growing data.

A module for each supplier imports the module of half its key (none if the key is a
multiple of 7; a multiple of 3 imports publicly; a multiple of 5 hides a second
import in a comment). Parts are declarations; the key modulo 8 chooses the form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.tables import table


def _statement():
    key = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    name = of("t", key.cast("string"))
    head = F.concat(F.lit("theorem "), name)
    kind = F.floor(key / 8) % 6
    replaced = F.when(kind.isin(1, 5), "").otherwise(of(F.when(kind == 4, name).when(kind == 3, of("gone", key.cast("string"))).otherwise(of("t", (key - 5).cast("string"))), " "))
    opened = F.when(kind == 1, of("alias ", name)).when(kind == 2, of("private ", head)).otherwise(head)
    partner = F.when(key % 3 == 0, of("add_", name)).otherwise(of("t", F.greatest(key - F.when(key % 3 == 1, 3).otherwise(24), F.lit(0)).cast("string")))
    third = F.when(key % 3 == 0, key.cast("string")).otherwise(size)
    forms = [
        of(head, " (n : Nat) : n + ", size, " = ", size, " + n := by simp\n"),
        of(head, " (m : Nat) : m + ", size, " = ", size, " + m := by simp\n"),
        of("/-- the square form -/\n", head, " (n : ℤ) : IsSquare (-1 : ZMod n.natAbs) := by simp\n"),
        of("lemma ", name, " (n : ℤ) : ∃ r : ℤ, r ^ 2 ≡ -1 [ZMOD n] := by simp\n"),
        of("private ", head, " : ", size, " = ", size, " := rfl\n"),
        of("@[deprecated ", replaced, '(since := "2026-0', (1 + F.col("p_size") % 9).cast("string"), '-01")]\n', opened, "  (a : Nat) : a + ", size, " = a := by simp\n"),
        of("@[to_additive ", partner, "]\n", head, " (a : G) : ", F.when(key % 3 == 2, "a = a").otherwise(of("a * ", third, " = ", third, " * a")), " := by simp\n"),
        of("def ", name, " (n : Nat) : ", size, " ∣ n := by simp -- open\n"),
    ]
    out = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        out = F.when(key % 8 == k, form).otherwise(out)
    return out


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus, module, path, text), one row for each supplier."""
    suppliers, parts = table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = suppliers.count()
    bodies = parts.select((F.col("p_partkey") % n).alias("at"), F.struct(F.col("p_partkey").alias("k"), _statement().alias("s")).alias("x")).groupBy("at").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("body"))
    key = F.col("s_suppkey")
    to = F.concat(F.lit("import Corpus.S"), F.floor(key / 2).cast("string"), F.lit("\n"))
    imports = F.when(key % 7 == 0, F.lit("")).when(key % 3 == 0, F.concat(F.lit("public "), to)).otherwise(to)
    hidden = F.when(key % 5 == 0, F.lit("/- kept for later\nimport Corpus.S1\n--/\n")).otherwise(F.lit(""))
    text = F.concat(hidden, imports, F.lit("import Base.Core\n\n"), F.coalesce("body", F.lit("")))
    name = F.concat(F.lit("Corpus.S"), key.cast("string"))
    return suppliers.join(bodies, key % n == F.col("at"), "left").select(F.lit("synthetic").alias("corpus"), name.alias("module"), F.concat(F.lit("S"), key.cast("string"), F.lit(".lean")).alias("path"), text.alias("text"))
