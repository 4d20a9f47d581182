"""Declarations, imports and attributes out of source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpairs.functions import text as T

# Words that open a declaration, and words that may stand before them.
KINDS = ["theorem", "lemma", "def", "abbrev"]
MODIFIERS = ["private", "protected", "noncomputable"]
#: What ends a signature.
ENDS = [":=", r"\bwhere\b", r"\n\s*\|"]
#: White space and word ends are Unicode's; a dot is any character.
FLAGS = "(?sU)"


def any_of(words: list[str]) -> str:
    return f"(?:{'|'.join(words)})"


_MODIFIER = rf"{any_of(MODIFIERS)}\s+"
_NAME = r"[^\s:({\[]+"
_END = any_of(ENDS)
#: What a source is cut at: where a doc block opens, an attribute, a kind with a name, what ends a signature.
_CUTS = rf"{FLAGS}/--|@\[[^\]]*\]|{any_of(KINDS)}\s+{_NAME}|{_END}"
_FOUND = "array<struct<raw_doc:string,modifiers:string,head:string,raw_sig:string>>"


def part(hit: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(hit, FLAGS + pattern, group)


def _blank(text: Column) -> Column:
    return T.one_spaced(text) == ""


def _ends_comment(text: Column) -> Column:
    return T.stripped(text).endswith("-/")


def _cut(text: Column) -> Column:
    """array<struct<gap, sign, sort, modifiers, before>>: each sign with the text before it.

    ``sort``: doc, attribute, kind or end. ``modifiers`` are the words right before a kind,
    and ``before`` what stands before those.
    """
    gaps, signs = F.split(text, _CUTS), F.regexp_extract_all(text, F.lit(_CUTS), F.lit(0))

    def one(sign: Column, k: Column, gaps: Column) -> Column:
        gap = F.get(gaps, k)
        sort = F.when(sign == "/--", "doc").when(sign.startswith("@["), "attribute").when(sign.rlike(rf"{FLAGS}^{any_of(KINDS)}\s"), "kind").otherwise("end")
        words = F.when(sort == "kind", part(gap, rf"((?:{_MODIFIER})*)\z")).otherwise("")
        return F.struct(gap.alias("gap"), sign.alias("sign"), sort.alias("sort"), words.alias("modifiers"), F.substring(gap, F.lit(1), F.length(gap) - F.length(words)).alias("before"))

    return F.transform(F.array(gaps), lambda g: F.transform(signs, lambda sign, k: one(sign, k, g)))[0]


def _documented(cuts: Column) -> Column:
    """For each sign, whether it is a kind that a comment's end stands before, but for attributes and modifiers."""
    start = F.struct(F.lit(False).alias("run"), F.lit(False).alias("behind"), F.array().cast("array<boolean>").alias("out"))

    def step(x: Column, c: Column) -> Column:
        goes_on = x["run"] & _blank(c["before"])
        behind = F.when(goes_on, x["behind"]).otherwise(_ends_comment(c["before"]))
        return F.struct((c["sort"] == "attribute").alias("run"), behind.alias("behind"), F.concat(x["out"], F.array((c["sort"] == "kind") & behind)).alias("out"))

    return F.aggregate(cuts, start, step, lambda x: x["out"])


def _read(cuts: Column, documented: Column) -> Column:
    """The declarations of a source, by one walk over its signs.

    ``doc`` is the text since a doc block opened (null: none did), ``run`` a run of
    attributes behind it, ``head`` the kind and name of a signature that is being read.
    """
    last = F.coalesce(F.array_max(F.transform(documented, lambda d, k: F.when(d, k))), F.lit(-1))
    null = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("at"), null.alias("doc"), F.lit("").alias("run"), null.alias("head"), F.lit("").alias("modifiers"), null.alias("raw_doc"), F.lit("").alias("sig"), F.array().cast(_FOUND).alias("out"))

    def step(x: Column, c: Column) -> Column:
        sign, sort, doc = c["sign"], c["sort"], x["doc"]
        reading = x["head"].isNotNull()
        # a signature ends at the first end, be it inside an attribute or a name
        inner = F.when(sort == "end", F.lit("")).when(sign.rlike(FLAGS + _END), F.regexp_replace(sign, rf"{FLAGS}{_END}.*", ""))
        ends = reading & inner.isNotNull()
        made = F.struct(x["raw_doc"].alias("raw_doc"), x["modifiers"].alias("modifiers"), x["head"].alias("head"), F.concat(x["sig"], c["gap"], inner).alias("raw_sig"))
        behind = F.get(documented, x["at"])
        # in an open doc block only a kind right behind a comment's end counts
        opens = ~reading & (sort == "kind") & (doc.isNull() | behind)
        said = F.when(_blank(c["before"]) & (x["run"] != ""), doc).otherwise(F.concat(doc, x["run"], c["before"]))
        begins = ~reading & doc.isNull() & (sort == "doc") & (x["at"] < last)
        goes_on = (sort == "attribute") & (x["run"] != "") & _blank(c["gap"])
        grown = F.when(goes_on, doc).when(sort == "attribute", F.concat(doc, x["run"], c["gap"])).otherwise(F.concat(doc, x["run"], c["gap"], sign))
        return F.struct(
            (x["at"] + 1).alias("at"),
            F.when(reading | opens, null).when(begins, F.lit("")).otherwise(grown).alias("doc"),
            F.when(reading | opens | (sort != "attribute"), F.lit("")).when(goes_on, F.concat(x["run"], c["gap"], sign)).otherwise(sign).alias("run"),
            F.when(ends, null).when(opens, sign).otherwise(x["head"]).alias("head"),
            F.when(opens, c["modifiers"]).otherwise(x["modifiers"]).alias("modifiers"),
            F.when(opens, F.regexp_replace(said, r"(?U)-/\s*\z", "")).otherwise(x["raw_doc"]).alias("raw_doc"),
            F.when(opens | ends, F.lit("")).when(reading, F.concat(x["sig"], c["gap"], sign)).otherwise(x["sig"]).alias("sig"),
            F.when(ends, F.concat(x["out"], F.array(made))).otherwise(x["out"]).alias("out"),
        )

    return F.aggregate(cuts, start, step, lambda x: x["out"])


def declarations(sources: DataFrame, *, blank_comments: bool = False, strict_private: bool = False) -> DataFrame:
    """(corpus, module, name, kind, statement, docstring, raw_doc, raw_sig, ordinal).

    A source is cut at kinds with a name, attributes, openings of doc blocks and ends of
    signatures. A kind opens a declaration wherever it stands; the words right before it are
    its modifiers, and a doc block that closes right before these and any attributes is its
    own; it goes on to the next end. A declaration is dropped if the modifier next to its
    kind is private; with ``strict_private`` if any is.
    """
    text = T.without_comments(F.col("text")) if blank_comments else T.without_line_comments(F.col("text"))
    cut = sources.select("corpus", "module", _cut(text).alias("cuts"))
    known = cut.withColumn("documented", _documented(F.col("cuts")))
    hits = known.select("corpus", "module", F.posexplode(_read(F.col("cuts"), F.col("documented"))).alias("ordinal", "x")).select("corpus", "module", "ordinal", "x.*")
    hidden = F.col("modifiers").contains("private") if strict_private else F.col("modifiers").rlike(r"(?U)\bprivate\s+$")
    doc = F.coalesce("raw_doc", F.lit("")).alias("raw_doc")
    return hits.where(~hidden).select("corpus", "module", part(F.col("head"), rf"({_NAME})$").alias("name"), part(F.col("head"), r"^(\w+)").alias("kind"), T.stripped(F.col("raw_sig")).alias("statement"), T.stripped(F.coalesce("raw_doc", F.lit(""))).alias("docstring"), doc, "raw_sig", F.col("ordinal").cast("long").alias("ordinal"))


def theorems(decls: DataFrame) -> DataFrame:
    """E5."""
    return decls.where(F.col("kind").isin("theorem", "lemma"))


def imports_naive(sources: DataFrame, namespace: str) -> DataFrame:
    """(src, dst) of lines that start with `import <namespace>`, comments included."""
    lines = F.regexp_extract_all("text", F.lit(rf"(?mU)^import\s+({namespace}[\w.]*)"), F.lit(1))
    return sources.select(F.col("module").alias("src"), F.explode(lines).alias("dst"))


def imports(sources: DataFrame) -> DataFrame:
    """(src, dst) outside comments, public and meta imports too, any target."""
    lines = F.regexp_extract_all(T.without_comments(F.col("text")), F.lit(r"(?mU)^\s*(?:public\s+|meta\s+)*import\s+([\w.]+)"), F.lit(1))
    return sources.select(F.col("module").alias("src"), F.explode(lines).alias("dst"))


def _blocks(sources: DataFrame, attribute: str) -> DataFrame:
    """(corpus, module, args, after, later): the text behind each ``@[attribute ...]``.

    ``after`` ends where the next such attribute begins; ``later`` is all that follows.
    """
    parts = sources.select("corpus", "module", F.split("text", FLAGS + rf"@\[{attribute}\b").alias("p"))
    each = parts.select("corpus", "module", "p", F.posexplode(F.slice("p", 2, F.size("p"))).alias("k", "own")).where(F.col("own").contains("]"))
    later = F.array_join(F.slice("p", F.col("k") + 3, F.size("p")), f"@[{attribute}")
    return each.select("corpus", "module", F.substring_index("own", "]", 1).alias("args"), F.expr("substring(own, instr(own, ']') + 1)").alias("after"), later.alias("later"))


def deprecations(sources: DataFrame) -> DataFrame:
    """(module, kind, old, replacement, since, old_sig, class) of each deprecated block.

    The attribute is read first, then the header right behind it (a block without one is
    ignored), then the signature up to the next `:=` anywhere; without one it is null and
    the block unresolved. Aliases and private ones are class alias.
    """
    header = rf"^\s*((?:{any_of([*MODIFIERS, 'scoped'])}\s+)*)({any_of(['alias', *KINDS])})\s+([A-Za-z_]\w*)"
    after = F.col("after")
    found = _blocks(sources, "deprecated").where(after.rlike(FLAGS + header))
    behind = F.regexp_replace("after", FLAGS + header, "")
    # the signature may go on behind further attributes
    full = F.when(behind.contains(":="), behind).otherwise(F.concat(behind, F.lit("@[deprecated"), "later"))
    named = found.select("module", part(after, header, 1).alias("modifiers"), part(after, header, 2).alias("kind"), part(after, header, 3).alias("old"), T.replacement_name(F.col("args")).alias("replacement"), T.since_date(F.col("args")).alias("since"), F.when(full.contains(":="), F.substring_index(full, ":=", 1)).alias("old_sig"))
    kind = F.when((F.col("kind") == "alias") | F.col("modifiers").contains("private"), "alias").when(F.col("replacement").isNull(), "no_replacement").when(F.col("old_sig").isNull(), "unresolved")
    return named.select("module", "kind", "old", "replacement", "since", "old_sig", kind.alias("class"))


def additive_attributes(sources: DataFrame) -> DataFrame:
    """(module, kind, name, explicit, is_private) of each to_additive block with a header behind it.

    What stands behind the block is peeled: a doc block, further attributes, modifiers. A
    doc block goes on to the first end of a comment that a header stands behind.
    """
    headed = rf"{FLAGS}^(?:@\[[^\]]*\]\s*|{_MODIFIER})*{any_of([*KINDS, 'instance'])}\s+{_NAME}"
    blocks = _blocks(sources, "to_additive").withColumn("peeled", T.stripped(F.col("after"))).withColumn("parts", F.split("peeled", "-/"))
    behind = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: T.stripped(F.array_join(F.slice("parts", k + 1, F.size("parts")), "-/")))
    undocumented = F.get(F.filter(behind, lambda x: x.rlike(headed)), 0)
    bare = blocks.withColumn("peeled", F.when(F.col("peeled").startswith("/--") & (F.size("parts") > 1), undocumented).otherwise(F.col("peeled")))
    plain = bare.withColumn("peeled", F.regexp_replace("peeled", FLAGS + r"^(?:@\[[^\]]*\]\s*)+", ""))
    words = plain.withColumn("words", F.split("peeled", r"(?U)\s+", 8))
    # modifiers come first, then a kind, then the name, which ends where a signature may begin
    place = F.get(F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda k: ~F.get("words", k).isin(MODIFIERS)), 0)
    headed = words.withColumn("k", place).withColumn("kind", F.get("words", F.col("k"))).withColumn("name", part(F.get("words", F.col("k") + 1), rf"^({_NAME})"))
    private = F.array_contains(F.slice("words", 1, F.col("k")), "private")
    return headed.where(F.col("kind").isin(*KINDS, "instance") & (F.col("name") != "")).select("module", "kind", "name", T.explicit_name(F.col("args")).alias("explicit"), private.alias("is_private"))


def dual_count(sources: DataFrame) -> DataFrame:
    """(corpus, n) attributes that name a dual."""
    return sources.groupBy("corpus").agg(F.sum(F.regexp_count("text", F.lit(r"@\[to_dual"))).alias("n"))


def namespaces(sources: DataFrame) -> DataFrame:
    """(module, namespaces) opened in each source, in order, once each."""
    return sources.select("module", F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^namespace\s+(\S+)"), F.lit(1))).alias("namespaces"))


def named_headers(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(name, hits, module, raw_sig) of each wanted theorem by its header line.

    The first line of a file that opens with `theorem` or `lemma` and the name's last part
    counts, if a `:=` follows and the module is, or ends with, the name's other parts. A
    header whose name goes on behind a dot or prime counts too, as the word ends there.
    Module and signature are null unless there is exactly one hit.
    """
    lines = F.regexp_extract_all("text", F.lit(r"(?mU)^(?:theorem|lemma)\s+(\w+)"), F.lit(1))
    heads = sources.select("module", "text", F.explode(F.array_distinct(lines)).alias("short"))
    wanted = names.select("name").distinct().select("name", F.substring_index("name", ".", -1).alias("short"), T.qualifier(F.col("name")).alias("suffix"))
    met = heads.join(F.broadcast(wanted) if wanted.count() <= 10_000 else wanted, "short").where(F.col("suffix").isNull() | T.module_matches(F.col("module"), F.col("suffix")))
    behind = F.expr(r"regexp_replace(text, concat('(?smU)\\A.*?^(?:theorem|lemma)\\s+\\Q', short, '\\E\\b'), '')")
    signed = met.select("name", "module", behind.alias("behind")).where(F.col("behind").contains(":=")).select("name", "module", F.substring_index("behind", ":=", 1).alias("raw_sig"))
    hits = signed.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("module", "raw_sig")).alias("x"))
    one = F.col("n") == 1
    return wanted.select("name").join(hits, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("hits"), F.when(one, F.col("x.module")).alias("module"), F.when(one, F.col("x.raw_sig")).alias("raw_sig"))


def declaration_text(decls: DataFrame) -> DataFrame:
    """(module, name, text)."""
    return decls.select("module", "name", F.concat_ws(" ", "name", "raw_doc", "raw_sig").alias("text"))
