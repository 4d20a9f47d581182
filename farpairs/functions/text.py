"""Column functions over source text and statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols with the words that stand for them, applied in this order.
SYMBOLS = [
    ("²", " sq "), ("³", " cube "), ("≡", " modeq "), ("∣", " dvd "), ("√", " sqrt "), ("−", " minus "), ("-1", " negone "), ("ℤ", " int "),
    ("ℕ", " nat "), ("ℝ", " real "), ("ℚ", " rat "), ("∑", " sum "), ("∏", " prod "), ("→", " "), ("↔", " iff "),
]
# Words that are no tokens.
STOP = (
    "the a an of to and is in for that its it be by as are on at with this from or any every theorem lemma def proof using hence thus then"
).split()
# Identifier segments and their additive counterparts, longest first.
SEGMENTS = [
    ("smul", "vadd"), ("hmul", "hadd"), ("mul", "add"), ("inv", "neg"), ("div", "sub"), ("semigroup", "addSemigroup"), ("monoid", "addMonoid"),
    ("group", "addGroup"), ("one", "zero"),
]
# Two sides of each bridge.
BRIDGE = [
    ("IsSquare (-1 : ZMod m.natAbs)", "∃ r : ℤ, r ^ 2 ≡ -1 [ZMOD m]"),
    ("IsSquare (-1 : ZMod n.markovNumber.natAbs)", "∃ r : ℤ, r ^ 2 ≡ -1 [ZMOD n.markovNumber]"),
]
# Names of the theorems at the two ends of a bridge.
ENDS = ("isSquare_neg_one_mod_markovNumber", "exists_sq_modEq_neg_one_markovNumber")


def one_spaced(text: Column) -> Column:
    """runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def digest(text: Column) -> Column:
    """SHA-256 of the one-spaced text."""
    return F.sha2(one_spaced(text), 256)


def without_line_comments(text: Column) -> Column:
    """Two dashes and the rest of their line go, unless a slash or dash stands before or a dash after them.

    Each line is taken as runs of dashes and of other characters; its comment begins at the
    first run of exactly two dashes that does not follow a slash.
    """

    def one(line: Column) -> Column:
        runs = F.regexp_extract_all(line, F.lit("-+|[^-]+"), F.lit(0))
        opens = lambda r: F.transform(r, lambda x, k: (x == "--") & ~F.coalesce(F.get(r, k - 1).endswith("/"), F.lit(False)))
        # the runs are named once, so that they are not made for each use
        kept = F.transform(F.array(runs), lambda r: F.array_join(F.slice(r, 1, F.greatest(F.array_position(opens(r), F.lit(True)).cast("int") - 1, F.lit(0))), ""))[0]
        whole = F.transform(F.array(runs), lambda r: F.array_contains(opens(r), True))[0]
        return F.when(line.contains("--") & whole, kept).otherwise(line)

    return F.when(text.contains("--"), F.array_join(F.transform(F.split(text, "\n"), one), "\n")).otherwise(text)


def without_comments(text: Column) -> Column:
    """All comments go, nested block comments too; line ends within them stay.

    A fold over dashes, slashes, line ends and what stands between them: the state is the
    depth of block comments, whether a line comment runs, a dash or slash that may open or
    close one, and what is kept. Inside a block comment only its own opening and closing
    signs count, so that two dashes before a closing sign do not hide it. An open one
    hides the rest.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[-/\n]|[^-/\n]+"), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("line"), F.lit("").alias("sign"), none.alias("kept"))

    def step(x: Column, c: Column) -> Column:
        depth, line, sign, kept = x["depth"], x["line"], x["sign"], x["kept"]
        plain = (depth == 0) & ~line
        opens = ~line & (sign == "/") & (c == "-")
        closes = (depth > 0) & (sign == "-") & (c == "/")
        dashes = plain & (sign == "-") & (c == "-")
        end = c == "\n"
        waits = ~line & ~opens & ~closes & ~dashes & c.isin("-", "/")
        # outside of comments a sign that nothing came of is kept after all
        before = F.when(plain & ~opens & ~dashes & (sign != ""), F.array(sign)).otherwise(none)
        own = F.when(end & (line | (depth > 0)) | plain & ~waits & ~opens & ~dashes, F.array(c)).otherwise(none)
        return F.struct(
            (depth + opens.cast("int") - closes.cast("int")).alias("depth"),
            (dashes | line & ~end).alias("line"),
            F.when(waits, c).otherwise(F.lit("")).alias("sign"),
            F.when(F.size(before) + F.size(own) > 0, F.concat(kept, before, own)).otherwise(kept).alias("kept"),
        )

    said = F.aggregate(pieces, start, step, lambda x: F.concat(F.array_join(x["kept"], ""), F.when((x["depth"] == 0) & ~x["line"], x["sign"]).otherwise(F.lit(""))))
    return F.when(text.contains("--") | text.contains("/-"), said).otherwise(text)


def mapped_symbols(text: Column) -> Column:
    """F3."""
    for sign, word in SYMBOLS:
        text = F.replace(text, F.lit(sign), F.lit(word))
    return text


def tokens(text: Column) -> Column:
    """lower-case humps of ASCII identifiers and digit runs; no stop words, no single letters.

    Acronyms end before a capital that begins a word, which is set off first.
    """
    spaced = F.regexp_replace(mapped_symbols(text), r"([A-Z])([A-Z][a-z])", "$1 $2")
    humps = F.regexp_extract_all(spaced, F.lit(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))
    lower = F.transform(humps, F.lower)
    return F.filter(lower, lambda w: (F.length(w) > 1) & ~w.isin(STOP))


def is_instance(constant: Column) -> Column:
    """the last dotted part starts with `inst`."""
    return F.substring_index(constant, ".", -1).startswith("inst")


def module_matches(module: Column, suffix: Column) -> Column:
    """equal, or ends with the suffix after a dot."""
    return (module == suffix) | module.endswith(F.concat(F.lit("."), suffix))


def qualifier(name: Column) -> Column:
    """what stands before the last dot, else null."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", ""))


#: Borders of humps: what ends on the left, what begins on the right.
BORDERS = [("[A-Z]", "[A-Z][a-z]"), ("[a-z0-9]", "[A-Z]"), ("[A-Z][A-Z]", "[0-9]")]


def additive_name(name: Column) -> Column:
    """humps that are a listed segment are replaced; the first letter keeps its case.

    Dots and underscores part an identifier; digits belong to the hump before them, unless
    that is a run of capitals. Borders are marked and the name is split there.
    """
    marked = name
    for left, right in BORDERS:
        marked = F.regexp_replace(marked, f"({left})({right})", "$1\u0001$2")
    # a separator is a piece, and so is a run of what belongs to no identifier
    pieces = F.split(F.regexp_replace(marked, "[._]|[^A-Za-z0-9._\u0001]+", "\u0001$0\u0001"), "\u0001")
    known = F.create_map(*[F.lit(x) for pair in SEGMENTS for x in pair])

    def one(p: Column) -> Column:
        other = known[F.lower(p)]
        return F.coalesce(F.when(p.rlike("^[A-Z]"), F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, 2, 100))).otherwise(other), p)

    return F.array_join(F.transform(pieces, one), "")


def additive_signature(signature: Column) -> Column:
    """F8: F7 on each identifier, then ` * ` and ` / ` become ` + ` and ` - `."""
    parts = F.regexp_extract_all(signature, F.lit(r"[A-Za-z_][A-Za-z0-9_.']*|[^A-Za-z_]+"), F.lit(0))
    named = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[A-Za-z_]"), additive_name(p)).otherwise(p)), "")
    return F.replace(F.replace(named, F.lit(" * "), F.lit(" + ")), F.lit(" / "), F.lit(" - "))


def once(text: Column, pattern: str, other: str) -> Column:
    """The first match of ``pattern`` replaced by ``other``; null without one."""
    ahead = F.regexp_extract(text, f"(?sU)^(.*?)(?:{pattern})", 1)
    behind = F.regexp_extract(text, f"(?sU)^.*?(?:{pattern})(.*)$", 1)
    return F.when(text.rlike(f"(?U){pattern}"), F.concat(ahead, F.lit(other), behind))


def renamed_once(text: Column, name: str, other: str) -> Column:
    """The first place of ``name`` as a word of its own, not behind a dot, takes ``other``; null without one.

    The text is cut at the name, and the characters on either side of each cut are looked at.
    """
    parts = F.split(text, r"\Q" + name + r"\E")
    last, first = F.substring(F.lit(name), -1, 1), F.substring(F.lit(name), 1, 1)

    def free(p: Column) -> Column:
        beside = lambda k: (F.when(F.get(p, k) == "", F.when(k > 0, last).otherwise(F.lit(" "))).otherwise(F.substring(F.get(p, k), -1, 1)), F.when(F.get(p, k + 1) == "", F.when(k + 2 < F.size(p), first).otherwise(F.lit(" "))).otherwise(F.substring(F.get(p, k + 1), 1, 1)))
        fits = lambda k: ~beside(k)[0].rlike(r"(?U)[\w.]") & ~beside(k)[1].rlike(r"(?U)\w")
        cuts = F.when(F.size(p) > 1, F.sequence(F.lit(0), F.size(p) - 2)).otherwise(F.array().cast("array<int>"))
        at = F.get(F.filter(cuts, fits), 0)
        joined = lambda k: F.concat(F.array_join(F.slice(p, 1, k + 1), name), F.lit(other), F.array_join(F.slice(p, k + 2, F.size(p)), name))
        return F.transform(F.array(at), lambda k: F.when(k.isNotNull(), joined(k)))[0]

    return F.transform(F.array(parts), free)[0]


def across_bridge(signature: Column, bridge: list[tuple[str, str]] = BRIDGE, ends: tuple[str, str] = ENDS) -> Column:
    """the first side that stands in the signature is replaced once by the other.

    White space in a side is flexible. Without a side, the name of an end is replaced by
    the other end's; without that too the result is null.
    """
    flexible = lambda side: r"\s+".join(r"\Q" + x + r"\E" for x in side.split())
    both_ways = [way for pair in bridge for way in (pair, pair[::-1])]
    return F.coalesce(*[once(signature, flexible(a), b) for a, b in both_ways], *[renamed_once(signature, a, b) for a, b in (ends, ends[::-1])])


def textual_proposition(signature: Column) -> Column:
    """what stands before the last colon outside brackets is bound, the rest is the body.

    Without such a colon all is the body; an empty body is null. A closing bracket too many
    does not count.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("cut"))

    def step(x: Column, c: Column) -> Column:
        depth = F.when(c.isin("(", "[", "{"), x["depth"] + 1).when(c.isin(")", "]", "}"), F.greatest(x["depth"] - 1, F.lit(0))).otherwise(x["depth"])
        at = x["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((c == ":") & (x["depth"] == 0), at).otherwise(x["cut"]).alias("cut"))

    def said(cut: Column) -> Column:
        binders, body = one_spaced(F.substring(signature, F.lit(1), cut - 1)), one_spaced(F.substring(signature, cut + 1, F.length(signature)))
        return F.when(cut == 0, F.nullif(one_spaced(signature), F.lit(""))).when(body == "", F.lit(None)).when(binders == "", body).otherwise(F.concat(F.lit("∀ "), binders, F.lit(", "), body))

    return F.transform(F.array(F.aggregate(F.split(signature, ""), start, step)["cut"]), said)[0]


def goals(left: Column, right: Column) -> Column:
    """(direction, goal) for both directions together and each alone."""
    made = lambda d, a, sign, b: F.struct(F.lit(d).alias("direction"), F.concat(F.lit("("), a, F.lit(f") {sign} ("), b, F.lit(")")).alias("goal"))
    return F.array(made("iff", left, "↔", right), made("left_to_right", left, "→", right), made("right_to_left", right, "→", left))


def without_folders(message: Column) -> Column:
    """absolute folders before a source file's name go."""
    return F.regexp_replace(message, r"/(?:[^/\s:]+/)+(?=[^/\s:]+\.lean)", "")


def since_date(attribute: Column) -> Column:
    """E9."""
    return F.to_date(F.nullif(F.regexp_extract(attribute, r'since\s*:=\s*"([0-9]{4}-[0-9]{2}-[0-9]{2})"', 1), F.lit("")))


def first_identifier(text: Column, key: str) -> Column:
    """The first identifier (with dots and primes) outside of strings, doc blocks and clauses of ``key``; null without one.

    The text is taken as words and signs. A clause is the key, ``:=`` and what follows: up to
    the closing bracket if one opened right before the key, else up to a comma.
    """
    words = F.regexp_extract_all(text, F.lit("(?sU)\"[^\"]*\"|/--.*?-/|[\\w.']+|:=|[^\\s]"), F.lit(0))
    start = F.struct(F.lit("").alias("was"), F.lit("").alias("before"), F.lit("").alias("ends"), F.lit(None).cast("string").alias("found"), F.lit(None).cast("string").alias("maybe"))

    def step(x: Column, w: Column) -> Column:
        clause = (x["ends"] == "") & (x["was"] == key) & (w == ":=")
        over = (x["ends"] != "") & (w == x["ends"])
        ends = F.when(clause, F.when(x["before"] == "(", F.lit(")")).otherwise(F.lit(","))).when(over, F.lit("")).otherwise(x["ends"])
        named = (x["ends"] == "") & ~clause & w.rlike("^[A-Za-z_]")
        # the key itself is a name only if no clause follows it
        found = F.coalesce(x["found"], F.when(~clause, x["maybe"]))
        return F.struct(w.alias("was"), x["was"].alias("before"), ends.alias("ends"), F.coalesce(found, F.when(named & (w != key), w)).alias("found"), F.when(named & (w == key), w).alias("maybe"))

    return F.aggregate(words, start, step, lambda x: F.coalesce(x["found"], x["maybe"]))


def replacement_name(attribute: Column) -> Column:
    """Strings and since clauses do not count."""
    return first_identifier(attribute, "since")


def explicit_name(attribute: Column) -> Column:
    """Groups of further attributes and doc blocks do not count."""
    return first_identifier(attribute, "attr")
