"""Phrase collocations (op13): HAT-trie counting of word n-grams, spilled as sorted runs.

Each task keeps a shallow trie over word ids: the root leads from a phrase's first word
to a container, a hash table from the packed rest to a count. A container that grows
past ``BURST`` entries, where there are two further words or more, bursts into a node, which leads from
the second word to smaller containers. When the trie holds more than ``LIMIT`` entries,
whole subtrees are spilled, largest first, each as a sorted run. Runs meet in prefix
partitions (language and first word, for a hot one with a salt of the rest, so that it
spreads) and are merged there by an aggregate.

Runs of pairs name their words by 64-bit hashes. The count of words tells whether two
words of a language share a hash anywhere in the corpus; then all is hashed anew with
another seed, so that a hash stands for one word only.

Phrases are counted level by level. A phrase with ``MIN`` occurrences has no part with
fewer, so pairs are counted only where both words, and longer phrases only where all
their pairs are frequent. Tasks know the frequent words and pairs by a bitmap of fixed
size; a false hit costs time and changes nothing, since all counts are exact.

Defined results: null text is empty, null lang is ``und``; repeated rows count each;
empty input gives no rows; extra columns are not read. A text of any length is counted
whole, in slices that end at a separator of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farpairs.llm.common import materialize
from farpairs.llm.pieces import listed, ragged, stepped
from farpairs.llm.words import CACHE, Hashes, mix
from farpairs.tables import table

MIN, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Bytes of text that are taken at a time; entries of a container and of a task's trie; words that a task numbers.
STEP, BURST, LIMIT, WORDS = 4 << 20, 4096, 1_250_000, 1 << 20
#: The bitmaps of frequent words and pairs have 2^BITS bits (2 MB).
BITS = 24
#: Parts of a hot first word, which is one in ``HOT`` words of its language or more; so there are at most ``HOT`` of them.
SALTS, HOT = 32, 2000
_SHIFT = 21
_PART = (1 << _SHIFT) - 1
_K = np.uint64(0x9E3779B97F4A7C15)
# A-Z to lower case, tab to a space, every separator of pieces to a full stop
TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


class HatTrie:
    """Counts under (first word, packed rest); ids are from 1, and 0 in the rest means no word."""

    def __init__(self, burst: float = BURST):
        self.burst, self.size = burst, 0
        self.root: dict[int, dict[int, int] | list[dict]] = {}

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        """Counts of distinct phrases, in order of their first words."""
        cuts = np.flatnonzero(np.diff(first, prepend=-1))
        rests, ns = rest.tolist(), counts.tolist()
        for word, a, b in zip(first[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(rests)]):
            self._into(word, rests[a:b], ns[a:b])

    def _into(self, word: int, rest: list[int], counts: list[int]) -> None:
        held = self.root.get(word)
        if held is None:
            held = self.root[word] = {}
        if isinstance(held, list):  # burst: by the second word
            inner = held[0]
            for r, n in zip(rest, counts):
                own = inner.setdefault(r >> 2 * _SHIFT, {})
                self.size += r not in own
                own[r] = own.get(r, 0) + n
            return
        before, get = len(held), held.get
        for r, n in zip(rest, counts):
            held[r] = get(r, 0) + n
        self.size += len(held) - before
        if len(held) > self.burst:
            inner = {}
            for r, n in held.items():
                inner.setdefault(r >> 2 * _SHIFT, {})[r] = n
            self.root[word] = [inner]

    def _subtree(self, word: int) -> dict[int, int]:
        held = self.root.pop(word)
        if isinstance(held, list):
            held = {r: n for own in held[0].values() for r, n in own.items()}
        self.size -= len(held)
        return held

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, rest, counts) of whole subtrees, largest first, until ``keep`` entries are left."""
        entries = lambda x: sum(map(len, x[0].values())) if isinstance(x, list) else len(x)
        out: tuple[list, list, list] = ([], [], [])
        for word in sorted(self.root, key=lambda w: -entries(self.root[w])):
            if self.size <= keep:
                break
            own = self._subtree(word)
            out[0].append(np.full(len(own), word, np.int64))
            out[1].append(np.fromiter(own.keys(), np.int64, len(own)))
            out[2].append(np.fromiter(own.values(), np.int64, len(own)))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring words."""
    return mix(a * _K + b)


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _placed(slots: DataFrame) -> np.ndarray:
    """Bits at ``slot``; at most 2^(BITS - 6) rows come back, whatever the vocabulary's size."""
    rows = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("v")).collect()
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in rows:
        out[r["at"]] = r["v"]
    return out.view(np.uint64)


def bitmap(words: DataFrame) -> np.ndarray:
    """The bits of all hashes ``h``."""
    return _placed(words.select(F.shiftrightunsigned("h", 64 - BITS).alias("slot")))


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """The bits of the hashes of pairs (first, second)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_numpy().view(np.uint64) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array((_paired(a, b) >> np.uint64(64 - BITS)).astype(np.int64))], ["slot"])

    return _placed(pairs.select("first", "second").mapInArrow(run, "slot long"))


def _slices(texts: list[bytes]) -> Iterator[bytes]:
    """The texts as bodies of about ``STEP`` bytes, cut at separators only."""
    body = b".".join(texts).translate(TABLE)
    at = 0
    while at < len(body):
        end = body.find(b".", at + STEP)
        end = len(body) if end < 0 else end
        yield body[at:end].replace(b".", b" . ")
        at = end + 1


def _distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of several key columns, in order of the first, and their counts."""
    if len(keys) == 1:
        own, n = np.unique(keys[0], return_counts=True)
        return [own], n
    rest, at = np.unique(keys[1], return_inverse=True)
    own, n = np.unique(keys[0] << 32 | at, return_counts=True)
    return [own >> 32, rest[own & 0xFFFFFFFF]], n


class _Seeded(Hashes):
    """Hashes of words under a seed."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h


class _Counter:
    """A task's words, tries by language, and what they spill."""

    def __init__(self, level: int, words_ok: np.ndarray | None, pairs_ok: np.ndarray | None, hot: np.ndarray | None, limit: int, attempt: int):
        self.level, self.words_ok, self.pairs_ok, self.hot, self.limit = level, words_ok, pairs_ok, hot, limit
        self.hashes, self.totals = _Seeded(attempt), {}
        self.tries: dict[str, HatTrie] = {}
        self.ids: dict[bytes, int] = {}
        self.raw: list[int] = [0]

    def numbered(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            i = self.ids.get(w)
            if i is None:
                i = self.ids[w] = len(self.raw)
                self.raw.append(self.hashes[w])
            out[k] = i
        return out

    def body(self, lang: str, seed: np.uint64, body: bytes) -> None:
        coded = pc.split_pattern(pa.array([body], pa.large_binary()), b" ").flatten().dictionary_encode()
        words, codes = listed(coded.dictionary), coded.indices.to_numpy()
        place = {w: k for k, w in enumerate(words)}
        if b"" in place:
            codes = codes[codes != place[b""]]
        real = np.ones(len(words), bool)
        for w in (b"", b"."):
            if w in place:
                real[place[w]] = False
        trie = self.tries.get(lang)
        if trie is None:  # words are one container, and pairs one for each first word: nothing below to burst into
            trie = self.tries[lang] = HatTrie(BURST if self.level > 2 else float("inf"))
        if self.level == 1:
            n = np.bincount(codes, minlength=len(words)) * real
            kept = np.flatnonzero(n)
            self.totals[lang] = self.totals.get(lang, 0) + int(n.sum())
            ids = self.numbered([words[k] for k in kept.tolist()])
            trie.add(np.zeros(len(ids), np.int64), ids, n[kept])
            return
        h = mix(self.hashes.of(words) ^ seed)
        ok = _held(self.words_ok, h) & real
        here = ok[codes]
        pair = here[:-1] & here[1:]
        used = np.zeros(len(words), bool)
        used[codes[:-1][pair]] = used[codes[1:][pair]] = True
        ids = np.zeros(len(words), np.int64)
        kept = np.flatnonzero(used)
        ids[kept] = self.numbered([words[k] for k in kept.tolist()])
        if self.level == 2:
            own, n = _distinct([ids[codes[:-1][pair]] << _SHIFT | ids[codes[1:][pair]]])
            trie.add(own[0] >> _SHIFT, (own[0] & _PART) << 2 * _SHIFT, n)
            return
        at = np.flatnonzero(pair)
        pair[at] = _held(self.pairs_ok, _paired(h[codes[at]], h[codes[at + 1]]))
        run = pair
        for more in range(1, LONGEST - 1):  # phrases of more + 2 words: all their pairs are frequent
            run = run[:-1] & pair[more:]
            at = np.flatnonzero(run)
            rest = np.zeros(len(at), np.int64)
            for k in range(1, more + 2):
                rest |= ids[codes[at + k]] << (3 - k) * _SHIFT
            own, n = _distinct([ids[codes[at]], rest])
            trie.add(own[0], own[1], n)

    def spilled(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of what goes beyond ``keep`` entries, all languages together."""
        words = pa.array([b"", *self.ids], pa.large_binary())
        raw = np.array(self.raw, np.uint64)
        for lang, trie in self.tries.items():
            first, rest, n = trie.spill(keep * trie.size // max(1, sum(t.size for t in self.tries.values())))
            if not len(first):
                continue
            if self.level == 1:
                first, rest = rest, first
            more = [rest >> 2 * _SHIFT, rest >> _SHIFT & _PART, rest & _PART]
            if self.level == 2:
                yield from self._runs(lang, raw, first, more[0], n)
                continue
            phrase = words.take(pa.array(first))
            for x in more if self.level > 1 else []:
                longer = pc.binary_join_element_wise(phrase, words.take(pa.array(x)), pa.scalar(b" ", pa.large_binary()))
                phrase = pc.if_else(pa.array(x > 0), longer, phrase)
            h = mix(raw[first] ^ _seed(lang))
            k = 1 + sum((x > 0).astype(np.int64) for x in more)
            order = pc.sort_indices(phrase)
            at = order.to_numpy()
            batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(k[at]), words.take(pa.array(first[at])).cast(pa.large_string()).cast(pa.string()), phrase.take(order).cast(pa.large_string()).cast(pa.string()), pa.array(h.view(np.int64)[at]), pa.array(n[at])], ["lang", "k", "head", "phrase", "h", "n"])
            for a in range(0, batch.num_rows, 50_000):
                yield batch.slice(a, 50_000)

    def _runs(self, lang: str, raw: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows (lang, first, salt, second, n): a sorted run for each first word, for each salt of a hot one."""
        seed = _seed(lang)
        a, b = mix(raw[first] ^ seed), mix(raw[second] ^ seed)
        salt = np.where(_held(self.hot, a), (mix(b) % np.uint64(SALTS)).astype(np.int32), 0)
        order = np.lexsort((b, salt, a))
        a, b, salt, n = a[order], b[order], salt[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])]))
        sizes = np.diff(np.append(new, len(a)))
        batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), pa.array(a[new].view(np.int64)), pa.array(salt[new].astype(np.int32)), ragged(sizes, b.view(np.int64)).cast(pa.list_(pa.int64())), ragged(sizes, n.astype(np.int32)).cast(pa.list_(pa.int32()))], ["lang", "first", "salt", "second", "n"])
        for at in range(0, batch.num_rows, 10_000):
            yield batch.slice(at, 10_000)

    def pressed(self) -> Iterator[pa.RecordBatch]:
        if len(self.ids) > WORDS:
            yield from self.spilled(0)
            self.ids, self.raw = {}, [0]
        elif sum(t.size for t in self.tries.values()) > self.limit:
            yield from self.spilled(self.limit // 2)


def _seed(lang: str) -> np.uint64:
    return mix(np.array([Hashes()[lang.encode()]], np.uint64))[0]


def _counting(docs: DataFrame, schema: str, limit: int, attempt: int, level: int, words_ok: np.ndarray | None = None, pairs_ok: np.ndarray | None = None, hot: np.ndarray | None = None) -> DataFrame:
    """The runs that tasks spill over ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(level, words_ok, pairs_ok, hot, limit, attempt)
        for batch in stepped(batches, STEP):
            langs = batch.column(0).dictionary_encode()
            of = langs.indices.to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                texts = listed(batch.column(1).cast(pa.large_binary()).take(pa.array(np.flatnonzero(of == code))))
                seed = _seed(lang)
                for body in _slices(texts):
                    counter.body(lang, seed, body)
                    yield from counter.pressed()
        yield from counter.spilled(0)
        for lang, n in counter.totals.items():
            yield pa.RecordBatch.from_pylist([{"lang": lang, "k": 0, "head": "", "phrase": "", "h": 0, "n": n}], pa.schema([("lang", pa.string()), ("k", pa.int64()), ("head", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("n", pa.int64())]))

    narrow = docs.select(F.coalesce(F.col("`lang`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, schema)


_PHRASES = "lang string, k long, head string, phrase string, h long, n long"


def _merged(runs: DataFrame) -> DataFrame:
    """(lang, k, phrase, h, n) of runs of whole phrases."""
    parted = runs.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).repartition("lang", "head", "salt")
    return parted.groupBy("lang", "head", "salt", "k", "phrase", "h").agg(F.sum("n").alias("n")).select("lang", "k", "phrase", "h", "n")


def counted_words(docs: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """((lang, k, phrase, h, n) of all words, with a row of no words for each total; the seed of hashes that tell all words apart)."""
    for attempt in range(8):
        words = materialize(_merged(_counting(docs, _PHRASES, limit, attempt, 1)))
        if words.where("k = 1").groupBy("lang", "h").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return words, attempt
    raise ValueError("no seed tells all words apart")


def frequent_phrases(docs: DataFrame, *, least: int = MIN, limit: int = LIMIT) -> DataFrame:
    """(lang, k, phrase, n): all phrases of 1 to 4 words with ``least`` occurrences or more; k = 0 has the totals."""
    every, attempt = counted_words(docs, limit)
    words = materialize(every.where((F.col("n") >= least) | (F.col("k") == 0)))
    words_ok = bitmap(words.where("k = 1"))
    totals = words.where("k = 0").select("lang", F.col("n").alias("total"))
    hot = bitmap(words.where("k = 1").join(totals, "lang").where(F.col("n") * HOT >= F.col("total")))
    runs = _counting(docs, "lang string, first long, salt int, second array<long>, n array<int>", limit, attempt, 2, words_ok, hot=hot)
    each = runs.repartition("lang", "first", "salt").select("lang", "first", "salt", F.explode(F.arrays_zip("second", "n")).alias("x"))
    pairs = each.groupBy("lang", "first", "salt", F.col("x.second").alias("second")).agg(F.sum("x.n").alias("n")).where(F.col("n") >= least)
    named = words.where("k = 1")
    side = lambda c: named.select("lang", F.col("h").alias(c), F.col("phrase").alias(f"{c}_word"))
    pairs = materialize(pairs.join(side("first"), ["lang", "first"]).join(side("second"), ["lang", "second"]).select("lang", F.lit(2).cast("long").alias("k"), F.concat_ws(" ", "first_word", "second_word").alias("phrase"), "first", "second", "n"))
    pairs_ok = pair_bitmap(pairs)
    longer = materialize(_merged(_counting(docs, _PHRASES, limit, attempt, 3, words_ok, pairs_ok)).where(F.col("n") >= least))
    out = lambda df: df.select("lang", "k", "phrase", "n")
    return out(words).union(out(pairs)).union(out(longer))


def collocations(docs: DataFrame, *, least: int = MIN, top: int = TOP, cover: int = COVER, limit: int = LIMIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 4 words.

    The score is that of the weakest cut; a phrase goes if a longer one around it has at
    least ``cover`` hundredths of its occurrences.
    """
    found = frequent_phrases(docs, least=least, limit=limit)
    phrases = found.where("k > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    some = found.where("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"), words.alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = some.withColumn("cut", F.explode(F.expr("sequence(1L, k - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut").cast("int")).alias("head"), part(F.col("cut").cast("int") + 1, (F.col("k") - F.col("cut")).cast("int")).alias("tail"))
    both = cuts.join(phrases.toDF("lang", "head", "l"), ["lang", "head"]).join(phrases.toDF("lang", "tail", "r"), ["lang", "tail"])
    # 38 digits hold the product of any two longs that can occur
    exact = F.expr("cast((2000000bd * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + r) as long)")
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "cut", "l", "r")).alias("x"))
    # the most frequent longer phrase around each candidate
    inner = F.expr("flatten(transform(sequence(2L, k - 1), m -> transform(sequence(1L, k - m + 1), s -> array_join(slice(w, cast(s as int), cast(m as int)), ' '))))")
    around = some.where("k >= 3").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | F.expr(f"100bd * longer < {cover}bd * a"))
    totals = found.where("k = 0").select("lang", F.col("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
ws as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t),
g as (select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase from ws, (values (1), (2), (3), (4)) v(k)),
f as (select lang, k, phrase, count(*) as n from g group by all), tot as (select lang, cast(sum(n) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k >= 2 and n >= 30),
cut as (select lang, k, phrase, a, w, unnest(range(1, k)) as j from c),
sc as (select cut.lang, cut.phrase, a, j, x.n as l, y.n as r, cast((2000000::hugeint * a) // (x.n + y.n) as bigint) as score from cut
  join f x on x.lang = cut.lang and x.phrase = array_to_string(w[1:j], ' ') join f y on y.lang = cut.lang and y.phrase = array_to_string(w[j + 1:cut.k], ' ')),
weak as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as o from sc) where o = 1),
inn as (select lang, a, unnest(flatten([[array_to_string(w[s:s + m - 1], ' ') for s in range(1, k - m + 2)] for m in range(2, k)])) as phrase from c where k >= 3),
mx as (select lang, phrase, max(a) as longer from inn group by all),
kept as (select weak.* from weak left join mx using (lang, phrase) where longer is null or 100 * longer < 80 * a),
rk as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rk from kept)
select rk.lang, rk as "rank", phrase, a, l, r, tot.n as n, score from rk join tot on tot.lang = rk.lang where rk <= 2000"""
