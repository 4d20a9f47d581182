"""3. Byte-level BPE encoding and decoding.

1. Texts are split by the tokenizer's pattern. Each block of texts keeps its distinct
   words once and writes a code for every occurrence to a file in the shared folder;
   no text is shuffled. A word that is a token itself gets its rank there.
2. The other distinct words of all blocks meet by word, one row for each block that
   holds it, and the first row's word is encoded: its bytes become an array of one-byte
   ids, and a fold of Spark's higher-order functions merges the leftmost adjacent pair
   of least rank until no pair has a rank. So a word is folded once, however many blocks
   hold it. Ranks come from arrays of a one-row table, a bounded one, laid out by hash:
   each pair of ids has one of two places. A scalar subquery brings the row to the tasks
   as packed arrays; literals would be an object for each number, in every task anew. The
   place of the least rank is found by a transform, as ``array_position`` takes ten times
   as long here.
3. The ids go back to their blocks, packed, and each block's texts are put together.
   Decoding concatenates the binary pieces of the ids.

A block is named by its task, its place and its content. A task that runs again over the
same rows writes the same block; one that gets its rows in another order (an input that
is no table) makes other blocks, and the job fails instead of mixing the two.

A fold is quadratic in the bytes of a word, so a word of over ``LONG`` bytes (a text
without spaces) is folded in rounds, each of which merges all places of the least rank
at once; where that could differ from one merge at a time, only the leftmost is merged.

Defined results: a null or empty text has no ids; every text decodes to its own
bytes; repeated rows are encoded alike; an empty table gives an empty result. Long
texts are blocks of their own. Extra columns are ignored by ``encode``.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import json
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farpairs.llm.common import partitions, shared_dir
from farpairs.llm.files import read_range, write_bytes
from farpairs.llm.pieces import coded_pieces, listed, nested, ragged
from farpairs.tables import table

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of text in a block; 100 rows that are longer are a block of their own.
BLOCK = 32_000_000
#: Bytes of the longest word that is folded one merge at a time.
LONG = 200
_NONE = 2**31 - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def cached_ranks(path: str) -> dict[bytes, int]:
    """The worker's own copy, kept for its next tasks."""
    return load_ranks(path)


@cache
def cached_texts(path: str) -> tuple[pa.Array, pa.Array]:
    """Of each id from 0: its decimal digits with a space, and its bytes."""
    pieces = {rank: piece for piece, rank in cached_ranks(path).items()}
    n = max(pieces, default=-1) + 1
    return pa.array([b"%d " % i for i in range(n)], pa.large_binary()), pa.array([pieces.get(i) for i in range(n)], pa.large_binary())


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """array<binary>: the bytes of each id, from 0."""
    pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = base64.b64encode(piece).decode()
    return F.from_json(F.lit(json.dumps(pieces)), "array<binary>")


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once."""
    return F.transform(F.array(value), then)[0]


def pair_slots(pairs: dict[int, int]) -> tuple[list[int], list[int], int, int]:
    """(keys, ranks, n, m): ``pairs`` placed so that key k lies at k % n or at n + k % m."""
    n = _prime(len(pairs) * 9 // 8 + 3)  # less than half of the places are taken, so that most tries succeed
    while True:
        m = _prime(n + 2)
        at: dict[int, int] = {}
        for key in pairs:
            place, moves = key % n, 0
            while key is not None and moves < 200:
                key, at[place] = at.get(place), key
                if key is not None:
                    place, moves = (n + key % m if place < n else key % n), moves + 1
            if key is not None:
                break
        else:
            keys = [at.get(i, -1) for i in range(n + m)]
            return keys, [pairs.get(k, 0) for k in keys], n, m  # a free place is told by its key
        n = _prime(n + n // 4)


def _prime(n: int) -> int:
    """The least odd prime from ``n`` on."""
    n |= 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


class Merges:
    """The arrays of a rank map, as pairs of neighbours by ids: a table of one row."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        self.base = max(ranks.values(), default=0) + 1
        pairs = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        keys, found, self.n, self.m = pair_slots(pairs)
        own = {"keys": pa.array([keys], pa.list_(pa.int64())), "ranks": pa.array([found], pa.list_(pa.int32()))}
        own["bytes"] = pa.array([[ranks.get(bytes([i]), -1) for i in range(256)]], pa.list_(pa.int32()))
        self.row = spark.createDataFrame(pa.table(own))

    def beside(self, df: DataFrame, into: str) -> DataFrame:
        """``df`` with the row as a column. Used once, it is only named, not copied into each row."""
        return df.withColumn(into, self.row.select(F.struct(*self.row.columns)).scalar())

    def bound(self, row: Column, then) -> Column:
        """``then`` of the arrays of ``row``, named once."""

        def named(x: Column) -> Column:
            own = copy.copy(self)
            for name in self.row.columns:
                setattr(own, name, x[name])
            return then(own)

        return _let(row, named)

    def of_pair(self, left: Column, right: Column) -> Column:
        """The rank, and so the id, of two neighbours joined, else a number above all ranks."""

        def look(k: Column) -> Column:
            first, second = (k % self.n).cast("int"), (k % self.m + self.n).cast("int")
            hit = lambda at: F.when(F.get(self.keys, at) == k, F.get(self.ranks, at))
            return F.coalesce(hit(first), hit(second))

        return F.coalesce(F.when((left >= 0) & (right >= 0), _let(left.cast("long") * self.base + right, look)), F.lit(_NONE))


def encode_word(word: Column, merges: Merges) -> Column:
    """array<int>: ids of one binary word that is no token itself, by folding ranked merges over its bytes.

    The state holds ids ``t`` after a first -1, and ``r``, the rank of each id with the next.
    """
    bytes_ = F.split(F.decode(word, "ISO-8859-1"), "")
    ids = F.concat(F.array(F.lit(-1)), F.transform(bytes_, lambda c: F.get(merges.bytes, F.ascii(c))))

    def merge(state: Column, _: Column) -> Column:
        t, r = state["t"], state["r"]

        def at(m: Column, p: Column) -> Column:  # ids p and p + 1 (from 0) become m
            left, right = merges.of_pair(F.get(t, p - 1), m), merges.of_pair(m, F.get(t, p + 2))
            return F.struct(
                F.concat(F.slice(t, F.lit(1), p), F.array(m), F.slice(t, p + 3, F.size(t))).alias("t"),
                F.concat(F.slice(r, F.lit(1), p - 1), F.array(left, right), F.slice(r, p + 3, F.size(r))).alias("r"),
            )

        def least(m: Column) -> Column:
            leftmost = F.array_min(F.transform(r, lambda x, i: F.when(x == m, i)))
            return F.when(m == _NONE, state).otherwise(_let(leftmost, lambda p: at(m, p)))

        return _let(F.array_min(r), least)

    def pairs(t: Column) -> Column:
        return F.transform(t, lambda x, i: merges.of_pair(x, F.get(t, i + 1)))

    def round_(state: Column, _: Column) -> Column:
        t, r, m = state["t"], state["r"], state["m"]
        # of overlapping places the first, third, ... are merged
        marks = F.split(F.regexp_replace(F.array_join(F.transform(r, lambda x: F.when(x == m, "1").otherwise("0")), ""), "11", "10"), "")

        def merged(s: Column) -> Column:
            apart = F.transform(t, lambda x, i: F.when(F.get(s, i - 1) == "1", F.lit(None)).when(F.get(s, i) == "1", m).otherwise(x))
            # a merge on the way must not make a pair of lesser rank that a single merge would take next
            ahead = F.exists(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (F.get(s, i) == "1") & (merges.of_pair(m, F.get(t, i + 2)) < m))
            return _let(F.filter(apart, lambda x: x.isNotNull()), lambda u: _let(F.struct(u.alias("t"), pairs(u).alias("r")), lambda v: F.when(~ahead & (F.array_min(v["r"]) > m), v).otherwise(single())))

        def single() -> Column:
            stepped = merge(F.struct(t.alias("t"), r.alias("r")), F.lit(0))
            return F.struct(stepped["t"].alias("t"), stepped["r"].alias("r"))

        done = lambda v: F.struct(v["t"].alias("t"), v["r"].alias("r"), F.array_min(v["r"]).alias("m"))
        return F.when(m == _NONE, state).otherwise(_let(_let(marks, merged), done))

    def fold(t: Column) -> Column:
        return _let(F.struct(t.alias("t"), pairs(t).alias("r")), lambda start: F.when(F.size(t) <= LONG, F.aggregate(F.slice(t, 3, F.size(t)), start, merge)["t"]).otherwise(F.aggregate(F.slice(t, 3, F.size(t)), F.struct(start["t"].alias("t"), start["r"].alias("r"), F.array_min(start["r"]).alias("m")), round_)["t"]))

    folded = _let(_let(ids, fold), lambda t: F.slice(t, 2, F.size(t)))
    return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(folded)


def decode_ids(ids: Column, pieces: Column) -> Column:
    """binary: the pieces of ``ids``, one after the other."""
    return F.aggregate(ids, F.lit(b"").cast("binary"), lambda acc, i: F.concat(acc, F.get(pieces, i)))


class Block:
    """The texts of one block as codes of pieces, and its distinct pieces and words.

    A space or line feed between two characters that are no white space is a place where
    the pattern always begins a new match, so texts are cut there (a line feed goes to what
    follows, a space too) and all distinct pieces are split in one go. Texts with other
    white space (double spaces, say), and all texts under another pattern, are split whole;
    each of their words is a piece.
    """

    def __init__(self, texts: pa.ChunkedArray, find, cut: bool):
        texts = texts.combine_chunks()
        lengths, codes, pieces = coded_pieces(texts, " \n")
        pieces = listed(pieces)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        bare = [p[1:] if p[:1] == "\n" else p for p in pieces]
        odd = np.fromiter((not p or p[0].isspace() or p[-1].isspace() for p in bare), bool, len(bare))
        whole = np.logical_or.reduceat(odd[codes], first) if len(first) else np.zeros(0, bool)
        if not cut:
            whole[:] = True
        # each match that begins with a space or line feed begins a piece
        words = find("".join(p if p[:1] == "\n" else " " + p for p, o in zip(pieces, odd.tolist()) if not o))
        starts = np.flatnonzero(np.fromiter((w[0] in " \n" for w in words), bool, len(words)))
        sizes = np.diff(np.append(starts, len(words)))
        of_piece = np.cumsum(~odd) - 1
        own = np.where(odd, 0, of_piece)[codes].astype(np.int32)
        # a text's first piece has no space before it; whole texts are lists of words
        alone: dict[str, int] = {}
        more: list[list[str]] = []

        def added(key: str, words: list[str]) -> int:
            if key not in alone:
                alone[key] = len(sizes) + len(more)
                more.append(words)
            return alone[key]

        whole_codes: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(whole).tolist():
            whole_codes[k] = np.array([added("=" + w, [w]) for w in find(texts[k].as_py() or "")], np.int32)
        for k in np.flatnonzero(~whole).tolist():
            piece = pieces[codes[first[k]]]
            own[first[k]] = added("^" + piece, find(piece))
        if whole_codes:
            split = [whole_codes.get(k, c) for k, c in enumerate(np.split(own, first[1:]))]
            own, lengths = np.concatenate(split), np.fromiter(map(len, split), np.int64, len(split))
        for w in more:
            words += w
        del codes, pieces, bare
        coded = pa.array(words, pa.string()).dictionary_encode()
        self.lengths, self.codes = lengths.astype(np.int64), own
        self.sizes = np.concatenate([sizes, [len(w) for w in more]]).astype(np.int32)
        self.words, self.distinct = coded.indices, coded.dictionary


def _planes(values: np.ndarray) -> bytes:
    """As little-endian i32, all first bytes before all second ones and so on, which packs better."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _write_block(block: Block, ids: pa.Array, whole: np.ndarray, uri: str) -> None:
    """Five packed lists, each after its length: the ids with nulls, then ints; codes by falling frequency."""
    n = np.bincount(block.codes, minlength=len(block.sizes))
    order = np.argsort(-n, kind="stable")
    code = np.empty_like(order)
    code[order] = np.arange(len(order))
    lists = ragged(block.sizes, block.words).take(pa.array(order))
    known = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, ids.fill_null(0).to_numpy())
    parts = [known.astype("<i8").tobytes() + ids.is_null().to_numpy(zero_copy_only=False).tobytes(), *map(_planes, (block.lengths, code[block.codes], np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), whole))]
    pack = zstandard.ZstdCompressor(level=3)
    packed_ = [pack.compress(x) for x in parts]
    write_bytes(uri, [b"".join([struct.pack("<Q", len(x)), x]) for x in packed_])


def _read_block(uri: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, pieces in each text, code of each piece, words in each piece, those words, rank of each word or -1)."""
    body, at, parts = read_range(uri), 0, []
    unpack = zstandard.ZstdDecompressor()
    while at < len(body):
        (n,) = struct.unpack_from("<Q", body, at)
        parts.append(unpack.decompress(body[at + 8 : at + 8 + n]))
        at += 8 + n
    n = len(parts[0]) // 9
    ids = pa.array(np.frombuffer(parts[0], "<i8", n), pa.int64(), mask=np.frombuffer(parts[0], bool, n, 8 * n))
    return ids, *map(_from_planes, parts[1:])


def encode(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, ids array<int>, decoded binary, digests) for each row; see ``digested``."""
    return _assembled(docs, id_col, text, ranks_path, pattern, full=True)


def digested(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, without the ids themselves."""
    return _assembled(docs, id_col, text, ranks_path, pattern, full=False)


def words_of_blocks(docs: DataFrame, id_col: str, text: str, ranks_path: str, pattern: str, path: str) -> DataFrame:
    """(block, place, word): distinct words of each block that are no token themselves.

    The block's codes lie in a file; one row of place -1 and without a word tells that it is there.
    """
    out = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("word", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash

        find, cut = regex.compile(pattern).findall, pattern == public_tokenizers.PATTERN
        ranks = cached_ranks(ranks_path)
        held: list[pa.RecordBatch] = []
        size, made = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            mark = xxhash.xxh64(f"{TaskContext.get().partitionId()} {made}")
            for column in rows.columns:
                for buffer in column.chunk(0).buffers()[1:]:
                    mark.update(memoryview(buffer or b""))
            block = Block(rows.column(1), find, cut)
            name = mark.intdigest() >> 1
            words = block.distinct.cast(pa.binary())
            whole = np.fromiter((ranks.get(w, -1) for w in listed(words)), np.int32, len(words))
            _write_block(block, rows.column(0).combine_chunks(), whole, block_file(path, name))
            left = words.filter(pa.array(whole < 0))  # places count these only
            del block, rows, words
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([None], pa.binary())], schema=out)
            for at in range(0, len(left), 10_000):
                part = left[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), pa.array(np.arange(at, at + len(part)), pa.int32()), part], schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                own = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if held and size + own > BLOCK:
                    yield from flush()
                    size, made = 0, made + 1
                held.append(part)
                size += own
        if held:
            yield from flush()

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(split, "block long, place int, word binary")


def block_file(path: str, block: int) -> str:
    return f"{path}/{block}.block"


def folded_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, place, ids) of each row; a word is folded once, whatever its blocks. Without a word ids are null."""
    by = Window.partitionBy("word").orderBy("block")
    once = words.repartition(partitions(words.sparkSession), "word").withColumn("nth", F.row_number().over(by))
    merges = Merges(words.sparkSession, ranks)
    folded = merges.bound(F.col("merges"), lambda own: encode_word(F.col("word"), own))
    once = merges.beside(once, "merges").withColumn("own", F.when((F.col("nth") == 1) & F.col("word").isNotNull(), folded)).drop("merges")
    return once.select("block", "place", F.first("own", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("ids"))


def packed(words: DataFrame) -> DataFrame:
    """(block, payload): the (place, ids) rows of a block that a task holds, as few binaries.

    The row without ids stays as a null payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block, place = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int32)
            order = np.argsort(block, kind="stable")
            names, starts = np.unique(block[order], return_index=True)
            out = []
            for part in np.split(order, starts[1:]):
                own = rows.column(2).take(pa.array(part))
                sizes, ids = np.diff(own.offsets.to_numpy()), own.flatten().to_numpy().astype(np.int32)
                out.append(pack.compress(np.int32(len(part)).tobytes() + place[part].tobytes() + sizes.tobytes() + ids.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["block", "payload"])

        for batch in batches:
            alone = batch.filter(pc.less(batch.column(1), 0))
            if alone.num_rows:
                yield pa.RecordBatch.from_arrays([alone.column(0), pa.nulls(alone.num_rows, pa.binary())], ["block", "payload"])
            held.append(batch.filter(pc.greater_equal(batch.column(1), 0)))
            if sum(b.num_rows for b in held) >= 100_000:
                yield flush()
                held = []
        if sum(b.num_rows for b in held):
            yield flush()

    return words.mapInArrow(run, "block long, payload binary")


def _unpacked(payloads: list[bytes], whole: np.ndarray) -> pa.LargeListArray:
    """The ids of each word: its rank if it is a token itself, else what its place got."""
    unpack = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(unpack.decompress(x), np.int32) for x in payloads]
    token = np.flatnonzero(whole >= 0)
    left = np.flatnonzero(whole < 0)
    place = np.concatenate([left[x[1 : x[0] + 1]] for x in parts] + [token])
    if not np.array_equal(np.sort(place), np.arange(len(whole))):
        raise ValueError("a block lacks the ids of some words")
    sizes = np.concatenate([x[x[0] + 1 : 2 * x[0] + 1] for x in parts] + [np.ones(len(token), np.int32)])
    flat = np.concatenate([x[2 * x[0] + 1 :] for x in parts] + [whole[token]])
    return ragged(sizes, flat).take(pa.array(np.argsort(place)))


def _ends(values: pa.Array) -> np.ndarray:
    """Ends of the values in their common buffer, after a first 0."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(), dtype=np.int64)])


def _joined(of_id: pa.Array, ids: pa.LargeListArray) -> pa.LargeBinaryArray:
    """For each list, the binaries of its ids, one after the other."""
    found = of_id.take(ids.flatten())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.array(_ends(found)[ids.offsets.to_numpy()]).buffers()[1], found.buffers()[2]])


def _of_documents(piece: pa.LargeBinaryArray, codes: pa.Array, ends: np.ndarray) -> tuple[memoryview, list[int]]:
    """All documents' bytes in one buffer, and where each ends, after a first 0."""
    found = piece.take(codes)
    return memoryview(found.buffers()[2] or b""), _ends(found)[ends].tolist()


def _assembled(docs: DataFrame, id_col: str, text: str, ranks_path: str, pattern: str, full: bool) -> DataFrame:
    spark = docs.sparkSession
    path = shared_dir(spark)
    words = words_of_blocks(docs, id_col, text, ranks_path, pattern, path)
    # a block's payloads come first, then the null that stands for its file
    dealt = packed(folded_words(words, load_ranks(ranks_path))).repartition(partitions(spark), "block").sortWithinPartitions("block", F.col("payload").isNull())
    out = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if full else []
    schema = pa.schema(out)

    def of_block(name: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc_ids, lengths, codes, sizes, words, whole = _read_block(block_file(path, name))
        pieces = nested(sizes, words, _unpacked(held, whole))  # ids of each distinct piece
        numbers, binaries = cached_texts(ranks_path)
        decimal_of, bytes_of, n_of = _joined(numbers, pieces), _joined(binaries, pieces), np.diff(pieces.offsets.to_numpy())
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        k = 0
        while k < len(doc_ids):  # some texts at a time
            stop = max(k + 1, min(k + 500, int(np.searchsorted(ends, ends[k] + 300_000, side="right")) - 1))
            own, at = pa.array(codes[ends[k] : ends[stop]]), ends[k : stop + 1] - ends[k]
            decimal, d = _of_documents(decimal_of, own, at)
            body, b = _of_documents(bytes_of, own, at)
            n = np.concatenate([[0], np.cumsum(n_of[own.to_numpy()])])[at]
            texts = range(stop - k)
            digests = [[hashlib.sha256(decimal[d[i] : max(d[i], d[i + 1] - 1)]).hexdigest() for i in texts], [hashlib.sha256(body[b[i] : b[i + 1]]).hexdigest() for i in texts]]
            more = []
            if full:
                flat = pieces.take(own).flatten().cast(pa.int32())
                more = [pa.array([flat[n[i] : n[i + 1]] for i in texts], pa.list_(pa.int32())), pa.array([bytes(body[b[i] : b[i + 1]]) for i in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([doc_ids.slice(k, stop - k), pa.array(np.diff(n), pa.int64()), *map(pa.array, digests), *more], schema=schema)
            k = stop
        pa.default_memory_pool().release_unused()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and name != last:
                    raise ValueError("a block lacks its file")
                last = name
                if payload is None:
                    yield from of_block(name, held)
                    held = []
                else:
                    held.append(payload)
        if held:
            raise ValueError("a block lacks its file")

    made = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if full else "")
    return dealt.mapInArrow(assemble, made)


def decode(ids: DataFrame, *, ids_col: str = "ids", into: str = "decoded", ranks_path: str) -> DataFrame:
    """``ids`` with the bytes of each row's id array; null for null, empty for empty."""
    return ids.withColumn(into, decode_ids(F.col(f"`{ids_col}`"), piece_literal(load_ranks(ranks_path))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: digests of each document's ids and of the decoded bytes."""
    return digested(docs, ranks_path=public_tokenizers.path(RANKS)).withColumnRenamed("id", "doc_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)
