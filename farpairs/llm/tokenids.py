"""5. Token ids as binary files with a shared zstandard dictionary.

Documents are dealt by id ranges and sorted. Each task encodes its texts with the
tokenizers library, appends the end id, compresses each document by itself with one
shared dictionary and writes a shard file:

    magic "FPTI", version (u32), dictionary hash (32 bytes), documents (u64),
    frames, one after the other, then the index: for each document its id (i64),
    place of its frame (u64), its bytes (u64), tokens (u64), null-id flag (u8),
    and at the very end the index's place (u64).

The dictionary is trained on about ``SAMPLE`` documents (those of least id hash);
any document can be read without its neighbours by the index. Tasks write under
unique names and report them, so only successful attempts' files are read. A
shard's first token is the sum of the shards before it (one row per shard).

White space splits a text for the tokenizer exactly (it drops white space), so each
worker remembers the ids of recent words, about ``CACHE`` of them.

The tokenizer's own markers (<|startoftext|>, <|endoftext|>) in a text get their single
ids, as the library gives them by default; they hold no white space, so the cuts stay
exact.

Defined results: null and empty texts hold the end id only; a null id sorts first;
rows that share an id are ordered by text; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.common import materialize, partitions, shared_dir
from farpairs.llm.files import read_range, read_tail, write_bytes
from farpairs.llm.pieces import coded_pieces, listed, nested, ragged, stepped
from farpairs.tables import table

TOKENIZER, END = "word_bpe_49k.json", 2
#: Documents that train the dictionary, its bytes, and the level of compression.
SAMPLE, DICTIONARY, LEVEL = 1000, 64 * 1024, 3
#: Words that a worker remembers before it starts anew, and bytes of text that it encodes at a time.
CACHE, STEP = 400_000, 8_000_000
_HEAD = "<4sI32sQ"
HEAD_BYTES = struct.calcsize(_HEAD)
_INDEX = np.dtype([("id", "<i8"), ("at", "<u8"), ("bytes", "<u8"), ("tokens", "<u8"), ("null", "u1")])


#: A character at which the tokenizer may not simply cut a piece into its words.
ODD = r"[\x00-\x20\x7F-\x{A0}'<\x{130}\x{300}-\x{10FFFF}]"


class Places(dict):
    def __missing__(self, word: str) -> int:
        return -1


class Encoder:
    """Ids of whole texts, each with the end id.

    The tokenizer drops white space in any place and closes each word with a marked token.
    So texts are cut at spaces and line feeds, and pieces without the characters at which
    it may behave otherwise (apostrophes, "<" of its markers, controls, U+0130, whose lower case is two characters,
    all from U+0300 on, where characters may compose) are cut into its words: runs of letters, single numbers,
    runs of other characters. Words are remembered, and new ones encoded many in a call;
    if the closing tokens do not count up, and for all other pieces, one by one.
    A tokenizer without closing tokens encodes whole texts.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if mark:
            self.closing[[i for w, i in vocabulary.items() if w.endswith(mark)]] = True
        self.words = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n").findall
        self.forget()

    def forget(self) -> None:
        self.seen = Places({"\n": -2})
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for k in range(0, len(texts), 1000) for e in self.tokenizer.encode_batch_fast(texts[k : k + 1000], add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32)

    def _learn(self, keys: list[str], texts: list[str], joined: bool) -> None:
        """Remember the ids of ``texts`` by ``keys``; joined: each is one word."""
        for k in range(0, len(texts), 500):
            part = texts[k : k + 500]
            if joined:
                flat = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                sizes = np.diff(np.flatnonzero(self.closing[flat]), prepend=-1)
            if not joined or len(sizes) != len(part) or sizes.sum() != len(flat):
                sizes, flat = self._encoded(part)
            self.seen.update(zip(keys[k : k + 500], range(len(self.seen) - 1, len(self.seen) - 1 + len(part))))
            self._more.append((sizes, flat))

    def ids(self, texts: pa.Array) -> pa.LargeListArray:
        """The ids of each text and the end id; a null is an empty text."""
        if not self.closing.any():
            sizes, flat = self._encoded([t or "" for t in texts.to_pylist()])
            return ragged(sizes + 1, np.insert(flat, np.cumsum(sizes), self.end).astype(np.uint32))
        if len(self.seen) > CACHE:
            self.forget()
        self._more: list[tuple[np.ndarray, np.ndarray]] = []
        lengths, codes, pieces = coded_pieces(texts, " ")
        plain = pc.invert(pc.match_substring_regex(pieces, ODD))
        alpha = pc.and_(plain, pc.utf8_is_alpha(pieces))
        mixed = pc.and_not(plain, alpha)
        found = listed(pieces.filter(alpha))
        n_alpha = len(found)
        found += self.words("".join([p + "\n" for p in listed(pieces.filter(mixed))]))
        odd = ["\n" + p for p in listed(pieces.filter(pc.invert(plain)))]
        look = lambda x: np.fromiter(map(self.seen.__getitem__, x), np.int64, len(x))
        words, others = look(found), look(odd)
        fresh = np.flatnonzero(words == -1).tolist()
        new = list(dict.fromkeys([found[k] for k in fresh]))
        self._learn(new, new, True)
        words[fresh] = look([found[k] for k in fresh])
        new = [odd[k] for k in np.flatnonzero(others == -1).tolist()]
        self._learn(new, [p[1:] for p in new], False)
        others = look(odd)
        self.sizes = np.concatenate([self.sizes, *(x for x, _ in self._more)])
        self.flat = np.concatenate([self.flat, *(x for _, x in self._more)])
        # the words of each distinct piece: of one word, of several, those that were encoded alone, the end
        ends = np.flatnonzero(words[n_alpha:] == -2)
        sizes = np.concatenate([np.ones(n_alpha, np.int64), np.diff(ends, prepend=-1) - 1, np.ones(len(odd) + 1, np.int64)])
        words = np.concatenate([words[words >= 0], others, [len(self.sizes)]])
        known = ragged(np.append(self.sizes, 1), np.append(self.flat, np.uint32(self.end)).astype(np.uint32))
        of_piece = nested(sizes, words, known)
        kinds = np.where(alpha.to_numpy(zero_copy_only=False), 0, np.where(mixed.to_numpy(zero_copy_only=False), 1, 2))
        place = np.empty(len(pieces), np.int64)
        place[np.argsort(kinds, kind="stable")] = np.arange(len(pieces))
        return nested(lengths + 1, np.insert(place[codes], np.cumsum(lengths), len(pieces)), of_piece)

    def texts(self, texts: pa.Array) -> list[bytes]:
        """As little-endian u32 bytes."""
        ids = self.ids(texts)
        body, ends = ids.values.to_numpy().astype("<u4").tobytes(), (4 * ids.offsets.to_numpy()).tolist()
        return [body[a:b] for a, b in zip(ends, ends[1:])]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """The worker's own encoder, kept for its next tasks."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def train_dictionary(docs: DataFrame, id_col: str, text: str, tokenizer: str, end: int = END, sample: int = SAMPLE) -> bytes:
    """A dictionary from the ids of about ``sample`` documents, twice as many at most; empty if too few to train."""
    share = min(1.0, sample / max(docs.count(), 1))
    few = docs.where(F.xxhash64(F.col(f"`{id_col}`").cast("string")) <= min(int(-(2**63) + share * 2**64), 2**63 - 1)).select(F.col(f"`{text}`").cast("string").alias("t"))
    samples = Encoder(tokenizer, end).texts(pa.array([r["t"] for r in few.limit(2 * sample).collect()], pa.string()))
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text", tokenizer: str, end: int = END) -> DataFrame:
    """Write shard files below ``path``; returns (shard, file, documents, tokens), once."""
    trained = train_dictionary(docs, id_col, text, tokenizer, end)
    write_bytes(f"{path}/dictionary", [trained])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end).texts
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        frames, index, at, shard = [], [], HEAD_BYTES, 0
        for rows in stepped(batches, STEP):
            shard = rows.column(2)[0].as_py()
            for i, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1))):
                frame = pack.compress(ids)
                frames.append(frame)
                index.append((0 if i is None else i, at, len(frame), len(ids) // 4, i is None))
                at += len(frame)
        if index:
            name = f"{path}/{uuid.uuid4().hex}.ids"
            table_ = np.array(index, _INDEX)
            write_bytes(name, [struct.pack(_HEAD, b"FPTI", 1, hashlib.sha256(trained).digest(), len(index)), *frames, table_.tobytes(), struct.pack("<Q", at)])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([int(table_["tokens"].sum())], pa.int64())], ["shard", "file", "documents", "tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text").withColumn("shard", F.spark_partition_id().cast("long"))
    return materialize(dealt.mapInArrow(run, "shard long, file string, documents long, tokens long"))


def read_index(uri: str) -> tuple[bytes, np.ndarray]:
    """(dictionary hash, index rows) of a shard file, from its head and its end alone."""
    magic, version, digest, n = struct.unpack(_HEAD, read_range(uri, 0, HEAD_BYTES))
    if (magic, version) != (b"FPTI", 1):
        raise ValueError(f"{uri} is not a token id file")
    return digest, np.frombuffer(read_tail(uri, n * _INDEX.itemsize + 8), _INDEX, n)


def read_document(uri: str, row: np.void, dictionary: bytes) -> np.ndarray:
    """Ids of one document, by its index row, without reading the rest of the shard."""
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return np.frombuffer(unpack.decompress(read_range(uri, int(row["at"]), int(row["bytes"]))), "<u4")


def read_ids(shards: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary, ids_crc32) of all documents in ``shards``."""
    trained = read_range(f"{path}/dictionary")
    first = F.expr("coalesce(sum(tokens) over (order by shard rows between unbounded preceding and 1 preceding), 0)")
    # one file a task, whatever the files' rows take
    files = materialize(shards.select("file", "shard", first.alias("first"))).repartition(partitions(shards.sparkSession), "file")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                digest, index = read_index(name)
                if digest != hashlib.sha256(trained).digest():
                    raise ValueError(f"{name} was written with another dictionary")
                n = len(index)
                starts = first + np.concatenate([[0], np.cumsum(index["tokens"].astype(np.int64))[:-1]]) if n else []
                for part in range(0, n, 500):
                    own = index[part : part + 500]
                    at = int(own["at"][0])
                    data = read_range(name, at, int(own["bytes"].sum()))
                    ids = [unpack.decompress(data[a - at : a - at + b]) for a, b in zip(own["at"].tolist(), own["bytes"].tolist())]
                    doc = pa.array(own["id"], pa.int64(), mask=own["null"].astype(bool))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(starts[part : part + 500], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], schema=schema)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    shards = write_ids(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path(TOKENIZER))
    return read_ids(shards, path).drop("ids")
