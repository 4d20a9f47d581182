import pytest

from farpairs.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_ranks_are_no_literals_of_the_folds(spark, capsys):
    """A literal is an object for each number, in each task; a column would be a copy for each row."""
    import tiktoken

    path = public_tokenizers.path(bpe.RANKS)
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [f" wo{i * 7919}rd" for i in range(50)] + ["漢字é", " ", "zzzzzz"]
    rows = [(b, k, w.encode()) for b in (1, 2) for k, w in enumerate(words)] + [(1, -1, None), (2, -1, None)]
    found = bpe.folded_words(spark.createDataFrame(rows, "block long, place int, word binary"), ranks)
    found.explain(True)
    plan = capsys.readouterr().out
    assert len(plan) < 200_000  # the ranks as literals have over a million characters
    physical = plan.partition("== Physical Plan ==")[2]
    assert "ubquery" in physical and "AS merges" not in physical
    got = {(r["block"], r["place"]): r["ids"] for r in found.collect()}
    of_word = [library._encode_single_piece(w.encode()) for w in words]
    assert got == {(b, k): x for b in (1, 2) for k, x in enumerate(of_word)} | {(1, -1): None, (2, -1): None}


def test_windows_look_up_known_shingles_only(spark, monkeypatch):
    """Few look-ups, whatever the number of lengths, and every window with enough shingles of an item of its length."""
    import numpy as np
    import pyarrow as pa

    from farpairs.llm import decontaminate as d
    from farpairs.llm.words import Hashes, plain_words, shingles

    class Taken:
        """A frame that only keeps the function of its tasks."""

        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            self.function = function

    r = np.random.RandomState(5)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate([*range(3, 40)] * 2)]
    texts = [[f"t{j}" for j in r.randint(0, 900, 3000)], ["a", "b"], []]
    for k, item in enumerate(items):
        own = [f"t{j}" for j in r.randint(0, 900, 30)] + item + item[:9]
        for at in r.randint(0, len(own), 2):
            own[at] = "edited"
        texts.append(own if k % 3 else own + items[-1 - k])
    of = lambda words, n: shingles(Hashes().of(plain_words(" ".join(words))), n)
    found = {k: of(item, 5) for k, item in enumerate(items)}
    screen = np.zeros(1 << (d.SCREEN - 6), np.uint64)
    for k, item in enumerate(items):
        for length in (0, len(item)):
            bits = d._slot(found[k], length)
            np.bitwise_or.at(screen, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
    lengths, share = sorted({len(x) for x in items}), 0.66
    want = set()
    for i, text in enumerate(texts):
        for length in lengths:
            size = min(5, length)
            if len(text) >= size:
                known = np.isin(of(text, size), np.concatenate([found[k] for k, x in enumerate(items) if len(x) == length]))
                m = min(length - size + 1, len(known))
                want |= {(i, s, length) for s in range(len(known) - m + 1) if known[s : s + m].sum() >= max(1.0, share * m - 1e-9)}
    docs = Taken()
    d.windows(docs, "id", "text", lengths, screen, screen, share)

    def windows_of(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([" ".join(x) for x in texts])], ["id", "text"])
        return {(x["doc_id"], x["start"], x["length"]) for b in docs.function(iter([batch])) for x in b.to_pylist()}

    assert len(want) > 100 and want <= windows_of(texts)
    looked, slot = [], d._slot
    monkeypatch.setattr(d, "_slot", lambda x, length: (looked.append(len(x)), slot(x, length))[1])
    long = texts[0] + items[30]
    assert (0, len(texts[0]), len(items[30])) in windows_of([long])
    assert sum(looked) < 10 * len(long)  # each of 37 lengths looked up each shingle before
