import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpairs.llm import bpe, decontaminate, licenses, neardup, ngrams, quality, shards, tokenids, urls, warc
from farpairs.llm.common import connected_components, shared_dir
from farpairs.llm.eliasfano import EliasFano, encode
from farpairs.tables import table

public_tokenizers = pytest.importorskip("public_tokenizers")


def rows(df):
    return [tuple(r) for r in df.collect()]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def near_brute(docs, n):
    """(id -> size, component, kept) by all pairs that share a shingle."""
    sets = {}
    for i, t in docs:
        w = split(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    up, held = {i: i for i in sets}, {}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in held.get(s, ()))
        for s in sets[i]:
            held.setdefault(s, []).append(i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 41), (41, 45), (7, 7), (None, 3)], "src long, dst long")
    found = dict(rows(connected_components(edges)))
    assert all(found[i] == 1 for i in range(1, 31)) and {found[i] for i in (41, 45, 50)} == {41}
    assert connected_components(edges.where("src > 99")).count() == 0


def test_licenses(spark, sf_dir, odd, none):
    got = {r["doc_id"]: r for r in licenses.op1_licenses(spark, sf_dir).collect()}
    for i, t in rows(table(spark, sf_dir, "documents").select("doc_id", "text")):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for label, p in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    mit = licenses.TEMPLATES["mit-text"][0]
    cut, changed = " ".join(mit.split()[:55]), mit.replace("merge publish distribute", "join print spread").replace("without warranty of any kind", "with no warranty at all and")
    made = [(1, "Licensed under the Apache License, Version 2.0. cc-by 4.0"), (2, "apache licenses"), (3, "x " + mit.upper()), (4, "y " + cut), (5, changed), (6, "permission is hereby granted to any person"), (7, "A MIT License. a mit license"), (8, "gnu general public license version 3"), (9, "This work is licensed under the GNU General Public License, version 3")]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert {k: (r["labels"], r["n_base"]) for k, r in found.items()} == {1: ("apache,apache-2.0,cc-by,cc-by-4.0", 2), 2: ("", 0), 3: ("mit-text", 0), 4: ("", 0), 5: ("mit-text", 0), 6: ("", 0), 7: ("mit", 2), 8: ("gpl", 1), 9: ("gpl,gpl-3.0", 1)}
    score = {k: r["score"] for k, r in found.items()}
    assert score[1] == score[3] == score[9] == 1.0 and score[2] == score[6] == 0.0 and 0.4 < score[4] < 0.6 < score[5] < 1 and 0 < score[7] < 1 and 0 < score[8] < 1
    assert [(p["label"], p["start"]) for p in found[5]["places"]] == [("mit-text", 0)] and [(p["label"], p["start"]) for p in found[7]["places"]] == [("mit", 1), ("mit", 4)]
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def test_decontamination(spark, sf_dir, odd, none):
    item = " ".join(f"bench{i}" for i in range(40))
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (5, item + " tail")], "item_id long, text string")
    edited = item.replace("bench20 ", "other ")
    docs = spark.createDataFrame([(1, "a b c " + item.upper() + ". d e"), (2, "x " + edited + " y"), (3, "nothing here"), (4, "so a Tiny, item it is"), (5, None), (None, item), (6, " ".join(item.split()[:12]))], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, items).collect()}
    assert found[1, 1]["similarity"] == 1.0 and found[1, 1]["start"] == 3 and found[1, 1]["hamming"] == 0
    assert (2, 1) in found and 0.8 <= found[2, 1]["similarity"] < 1 and (4, 2) in found and (None, 1) in found
    assert not {i for i, _ in found} & {3, 5, 6}
    assert decontaminate.leaks(odd, items).count() == 0 and decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(docs, items.where("item_id > 9")).count() == 0
    plain = lambda t: b" ".join(decontaminate.plain_words(t))
    bench = rows(table(spark, sf_dir, "benchmark"))
    exact = {(i, j) for i, t in rows(table(spark, sf_dir, "documents").select("doc_id", "text")) for j, x in bench if plain(x) in plain(t)}
    assert exact == set(rows(decontaminate.op2_decontaminate(spark, sf_dir).select("doc_id", "item_id")))


def test_decontamination_of_edited_passages(spark):
    """Every pair that brute force finds by the weighted Dice, near the threshold too."""
    tail = " ".join(f"common{k}" for k in range(14))
    items = {i: " ".join(f"i{i}w{k}" for k in range(10 + i % 40)) + (" " + tail if i % 2 else "") for i in range(120)}
    docs = {}
    for i, t in items.items():
        for d in range(6):
            w = t.split()
            if i % 2 and d < 3:
                w[-14:] = [f"d{i}x{d}x{k}" for k in range(14 - d)]
            else:
                w[-1 - d] = w[d % 2 * len(w) // 2] = f"e{i}x{d}"
            docs[10 * i + d] = " ".join(["a", "b", *w, "c", "d"])
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    of = {i: grams(t.split()) for i, t in items.items()}
    df = Counter(s for x in of.values() for s in x)
    want = {}
    for d, t in docs.items():
        w = t.split()
        for i, b in of.items():
            size, best = len(items[i].split()), 0.0
            for s in range(max(1, len(w) - size + 1)):
                a = grams(w[s : s + size])
                weight = lambda x: 1 + math.log(len(items) / df[x]) if x in b else 1 + math.log(len(items))  # noqa: E731, B023
                common = sum(weight(x) * min(n, b[x]) for x, n in a.items() if x in b)
                if common:
                    best = max(best, 2 * common / (sum(weight(x) * n for x, n in a.items()) + sum(weight(x) * n for x, n in b.items())))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    made = lambda x, name: spark.createDataFrame(list(x.items()), f"{name} long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.leaks(made(docs, "doc_id"), made(items, "item_id")).collect()}
    close = [k for k, v in want.items() if v < 0.85]
    found = sum(k in got for k in close)
    assert len(close) > 50 and found == len(close), f"{found} of {len(close)} below 0.85, {len(got)} of {len(want)} in all"
    assert {k: x["similarity"] for k, x in got.items()} == pytest.approx(want, abs=1e-8)
    assert any(x["hamming"] > decontaminate.RADIUS for x in got.values())


def test_keys_within_radius():
    r = np.random.RandomState(3)
    for _ in range(50):
        a = int(r.randint(0, 2**62))
        b = a
        for k in r.choice(64, decontaminate.RADIUS, replace=False):
            b ^= 1 << int(k)
        met = [((a >> s) & ((1 << n) - 1)) in decontaminate.near_keys((b >> s) & ((1 << n) - 1), n) for s, n in decontaminate.BLOCKS]
        assert any(met)


def test_bpe(spark, odd, none):
    import tiktoken

    path = public_tokenizers.path(bpe.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = bpe.encode(odd, ranks_path=path)
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows(odd.select("doc_id", "text")))
    assert sorted((str(i), list(x), bytes(d)) for i, x, d in rows(got.select("id", "ids", "decoded"))) == want
    again = bpe.decode(got.select("ids", "decoded"), into="again", ranks_path=path)
    assert again.where("again <> decoded").count() == 0
    for r in got.collect():
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert bpe.encode(none, ranks_path=path).count() == 0


def test_bpe_of_long_words_and_white_space(spark):
    """Words of thousands of bytes, all kinds of white space, and blocks of a few texts each."""
    import tiktoken

    path = public_tokenizers.path(bpe.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    r = np.random.RandomState(2)
    letters = np.array(list("etaoinshrdlucmfgypw"))
    texts = ["a" * 3001, "漢字" * 700, "".join(r.choice(letters, 4000)), "ab" * 999 + "a" * 333, "=" * 777 + "-" * 501, "banana" * 300]
    texts += ["two  spaces", " lead", "trail ", "a\n\nb", "\n", " ", "tab\tand \x1c odd\u00a0 x", "line one\nline two's\n'll do", "x \n y", "don't\r\nstop 12345 ...!? (ok)", "it 's"]
    texts += ["".join(r.choice([*" \n\t'sx1.é漢", "the", "ing"], 30)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["id"]: list(x["ids"]) for x in bpe.encode(docs, ranks_path=path).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_neardup(spark, sf_dir, odd, none):
    docs = rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    assert {r[0]: r[1:] for r in rows(neardup.op4_neardup(spark, sf_dir))} == near_brute(docs, 4)
    found = rows(neardup.components(odd, shingle=4))
    by = {r[0]: r for r in found}
    assert len(found) == odd.count() and by[1] == (1, 0, 1, True) and by[3][1:] == (0, 3, True)
    assert by[5][2] == 4 and by[7][2] == 6 and by[9][2] == 8 and by[None][2:] == (None, True)
    assert neardup.components(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v")], "doc_id long, text string")
    assert {r[0]: r[2] for r in rows(neardup.components(twice, shingle=4))} == {1: 1, 2: 1}


def test_neardup_hot_group(spark):
    r = np.random.RandomState(5)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(w if r.rand() > 0.02 else f"x{r.randint(10**6)}" for w in base)) for i in range(400)]
    docs += [(1000 + i, " ".join(base[:40]) + " " + " ".join(f"y{r.randint(10**7)}" for _ in range(110))) for i in range(200)]
    got = {x[0]: x[1:] for x in rows(neardup.components(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4))}
    assert got == near_brute(docs, 4)


def test_token_ids(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenids.TOKENIZER)
    library = Tokenizer.from_file(path)
    where = shared_dir(spark)
    written = tokenids.write_ids(odd, where, tokenizer=path)
    got = rows(tokenids.read_ids(written, where).orderBy("start"))
    want, at = [], 0
    for i, t in sorted(rows(odd.select("doc_id", "text")), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.asarray(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), ids.tobytes(), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [(r[0], r[1], r[2], bytes(r[3]), r[4]) for r in got] == want
    name = written.orderBy("shard").first()["file"]
    digest, index = tokenids.read_index(name)
    dictionary = tokenids.read_range(f"{where}/dictionary")
    assert digest == hashlib.sha256(dictionary).digest()
    assert tokenids.read_document(name, index[-1], dictionary)[-1] == 2
    empty = shared_dir(spark)
    assert tokenids.read_ids(tokenids.write_ids(none, empty, tokenizer=path), empty).count() == 0


def test_token_ids_of_marker_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenids.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "<|startoftext|>", "glued<|endoftext|>word <|startoftext|>a.", "end <|endoftext|>. Then\n<|startoftext|>x, <|ENDOFTEXT|>!"]
    where = shared_dir(spark)
    written = tokenids.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), where, tokenizer=path)
    got = [np.frombuffer(r["ids"], "<u4").tolist() for r in tokenids.read_ids(written, where).orderBy("start").collect()]
    assert got == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts] and got[0] == [3306, 49407, 1002, 2]


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 100), (1000, 10**12), (20_000, 25_000), (3000, 2**63 - 1)])
def test_elias_fano(n, universe):
    r = np.random.RandomState(1)
    values = np.sort(r.randint(0, universe, n))
    ef = EliasFano(encode(values, universe))
    assert (ef.values() == values.astype(np.uint64)).all()
    for m in (3, 4000):
        x = np.sort(np.concatenate([r.randint(0, universe, m), values[: m // 2]]))
        assert (ef.successor(x) == np.searchsorted(values, x)).all() and ((ef.find(x) >= 0) == np.isin(x, values)).all()


def test_language_model(spark, sf_dir, odd, none):
    got = {r["doc_id"]: r for r in ngrams.op6_lm_score(spark, sf_dir).collect()}
    docs = [(i, [*split(t), ""]) for i, t in rows(table(spark, sf_dir, "documents").select("doc_id", "text"))]
    training = [w for i, w in docs if zlib.crc32(str(i).encode()) % 10]
    c = Counter(x for w in training for x in w)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for w in training for p in zip(["<s>", *w], w))
    first, followers = Counter(), Counter()
    for (a, _), k in pairs.items():
        first[a] += k
        followers[a] += 1
    for i, w in docs:
        p = lambda x: (c[x] + 0.1) / (n + 0.1 * (v + 1))
        model = sum(math.log10((max(pairs[a, b] - 0.75, 0) + 0.75 * followers[a] * p(b)) / first[a] if first[a] else p(b)) for a, b in zip(["<s>", *w], w))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r["base_score"] - sum(math.log10(p(x)) for x in w)) < 1e-6 and abs(r["score"] - model) < 5e-4 * len(w)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    own = odd.select(F.col("doc_id").alias("id"), "text")
    assert ngrams.score(own, ngrams.train(own, shared_dir(spark))).count() == odd.count()
    assert ngrams.score(own, ngrams.train(own.where("id > 99"), shared_dir(spark))).count() == odd.count()
    assert ngrams.score(none.select(F.col("doc_id").alias("id"), "text"), ngrams.train(own, shared_dir(spark))).count() == 0


def test_quality(spark, sf_dir, odd, none):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(map(tuple, con.sql(f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from ({quality.OP7_SQL})").fetchall()))
    assert sorted(rows(quality.op7_quality_rules(spark, sf_dir))) == want
    judged = {r["doc_id"]: r["quality_"] for r in quality.quality_rules(odd, into="quality").collect()}
    assert judged[1]["base_failed"] and judged[1]["n_words"] == 0 and judged[4]["n_words"] == 30_000 and not judged[4]["kept"]
    assert quality.stage(spark, odd, "").columns == odd.columns
    assert quality.quality_rules(none).count() == 0


def test_shards(spark, sf_dir, odd, none):
    for placed, n in ((shards.op8_shards(spark, sf_dir), 200), (shards.assign(odd), odd.count())):
        found = placed.toPandas()
        assert len(found) == n
        for _, own in found.groupby("shard"):
            assert sorted(own["slot"]) == list(range(len(own)))
        sizes = found.groupby("shard")["size"].sum()
        assert sizes.max() <= found["size"].sum() / 24 + 2 * found["size"].max()
    docs = rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = {r["doc_id"]: r for r in shards.op8_shards(spark, sf_dir).collect()}
    crc = lambda t: zlib.crc32((t or "").encode())
    assert {i: (r["size"], r["text_crc32"]) for i, r in found.items()} == {i: (len((t or "").encode()) + 8, crc(t)) for i, t in docs}
    # by brute force: all rows in the order of their keys, cut where a shard's even share ends
    md5 = lambda x: int(hashlib.md5(x).hexdigest()[:15], 16)
    order = sorted((md5((t or "").encode()), md5(str(i).encode()), i) for i, t in docs)
    assert [i for _, _, i in order] == sorted(found, key=lambda i: (found[i]["shard"], found[i]["slot"]))
    total, below = sum(r["size"] for r in found.values()), 0
    for k, (_, _, i) in enumerate(order[:-1]):
        below += found[i]["size"]
        if found[order[k + 1][2]]["shard"] != found[i]["shard"]:  # a row more or less would be farther off, or within the tolerance
            aim = total * found[order[k + 1][2]]["shard"] / 24
            nearest = min(abs(below - aim), abs(below - found[i]["size"] - aim), abs(below + found[order[k + 1][2]]["size"] - aim))
            assert abs(below - aim) <= max(nearest, shards.TOLERANCE * total / 24) + 1e-6
    assert shards.assign(none).count() == 0
    path = shards.write_shards(odd, 3)
    assert spark.read.parquet(path).count() == odd.count()


def test_urls(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.example.com/en/x", None), (2, "https://www.example.com/en/y", ""), (3, "http://q.net/es/1", "<p>"), (4, "http://other.org/z", '<link rel="canonical" href="http://q.net/es/1">'),
            (5, "http://third.org/r", '<meta http-equiv="refresh" content="0; url=http://other.org/z">'), (6, None, None), (7, "no scheme", None), (8, "http://b.com", None), (8, "http://b.com", None),
            (9, "http://ok.com/a", '<link href="http://q.net/fr/9" rel="canonical">'), (10, "HTTP://Net.ORG/ES/", None),
        ],
        "page_id long, url string, html string",
    )
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, urls.RULES).collect()}
    assert found[1] == ("example.com/en/", "block") and found[2] == ("www.example.com/en/", "allow") and found[3] == ("net/es/", "block")
    assert found[4] == (None, "block") and found[5] == (None, "block") and found[6] == (None, "allow") == found[7] == found[8]
    assert found[9] == ("com/", "allow") and found[10] == (None, "allow")
    assert urls.judge(pages.where("page_id > 99"), urls.RULES).count() == 0


def test_warc(spark):
    body = "<html>" + "x" * 200
    pages = spark.createDataFrame([(3, "u3", body), (1, "u1", body), (2, None, None), (4, "u4", "short"), (5, "u5", "short"), (None, "u", body), (6, "u\r\n6", "é" * 80), (1, "u1", body)], "page_id long, url string, html string")
    files = warc.write_archives(pages, shared_dir(spark))
    found = {r["id"]: r for r in warc.read_archives(files).collect()}
    assert found[1]["record_type"] == "response" and found[3]["record_type"] == "revisit" == found[None]["record_type"]
    assert found[3]["refers_record"] == found[1]["record_id"] and found[3]["payload_bytes"] == len(body) and found[3]["payload_digest"] == hashlib.sha256(body.encode()).hexdigest()
    assert found[4]["record_type"] == found[5]["record_type"] == "response" and bytes(found[6]["payload"]) == ("é" * 80).encode() and bytes(found[2]["payload"]) == b""
    assert warc.read_archives(warc.write_archives(pages.where("page_id > 99"), shared_dir(spark))).count() == 0


def test_warc_query(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = sorted(map(tuple, con.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.OP10_SQL})").fetchall()))
    assert sorted(rows(warc.op10_warc(spark, sf_dir))) == want


def test_pipeline(spark, sf_dir):
    import tiktoken

    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    good = {r["doc_id"] for r in quality.op7_quality_rules(spark, sf_dir).where("kept").collect()}
    left = [(i, t) for i, t in rows(docs.select("doc_id", "text")) if i in good]
    kept = {i for i, x in near_brute(left, 5).items() if x[2]}
    plain = lambda t: b" ".join(decontaminate.plain_words(t))
    items = [plain(t) for _, t in rows(table(spark, sf_dir, "benchmark"))]
    want = {i: t for i, t in left if i in kept and not any(x in plain(t) for x in items)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: (len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in want.items()}


def test_stages_on_odd_rows(spark, odd, none, sf_dir):
    for stage in (quality.stage, neardup.stage, decontaminate.stage):
        assert stage(spark, odd, sf_dir).columns == odd.columns and stage(spark, none, sf_dir).count() == 0
    kept = sorted(str(r["doc_id"]) for r in neardup.stage(spark, odd, sf_dir).collect())
    assert kept.count("6") == 1 and "7" not in kept and "5" not in kept and "None" in kept


def test_encoder_against_the_library():
    """Pieces of all kinds, word by word and text by text, with a memory that starts anew."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenids.TOKENIZER)
    library, own = Tokenizer.from_file(path), tokenids.Encoder(path, 2)
    r = np.random.RandomState(4)
    parts = ["the", "Tokens", "re", "é", "Éà", "İ", "ß", "ﬁ", "é", "한", "ᄒ", "ᅡ", "漢", "1", "²", "½", "٣", "'s", "'LL", "'", "<", "|", "<|endoftext|>", "%%%", "...", " ", "­", "\t", "\x1c", "\x00", " ", " ", " ", "\n", "  ", "ª", "😀", "​", "x" * 40]
    texts = ["".join(r.choice(parts, r.randint(1, 25))) for _ in range(3000)] + ["", " ", "\n", None]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in own.texts(pa.array(texts, pa.string()))]
        for t, x in zip(texts, got):
            assert x == library.encode(t or "", add_special_tokens=False).ids + [2], repr(t)
    own.forget()
    assert [len(x) // 4 for x in own.texts(pa.array(texts[:5], pa.string()))] == [len(x) for x in got[:5]]
