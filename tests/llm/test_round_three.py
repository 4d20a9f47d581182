"""Main text, ranked search, collocations, rules by table and links of every page, against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from farpairs.llm import collocations, extraction, quality, ranked, urls
from farpairs.llm.blocks import Block, read
from farpairs.llm.mincut import Cut
from farpairs.tables import table


def rows(df):
    return [tuple(r) for r in df.collect()]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# main text


def test_cut_against_all_labellings():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 7)
        cost = [(r.randint(0, 6), r.randint(0, 6)) for _ in range(n)]
        edges = [(a, b, r.randint(0, 4)) for a in range(n) for b in range(a)]
        cut = Cut(n)
        for k, (out, in_) in enumerate(cost):
            cut.costs(k, out, in_)
        for a, b, w in edges:
            cut.edge(a, b, w, w)
        side = cut.source_side()
        value = lambda x: sum(c[1] if x[k] else c[0] for k, c in enumerate(cost)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: E731, B023
        assert value(side) == min(value(x) for x in itertools.product([False, True], repeat=n))


def texts(page):
    return [(b.text, b.side) for b in read(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<br>d &amp; &lt;e&gt;\n f<p>g<div>h</div>i") == [("a bc d & <e> f", 0), ("g", 0), ("h", 0), ("i", 0)]
    assert texts('<script>var t = "<p>x</p>";</script><style>p{}</style><!-- <p>no -->y<noscript>z</noscript><title>t</title>') == [("y", 0)]
    assert texts("<nav><ul><li>m<li>n</ul></nav><main><p>text<aside>side</aside><footer>f</footer></main>") == [("m", -1), ("n", -1), ("text", 1), ("side", -1), ("f", -1)]
    assert texts("<body class='has-sidebar'><div class='cookie-notice'>c</div><div id=content>d</div><form><article>e</article><p>g</form>") == [("c", -1), ("d", 0), ("e", 1), ("g", -1)]
    assert texts("<article>a<div class='comments'>b</div><div class=ad>c</div><header><h1>d</h1></header></article><header>e</header>") == [("a", 1), ("b", -1), ("c", -1), ("d", 1), ("e", -1)]
    assert texts("<a title='x > y'>k</a> <p title=\"un> l") == [("k", 0), ("l", 0)] and texts("a < b <3 c") == [("a < b <3 c", 0)]
    assert texts("") == [] and texts("<") == [("<", 0)] and texts("<p") == [] and texts("</p></div>x</li>") == [("x", 0)]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<ul><li>e</ul>f<li>g</ul>") == [(x, 0) for x in "abcdefg"]
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert texts(deep) == [("x", 0)]


def test_main_text(spark, sf_dir, none):
    def expected(page):
        inner = re.search("(?s)<article>(.*)</article>", page)[1]
        parts = [re.sub(r"<[^>]*>", " ", x) for x in re.split("</?(?:p|h1)>", inner)]
        import html

        return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)

    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in extraction.op11_main_text(spark, sf_dir).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == expected(r["html"]) and got[r["page_id"]]["n_chars"] == len(expected(r["html"])) and got[r["page_id"]]["url"] == r["url"]
    # without any mark, the classifier and the neighbours decide
    bare = pages.select("page_id", "url", F.expr("replace(replace(replace(replace(html, '<article>', '<div>'), '</article>', '</div>'), '<nav>', '<div>'), '</nav>', '</div>')").alias("html"))
    odds = extraction.learned(pages)
    right = total = 0
    for r in bare.collect():
        for b, kept in zip(blocks := read(r["html"]), extraction.labels(blocks, odds)):
            if b.tag in ("li", "p"):
                total += 1
                right += kept == (b.tag == "p")
    assert right > 0.95 * total
    made = [(1, None, None), (None, "u", ""), (2, "u", "<article><p>one two</p></article>"), (2, "u", "<article><p>one two</p></article>"), (3, "u", "<article>" + "<p>word " * 3000 + "</article>")]
    odd = spark.createDataFrame([(*x, "k") for x in made], "page_id long, url string, html string, text string")
    assert sorted(((i, len(t), n) for i, _, t, n, *_ in rows(extraction.extract(odd))), key=str) == [(1, 0, 0), (2, 7, 7), (2, 7, 7), (3, 17998, 17998), (None, 0, 0)]
    assert extraction.extract(odd.where("false")).count() == 0


def test_neighbours_carry_a_short_block():
    """A one-word paragraph between long ones of one container stays; one among links goes."""
    odds = {"": 0.0, "words:1": -1.0, "words:6": 3.0, "links:4": -3.0}
    long_, short, link = (lambda c: Block("w " * 39 + "w", "p", (0, c), 0, 0)), (lambda c: Block("ok", "p", (0, c), 0, 0)), (lambda c: Block("menu", "li", (0, c), 4, 0))
    assert extraction.labels([long_(1), short(2), long_(3)], odds) == [True, True, True]
    assert extraction.labels([link(1), short(2), link(3)], odds) == [False, False, False]


# ranked search


def brute_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // l
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def test_ranked_search(spark, odd, none):
    r = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=r.randint(1, 40)))) for i in range(300)] + [(400, "W1 w2"), (401, "w1, w2"), (401, "w1, w2"), (None, "w1 w2"), (500, None), (501, "--")]
    items = [(i, " ".join(r.sample(words, r.randint(1, 12)))) for i in range(25)] + [(90, None), (91, "-"), (92, "unknown word"), (93, "w1 w2")]
    df = lambda x, name: spark.createDataFrame([(*y, "z") for y in x], f"{name} long, text string, score string")
    want = brute_search(docs, items)
    assert sorted(rows(ranked.search(df(docs, "doc_id"), df(items, "item_id"))), key=str) == sorted(want, key=str)
    # several blocks of items
    assert sorted(rows(ranked.search(df(docs, "doc_id"), df(items, "item_id"), terms=15)), key=str) == sorted(want, key=str)
    asked = df(items, "item_id")
    long = [tuple(x) for x in odd.select("doc_id", "text").collect()]
    assert sorted(rows(ranked.search(odd, df([(1, "tok3 word7 more"), (2, "é")], "item_id"))), key=str) == sorted(brute_search(long, [(1, "tok3 word7 more"), (2, "é")]), key=str)
    assert ranked.search(none, asked).count() == 0 and ranked.search(odd, asked.where("false")).count() == 0


# collocations


def brute_collocations(docs, least, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(g == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in cand.items())
        if not inside:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked_ = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked_ += [(x[0], k, *x[1:]) for k, x in enumerate(own[:top], 1)]
    return sorted(ranked_)


@pytest.mark.parametrize("limit", [10_000_000, 40])
def test_collocations(spark, none, limit):
    r = random.Random(4)
    words = [f"v{k}" for k in range(25)] + ["São", "it's", "\x00x", "a-b"]
    docs = []
    for _ in range(120):
        w = r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randint(0, 60))
        for _ in range(r.randint(0, 4)):
            w[r.randint(0, len(w)) : 0] = ["New", "York", "City", "hall"][: r.randint(2, 4)]
        docs.append((r.choice(["en", "de", None, "und"]), "".join(x + r.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b"]) for x in w)))
    docs += [("en", None), (None, ""), ("xx", "one two"), ("en", docs[0][1]), ("en", docs[0][1])]
    df = spark.createDataFrame([(*d, "k", 3) for d in docs], "lang string, text string, phrase string, rank int").repartition(5)
    want = brute_collocations(docs, 6, 50)
    got = collocations.collocations(df, least=6, top=50, limit=limit)
    assert sorted(rows(got)) == want and len(want) > 60
    assert collocations.collocations(none).count() == 0


def test_trie_bursts_and_spills():
    trie, want, r = collocations.HatTrie(burst=8), Counter(), random.Random(1)
    import numpy as np

    for _ in range(30):
        batch = Counter((r.randint(1, 4), r.randint(1, 3) << 42 | r.randint(0, 3) << 21) for _ in range(50))
        want += batch
        keys = sorted(batch)
        trie.add(np.array([a for a, _ in keys]), np.array([b for _, b in keys]), np.array([batch[k] for k in keys]))
    assert trie.size == len(want) and any(isinstance(x, list) for x in trie.root.values())
    some = trie.spill(len(want) // 2)
    assert trie.size <= len(want) // 2
    rest = trie.spill(0)
    got = Counter()
    for a, b, n in (some, rest):
        for x in zip(a.tolist(), b.tolist(), n.tolist()):
            got[x[:2]] += x[2]
    assert got == want and trie.size == 0


# urls and quality


def brute_verdicts(pages, rules):
    def parts(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)", u or "")
        return (lower(m[1]), m[2], lower(m[1]) + re.sub("/$", "", m[2] + (m[3] or ""))) if m else ("", "", None)

    def won(host, path):
        fits = [(len(h + p), a == "allow", a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2] if fits else None

    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, u, targets in pages:
        for t in targets:
            up[top(parts(u)[2])] = top(parts(t)[2])
    votes = {}
    for node in list(up):
        h, _, p = node.partition("/")
        votes.setdefault(top(node), set()).add(won(h, "/" + p.partition("?")[0] if p else ""))
    for _, u, _ in pages:
        h, p, node = parts(u)
        if node in up:
            votes[top(node)].add(won(h, p))
    out = {}
    for i, u, _ in pages:
        h, p, node = parts(u)
        own = won(h, p)
        seen = votes.get(top(node), set()) if node in up else set()
        out[i] = own or ("block" if "block" in seen and "allow" not in seen else "allow")
    return out


def test_every_link_counts(spark):
    chain = [(k, f"http://c{k}.test/a", [f"http://c{k + 1}.test/a"]) for k in range(40)] + [(40, "http://c40.test/a", ["http://b.net/es/1"])]
    hot = [(100 + k, f"http://h{k}.test/x", ["http://hub.test/"]) for k in range(300)] + [(99, "http://hub.test/", [])]
    several = [(500, "http://two.test/1", ["http://fine.test/1", "http://q.net/es/1"]), (501, "http://two.test/2", ["http://fine.test/2", "http://q.net/fr/1", "http://www.example.com/en/1"]), (502, "http://two.test/3", []), (503, None, [])]
    pages = chain + hot + several
    link = lambda t, k: f'<link rel="canonical" href="{t}">' if k % 2 else f'<meta http-equiv="refresh" content="0; url={t}">'
    df = spark.createDataFrame([(i, u, "".join(link(t, k) for k, t in enumerate(ts)), "x") for i, u, ts in pages], "page_id long, url string, html string, verdict string")
    want = brute_verdicts(pages, urls.RULES)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, urls.RULES).collect()}
    assert got == want and got[0] == "block" and got[500] == "block" and got[501] == "allow" and got[100] == "allow"
    # the same rules as a table
    as_table = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df, as_table).collect()} == want


def test_many_rules(spark, sf_dir):
    r = random.Random(3)
    rules = urls.RULES + [(r.choice(["allow", "block"]), f"{r.choice(['s', 'www', 'm'])}{k % 50}.{r.choice(['com', 'net', 'example.com'])}", r.choice(["/", "/en/", "/fr", ""])) for k in range(5000)]
    pages = [(k, f"http://{r.choice(['a.', ''])}{r.choice(['s', 'www', 'm'])}{k % 60}.{r.choice(['com', 'net', 'example.com'])}{r.choice(['/', '/en/x', '/fr', ''])}?q", []) for k in range(400)]
    df = spark.createDataFrame([(i, u, "") for i, u, _ in pages], "page_id long, url string, html string")
    assert {x["page_id"]: x["verdict"] for x in urls.judge(df, rules).collect()} == brute_verdicts(pages, rules)


def test_long_words_are_not_clipped(spark):
    docs = spark.createDataFrame([(k, " ".join(["x" * (100 if k < 30 else 5000)] * 60 + [str(i) for i in range(9)])) for k in range(31)], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    kept = {r["doc_id"]: (r["quality"]["kept"], r["quality"]["word_len_x10"]) for r in quality.quality_rules(docs).collect()}
    assert kept[30][1] == 43400 and kept[0][1] < kept[30][1]
