"""Each training-data operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash

from histomesh.llm import components as cc
from histomesh.llm import decontaminate, html, langid, mixing, paragraphs, quality, simhash, tokens, url_lm, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t, more.get("lang", "en"), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, long, repeated and tied rows, and columns that clash with the operators' own."""
    long = prose(1, 30_000)
    rows = [(1, "", "en", "a", 1, 1, "x"), (2, None, None, None, None, None, None), (None, "null id " * 3, "en", "a", 0, 0, "x"), (3, long, "de", "b", 2, 2, "y"), (3, long, "de", "b", 2, 2, "y"), (4, " \n\t ", "en", "c", 3, 3, "z"), (5, prose(2, 40), "en", "b", 4, 4, "q"), (6, prose(2, 40), "en", "b", 4, 4, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid long, row_uid string").cache()


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (None, 1)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = dict(map(tuple, cc.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: find(n) for a, b in links if a is not None and a != b for n in (a, b)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    w = WORDS("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd):
    texts = [prose(i % 7, 60) + (" extra" * (i // 7 % 3)) for i in range(60)] + ["", None, "one", "ONE"]
    docs = docs_of(spark, texts)
    prints = [brute_print(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], root[i]) for i in range(len(texts))}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_copies(spark, odd):
    """Against all pairs: components of exact similarity, whatever the rows' order."""
    r = random.Random(8)
    texts = []
    for k in range(70):
        w = prose(300 + k % 9, 70).split()
        for at in r.sample(range(70), k % 5):
            w[at] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["", None, " ", "one", "ONE", "one two", "two one"]
    sets = [paragraphs._shingle_set((t or "").encode()) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if paragraphs._similarity(sets[i], sets[j]) >= 0.8:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    docs = docs_of(spark, texts)
    kept = simhash.keep_one(docs.repartition(7))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "None"]
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_anchors_cover():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for flips in ([], [0], [22, 23], [45, 46], [60, 3], [7, 8]):
        y = x.copy()
        for b in flips:
            y ^= np.uint64(1 << b)
        _, home, is_home = simhash.anchors(x)
        row, code, _ = simhash.anchors(y)
        lists = {(int(r), int(c)) for r, c in zip(row, code, strict=True)}
        assert all((k, int(h)) in lists for k, h in enumerate(home[is_home]))


def test_quality(spark, odd):
    texts = [prose(i, 12 + i) for i in range(8)] + ["a b c d e f a b c d e f x", "word " * 60, "l one\nl one\nl one\n\nx", "a###b c$$ d|| " * 5, prose(9, 3), "", None, prose(4, 500) + " " + prose(4, 30)]
    got = {r.doc_id: r for r in quality.measures(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORDS(t or "")
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORDS(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
    kept = quality.cascade(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 3, 5, 6]
    assert quality.cascade(odd.limit(0)).count() == 0


def test_url_model(spark):
    r = random.Random(1)
    word = lambda kind: "".join(r.choice("abcde" if kind else "vwxyz") for _ in range(8))
    rows = [(i, f"https://{word(i % 2)}.{'org' if i % 2 else 'com'}/{'en' if i % 2 else 'de'}/{word(i % 2)}") for i in range(400)]
    rows += [(1000 + i, f"http://{word(i % 2)}.net/{word(i % 2)}") for i in range(60)] + [(2000, None), (2001, ""), (2002, "no scheme"), (2003, "http://EXAMPLE.org/es/x?y"), (2004, "http://sub.example.org/en/12#z"), (2005, "http://a.org"), (2006, "https://b.com/fr/?q")]
    got = {r.page_id: r for r in url_lm.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in (2003, 2004, 2006)] == [("example.org", "/es/x", "example.org/es/", "block"), ("sub.example.org", "/en/12", "example.org/en/1", "block"), ("b.com", "/fr/", "com/fr/", "allow")]
    assert (got[2000].host, got[2000].verdict, got[2001].verdict, got[2005].path, got[2005].rule) == ("", "allow", "allow", "", None)
    right = sum((got[1000 + i].verdict == "allow") == bool(i % 2) for i in range(60))
    assert right >= 54
    assert url_lm.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_probabilities(spark):
    """Every context's probabilities, as the fit gives them, are those of a direct computation."""
    urls = [("abab", True), ("abac", True), ("bbbb", False), ("bcab", False)]
    model = {r.gram: r for r in url_lm.fit(spark.createDataFrame(urls, "url string, accepted boolean")).collect()}

    def p(cls, gram):
        n = {}
        for u, a in urls:
            if a == cls:
                s = url_lm.START * 3 + u
                for i in range(3, len(s)):
                    g = s[i - len(gram) + 1 : i + 1]
                    n.setdefault(g[:-1], {}).setdefault(g[-1], 0)
                    n[g[:-1]][g[-1]] += 1
        low = p(cls, gram[1:]) if len(gram) > 1 else 1 / url_lm.BASE
        c = n.get(gram[:-1])
        return (c.get(gram[-1], 0) + len(c) * low) / (sum(c.values()) + len(c)) if c else low

    for gram, row in model.items():
        if row.d is not None:
            assert math.isclose(row.d, math.log(p(True, gram) / p(False, gram)), abs_tol=1e-9)


def test_warc(spark, odd, tmp_path):
    rows = [(3, "http://a/é x", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "u", None), (5, "u", ""), (9, "u", "x" * 300_000), (None, "u", "<p>same</p>"), (7, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, f"{tmp_path}/w")
    got = {(r.id, r.bytes, r.digest, r.type, r.refers_to) for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    name = lambda t: warc.digest((t or "").encode())
    want = {("3", 11, name("<p>same</p>"), "revisit", "1"), ("1", 11, name("<p>same</p>"), "response", None), ("2", 0, name(""), "response", None), ("5", 0, name(""), "revisit", "2"), ("9", 300_000, name("x" * 300_000), "response", None), (None, 11, name("<p>same</p>"), "revisit", "1"), ("7", 5, name("other"), "response", None)}
    assert got == want
    import zstandard

    data = warc.archive([warc.record(1, "u", b"abc" * 50)] * 3)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert [warc.read_record(x)["payload"] for x in warc.frames(data + warc.SKIP.encode())] == [b"abc" * 50] * 3
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(data[:-5]))
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")


def test_langid(spark, odd):
    kinds = {"xx": "abcde", "yy": "cdefg"}
    make = lambda lang, seed, n: " ".join("".join(random.Random(f"{lang}{seed}{k}").choices(kinds[lang], k=5)) for k in range(n))
    train = [(make(l, i, 50), l) for l in kinds for i in range(12)]
    trees = langid.train(spark.createDataFrame([*train, (None, "xx"), ("z", None)], "text string, lang string"))
    test = [make(l, 100 + i, 12) for l in kinds for i in range(10)] + [None, "", "123 456", make("xx", 7, 60_000)]
    got = {r.id: r for r in langid.identify(docs_of(spark, test), trees).collect()}
    assert sum(got[i].lang_pred == ("xx" if i < 10 else "yy") for i in range(20)) >= 19
    assert [got[i].lang_pred for i in (20, 21, 22, 23)] == ["und", "und", "und", "xx"] and all(0 <= r.score <= 1 for r in got.values())
    data = {l: [t.encode() for t, m in train if m == l] for l in kinds}

    def bits(lang, text):
        total = 0.0
        for i in range(len(text)):
            low, cost = 1 / 256, None
            for k in range(min(i, 4) + 1):
                ctx, n = text[i - k : i], {}
                for t in data[lang]:
                    for at in range(k, len(t)):
                        if t[at - k : at] == ctx:
                            n[t[at]] = n.get(t[at], 0) + 1
                s = sum(n.values())
                low = n[text[i]] / (s + len(n)) if text[i] in n else len(n) / (s + len(n)) * low if n else low
            total -= math.log2(low)
        return total

    for text in (b"abc de", b"q\xc3\xa9gg", b"c"):
        assert np.allclose(trees.total_bits([text])[0], [bits(l, text) for l in trees.langs], rtol=1e-4)
    empty = langid.train(odd.select("text", "lang").limit(0))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_decontaminate(spark, odd):
    bench = [(1, prose(50, 14)), (2, "short item here"), (3, None), (4, ""), (10, prose(50, 14).upper()), (5, prose(51, 10))]
    texts = [prose(60, 30) + " " + prose(50, 14) + " tail", "a short, ITEM here. and a short item here", prose(61, 50), None, "", " ".join(prose(50, 14).split()[2:13]), prose(51, 9), prose(51, 10)]
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    want = {}
    for i, t in enumerate(texts):
        w, hit, items = find((t or "").lower()), set(), set()
        for item, b in bench:
            v = find((b or "").lower())
            for win in [v[k : k + 10] for k in range(max(1, len(v) - 9))] if v else []:
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        items.add(str(item))
        want[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
    b = spark.createDataFrame(bench, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 100):
        got = {r.key: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.search(docs_of(spark, texts), b, block_bytes=size).collect()}
        assert got == want
    clean = decontaminate.clean(docs_of(spark, texts), b)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in want if not want[i][1]]
    assert decontaminate.clean(odd, b.limit(0)).count() == odd.count()


def test_mixing(spark, odd):
    r = random.Random(2)
    rows = [(i, "w " * r.choice([1, 3, 3, 8, 20]), "en", [None, "b", "a", "é"][i % 4 if i % 3 else 1], 0) for i in range(400)]
    for df in (spark.createDataFrame(rows, DOCS), odd):
        got = mixing.mix(df).collect()
        assert mixing.mix(df).columns == [*df.columns, *mixing.ADDED]
        assert len(got) == df.count() and sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
        sums: dict = {}
        for x in got:
            s = sums.setdefault((int(x.source is None), x.source or ""), [0, 0, x.target])
            s[0] += x.size
            s[1] += x.taken
            assert x.taken in (0, x.size, 2 * x.size)
        left, level = dict(sorted(sums.items())), 1.5 * sum(s[0] for s in sums.values())
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(left)}
        want, open_ = {}, set(left)
        while open_:  # share, cap, share the excess again
            unit = level / sum(weight[k] for k in open_)
            full = {k for k in open_ if unit * weight[k] >= 2 * left[k][0]}
            if not full:
                want |= {k: unit * weight[k] for k in open_}
                break
            want |= {k: 2.0 * left[k][0] for k in full}
            level -= sum(2 * left[k][0] for k in full)
            open_ -= full
        longest = max(x.size for x in got)
        for k, s in sums.items():
            assert math.isclose(s[2], want[k], abs_tol=1e-6) and abs(s[1] - s[2]) <= max(1, longest)
    for budget in range(0, 60, 7):
        lengths, counts = [1, 4, 9], [3, 4, 2]
        best = max(s for s in (a + 4 * b + 9 * c for a in range(4) for b in range(5) for c in range(3)) if s <= budget)
        assert sum(n * t for n, t in zip(lengths, mixing.fit_budget(lengths, counts, budget), strict=True)) == best
    assert mixing.mix(odd.limit(0)).count() == 0


def test_tokens(spark, odd):
    counter = tokens.PieceCounter(tokens.model_path(tokens.MODEL))
    texts = [prose(1, 9000), prose(2, 5000).replace(" ", "  "), "x" * 50_000, "é ü " * 4000, "<s> a </s>\n b", "", " lead", "tail "]
    assert counter.cuttable and tokens.lengths(counter, texts) == [len(counter.model.encode(t)) for t in texts]
    assert len(tokens.cuts(texts[0])) > 3
    got = tokens.count_tokens(odd).collect()
    assert len(got) == odd.count() and [(r.n_bytes, r.n_tokens) for r in got if r.id == 2] == [(0, 0)]


def test_html(spark):
    body = " ".join([prose(1, 40), "&amp; more&nbsp;text"])
    page = f'<html><body><nav><a href="/">Home</a></nav><div class="cookie-notice">{prose(2, 30)}</div><div id="x"><article><h1>Title</h1><p>{body}<p><b>Bold</b>est<br>line <a href="q">link</a><div class="ad">buy</div><script>var a="<p>";</script></article><div class="comments"><p>{prose(3, 60)}</p></div></div><footer>f</footer>'
    assert html.main_text(page) == f"Title {prose(1, 40)} & more text Boldest line link"
    for text, want in ((None, ""), ("", ""), ("<", "<"), ("plain &lt; text", "plain < text"), ("<nav>x</nav>", ""), ("<p>" * 5000 + "deep", "deep"), ("<div>" * 20_000 + "deep", "deep")):
        assert html.main_text(text) == want
    pages = spark.createDataFrame([(1, "u", page, "t", 9), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    assert [(r.page_id, r.n_chars) for r in html.extract(pages).collect()] == [(1, len(html.main_text(page))), (None, 0)]
    assert html.extract(pages.limit(0)).count() == 0


def test_tune():
    bands, rows = paragraphs.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_paragraphs(spark, odd):
    r = random.Random(4)

    def edit(text, n):
        w = text.split()
        for k in r.sample(range(len(w)), n):
            w[k] = f"new{r.randrange(10**6)}"
        return " ".join(w)

    bases = [prose(100 + k, 60) for k in range(4)]
    lines = [edit(bases[i % 4], i % 5) for i in range(240)] + [prose(500 + i, 45) for i in range(20)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "uid long, text string")
    # all pairs
    sets = [paragraphs._shingle_set(t.encode()) for t in lines]
    root = list(range(len(lines)))
    for i, j in itertools.combinations(range(len(lines)), 2):
        if lines[i] == lines[j] or paragraphs._similarity(sets[i], sets[j]) >= 0.8:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    want = {(i, root[i]) for i in range(len(lines)) if root.count(root[i]) > 1}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(paragraphs, "BLOCK", 16)  # so that buckets are compared block by block
        assert {(x.uid, x.first_uid) for x in paragraphs.Search(paragraphs.features(rows)).clusters(rows).collect()} == want
    # a passage inside other lines
    passage = prose(900, 60)
    texts = [f"{prose(910 + i, 25)} {passage} {prose(940 + i, 25)}" for i in range(6)] + [prose(970 + i, 60) for i in range(6)]
    docs = docs_of(spark, texts)
    out = {x.id: x for x in paragraphs.shared_paragraphs(docs).collect()}
    assert [out[i].class_id for i in range(12)] == [0] * 6 + list(range(6, 12)) and [out[i].n_passages for i in range(12)] == [1] * 6 + [0] * 6
    left = {x.doc_id: x for x in paragraphs.remove_repeats(docs).collect()}
    assert left[0].text == texts[0] and all(left[i].text == texts[i] for i in range(6, 12))
    assert all(left[i].text == f"{prose(910 + i, 25)} {prose(940 + i, 25)}" and left[i].n_chars == len(left[i].text) for i in range(1, 6))
    kept = paragraphs.remove_repeats(odd)
    assert kept.columns == odd.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["1", "2", "3", "4", "5", "None"]
    assert paragraphs.shared_paragraphs(odd.limit(0)).count() == 0


def test_passages_against_all_pairs(spark):
    """Passages of 40 words and more are those that a comparison of all pairs of texts finds, and reruns over other layouts agree."""
    r = random.Random(12)
    shared = [prose(1200 + k, r.randint(40, 70)).split() for k in range(8)]
    texts = []
    for k in range(60):
        parts = [prose(1300 + 100 * j + k, r.randint(5, 30)) for j in range(3)]
        for j, p in enumerate(r.sample(shared, k % 3)):
            parts.insert(2 * j + r.randrange(2), " ".join(p))
        texts.append(" ".join(parts))
    words = [t.split() for t in texts]

    def runs(x, y, least):
        """Words of x inside equal stretches of at least so many words of y."""
        hit, size = set(), [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                if x[i] == y[j]:
                    size[i + 1][j + 1] = n = size[i][j] + 1
                    if n >= least:
                        hit |= set(range(i + 1 - n, i + 1))
        return hit

    gone = [set().union(*(runs(words[k], words[j], 40) for j in range(k))) for k in range(60)]
    want = {k: " ".join(w for i, w in enumerate(words[k]) if i not in gone[k]) for k in range(60)}
    docs = docs_of(spark, texts)
    seen = []
    for rows in (docs, docs.repartition(9)):
        seen.append({x.doc_id: x.text for x in paragraphs.remove_repeats(rows).collect()})
    assert seen[0] == seen[1] == {k: t for k, t in want.items() if t}


def test_block_comparison_finds_every_link():
    import pyarrow as pa

    bodies = [prose(5, 30).encode(), (prose(5, 29) + " other").encode(), prose(6, 30).encode(), b"tiny one"]
    table = pa.table({"pid": [1, 2, 3, 4], "c": [1, 2, 3, 4], "body": bodies})
    got = paragraphs._compare(0.8)(table).to_pylist()
    assert got == [{"a": 1, "b": 2}]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    passage, bench = prose(700, 60), prose(701, 12)
    good = [prose(710 + i, 80) for i in range(6)]
    texts = [*good, good[0], f"{prose(730, 60)}\n{passage}", f"{prose(731, 60)}\n{passage}", f"{prose(732, 40)} {bench} {prose(733, 40)}", "too short", "junk### " * 40, None]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert sorted((got[7].size, got[8].size)) == [60, 120]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "decontamination", "mixture"]
