"""Formulas by hand, bounds of models, brute-force pipeline, odd tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import time

import duckdb
import numpy as np
import pytest

from histomesh.llm import common, decontaminate, html, langid, mixing, paragraphs, quality, queries, shingles, tokens, url_lm, warc

from .test_operators import DOCS, WORDS, docs_of, odd, prose  # noqa: F401


# --- text density ---
def ctd(c, t, lc, lt, lcb, cb):
    """The published formula, with 1 for a zero in a denominator."""
    one = lambda v: v or 1
    return c / one(t) * math.log(c / one(lc) * one(t) / one(lt)) / math.log(math.log(c / one(c - lc) * one(lc) + lcb / cb * c + math.e))


def test_density_by_hand():
    page = '<body><div id="x"><p>abcdefghij</p><p>klm <a href="q">nop</a> qrs</p></div><ul><li><a href="r">one</a></li><li><a href="s">two</a></li></ul></body>'
    _, nodes = html.parse(page)
    html.weigh(nodes)
    by = {}
    for n in nodes:
        by.setdefault(n.tag, []).append(n)
    body, div, ul = by["body"][0], by["div"][0], by["ul"][0]
    p1, p2 = by["p"]
    counts = lambda n: (n.chars, n.tags, n.link_chars, n.link_tags)
    # characters of stripped text parts, tags and links below each node
    assert [counts(x) for x in (p1, p2, div, ul, body)] == [(10, 0, 0, 0), (9, 1, 3, 1), (19, 3, 3, 1), (6, 4, 6, 2), (25, 9, 9, 3)]
    for n in (p1, p2, div, ul, body):
        assert math.isclose(n.density, ctd(*counts(n), 9, 25), abs_tol=1e-12)
    assert math.isclose(div.total, p1.density + p2.density) and math.isclose(body.total, div.density + ul.density)
    assert html.article(nodes) is div and html.main_text(page) == "abcdefghij klm nop qrs"


def test_density_against_brute_force():
    """Counts and densities of random trees, recounted from their text; the article is the node of the largest sum above the threshold."""
    for seed in range(30):
        r = random.Random(seed)

        def tree(depth):
            if depth == 0 or r.random() < 0.3:
                w = prose(r.randrange(10**6), r.randrange(1, 30)).replace(" ", "-")
                return ("a", [w]) if r.random() < 0.2 else ("p", [w])
            return (r.choice(["div", "section", "ul"]), [tree(depth - 1) for _ in range(r.randrange(1, 4))])

        top = ("body", [tree(4) for _ in range(3)])
        write = lambda n: n if isinstance(n, str) else f"<{n[0]}>{''.join(map(write, n[1]))}</{n[0]}>"
        nodes = html.parse(write(top))[1]
        html.weigh(nodes)

        def walk(n, in_link=False):
            """(chars, tags, link chars, link tags) below n, and the list of all nodes in page order."""
            c = t = lc = lt = 0
            found = [None]
            for x in n[1]:
                if isinstance(x, str):
                    c += len(x)
                    lc += len(x) if n[0] == "a" else 0
                else:
                    (a, b, d, e), more = walk(x)
                    c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x[0] == "a")
                    found += more
            found[0] = (n, (c, t, lc, lt))
            return (c, t, lc, lt), found

        whole, flat = walk(top)
        mine = nodes[1:]
        assert len(flat) == len(mine)
        dens = {}
        for (n, v), node in zip(flat, mine, strict=True):
            assert n[0] == node.tag and v == (node.chars, node.tags, node.link_chars, node.link_tags)
            dens[id(n)] = ctd(*v, whole[2], whole[0]) if v[0] else 0.0
            assert math.isclose(node.density, max(0.0, dens[id(n)]), abs_tol=1e-9)
        total = {id(n): sum(dens[id(x)] for x in n[1] if not isinstance(x, str) and x[0] != "a") for n, _ in flat}
        got = html.article(nodes)
        best = max(total[id(n)] for n, v in flat if n[0] != "a" and v[0])
        assert math.isclose(got.total, best, abs_tol=1e-9)


def test_density_decides():
    """Adverts, menus and teasers go by their density; no name is needed, and a name alone cuts nothing dense."""
    text = [prose(k, 60) for k in range(4)]
    body = "".join(f"<p>{t}</p>" for t in text)
    links = "".join(f'<li><a href="/{k}">{prose(50 + k, 3)}</a></li>' for k in range(8))
    assert html.main_text(f"<body><div>{prose(9, 8)}</div><ul>{links}</ul><div>{body}</div><div>{prose(8, 9)}</div></body>") == " ".join(text)
    assert html.main_text(f"<body><article>{body}<ul>{links}</ul></article></body>") == " ".join(text)
    assert html.main_text(f'<body><article>{body}<div class="ad">buy</div><div class="related"><p>{prose(7, 90)}</p></div></article></body>') == " ".join([*text, prose(7, 90)])
    # short paragraphs of the article stay
    assert html.main_text(f"<body><div>{prose(9, 8)}</div><article>{body}<p>Of.</p></article></body>") == " ".join([*text, "Of."])


@pytest.mark.parametrize("part", ['<a "', "<div>", '<a x="y', "</script ", "<span><table>", "<i><hr>", "<li>", "<!--", "<xmp></script ", "<a b='"])
def test_linear_parsing(part):
    def seconds(n):
        page = part * n + "</span>" * n
        began = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - began

    seconds(2000)
    assert min(seconds(32_000) for _ in range(2)) < 16 * max(0.004, min(seconds(4000) for _ in range(3)))


# --- bounded models ---
def test_benchmark_index_is_bounded():
    r = random.Random(1)
    for length in (1, 3, 8):
        vocab = ["".join(r.choice("abcdefghij") for _ in range(length)) for _ in range(3000)]
        items, size, k = [], 0, 0
        while size < 1 << 20:
            text = " ".join(r.choices(vocab, k=r.choice([3, 9, 40]))).encode()
            items.append((k, text))
            size += len(text) + 64
            k += 1
        index = decontaminate.Index(items)
        assert index.nbytes() <= decontaminate.INDEX_FACTOR * size
        found = decontaminate.words(items[77][1])
        spans, which = index.hits(found)
        assert "77" in which and decontaminate.covered(spans) == len(found)
    assert decontaminate.Index([]).hits([b"a"] * 20) == ([], set())


def test_wu_manber_against_all_windows():
    r = random.Random(5)
    word = lambda: r.choice("abc")
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 3, 9, 10, 12, 15]))).encode()) for k in range(40)]
    index = decontaminate.Index(items)
    for _ in range(40):
        w = [word().encode() for _ in range(r.randrange(1, 60))]
        hit, which = set(), set()
        for item, text in items:
            v = text.split()
            for win in [v[i : i + 10] for i in range(max(1, len(v) - 9))]:
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        which.add(str(item))
        spans, got = index.hits(w)
        assert got == which and decontaminate.covered(spans) == len(hit)


def test_language_model_grows_with_languages():
    r = random.Random(3)
    def text(k):
        vocab = ["".join(random.Random(f"{k}{i}").choice("abcdefghijklmnop") for _ in range(random.Random(i).randint(2, 8))) for i in range(800)]
        return [" ".join(r.choices(vocab, k=4000)).encode()]

    sizes = {n: langid.Forest({f"l{k}": text(k) for k in range(n)}).nbytes() for n in (4, 8, 16)}
    assert sizes[8] < 2.6 * sizes[4] and sizes[16] < 2.6 * sizes[8]
    whole, parts = (langid.Forest({f"l{k}": text(k) for k in range(3)}, group) for group in (4, 1))
    r = random.Random(3)
    data = [b"abc def", b"", b"q\xc3\xa9"]
    assert whole.total_bits(data).shape == parts.total_bits(data).shape == (3, 3)


def test_language_training(spark):
    """A text counts once however often it comes, and a language of long documents only is learned."""
    rows = [("aaa bbb", "xx")] * 200 + [(prose(k, 30), "xx") for k in range(20)] + [(prose(k, 9000), "long") for k in range(2)]
    got = langid.train(spark.createDataFrame(rows, "text string, lang string"), max_chars=2000, longest=1000)
    assert got.langs == ["long", "xx"]
    small = langid.train(spark.createDataFrame([("ab", "b"), ("ab", "a"), ("", "c"), (None, "d"), ("x", None)], "text string, lang string"))
    assert small.langs == ["a", "b"]
    out = langid.identify(docs_of(spark, ["ab", "1", None]), small).orderBy("id").collect()
    # ties go to the first by name
    assert [r.lang_pred for r in out] == ["a", "und", "und"] and out[0].score == pytest.approx(0.5)


def test_intermediate_folder(spark, monkeypatch):
    class Context:
        master = "spark://far:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


# --- cascade ---
def test_cascade_order(spark):
    """Cheap and selective rules come first, by costs net of a run's own; the order never changes the verdict."""
    docs = docs_of(spark, [prose(k, 200) for k in range(300)] + ["junk### " * 40] * 100)
    seen = quality.timed(docs, "text", (quality.REPEATED, quality.RULES[0]))
    assert seen["symbols"][1] > 0.2 and seen["repeated"][0] > seen["symbols"][0] > 0
    rules = (quality.SHORT, quality.REPEATED, *quality.RULES)
    kept = [sorted(r.doc_id for r in docs.where(quality.rejected_by(quality.Measures(docs.text), list(order)).isNull()).collect()) for order in (rules, rules[::-1])]
    assert kept[0] == kept[1] == list(range(300))


# --- SQL ---
def test_sql(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "pages", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql)
        cols = [d[0] for d in want.description]
        got = queries.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(cols)
        assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want.fetchall())), name


# --- tokens ---
def test_json_tokenizer(spark):
    import os

    names = [n for n in sorted(os.listdir("/opt/tokenizers")) if n.endswith(".json")]
    if not names:
        pytest.skip("no tokenizers file")
    counter = tokens.JsonCounter(tokens.model_path(names[0]))
    texts = [prose(1, 3000), "", "é <s> x", " a  b "]
    assert tokens.lengths(counter, texts) == [len(counter.model.encode(t, add_special_tokens=False).ids) for t in texts]


def test_batches_by_bytes():
    class Seen:
        cuttable = True
        batches: list = []

        def counts(self, texts):
            self.batches.append(sum(len(t.encode()) for t in texts))
            return [1] * len(texts)

    seen = Seen()
    texts = ["é" * 300 + " a b " for _ in range(50)]
    assert sum(tokens.lengths(seen, texts, long=1 << 20, batch=4000)) == 50 and max(seen.batches) < 4000 + 1300


# --- odd tables ---
def test_odd_urls(spark):
    long = "http://a.org/" + "x" * 50_000
    rows = [(1, long, "a", 1.0), (1, long, "a", 1.0), (2, None, None, None), (3, "http://a.com/de/", "b", 2.0), (4, "http://b.org/x", "c", 3.0), (None, "HTTP://é.NET", "d", 4.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, score double")
    got = url_lm.filter_urls(pages).collect()
    assert len(got) == 6 and [r.host for r in got if r.page_id is None] == ["é.net"] and len({r.score for r in got if r.page_id == 1}) == 1
    # at one length the longer host, then block, wins
    rules = (("allow", "ab.org/c"), ("block", "b.org/cd"), ("block", "ab.org/c"))
    host, path = url_lm.host_path(pages.url)
    one = spark.createDataFrame([("http://x.ab.org/cd",)], "url string")
    rule, verdict = url_lm.rule_match(*url_lm.host_path(one.url), rules)
    assert one.select(rule.alias("r"), verdict.alias("v")).first() == ("ab.org/c", "block")


def test_odd_pages(spark, tmp_path):
    rows = [(1, "u", "x", "t", 5), (1, "v", "x", "t", 5), (2, None, "x", None, None), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, value string, payload int")
    warc.write_archives(pages, f"{tmp_path}/w")
    got = sorted(((r.id, r.type, r.refers_to) for r in warc.read_archives(spark, f"{tmp_path}/w").collect()), key=str)
    assert got == [("1", "response", None), ("1", "response", None), ("2", "revisit", "1"), (None, "response", None)]


def test_odd_benchmark(spark, odd):  # noqa: F811
    bench = spark.createDataFrame([(None, "null id null id"), (7, "null id"), (7, "null id"), (8, None), (9, "  ")], "item_id long, text string")
    got = {(r.key, r.n_hit, r.n_items) for r in decontaminate.search(odd, bench).collect()}
    assert (None, 6, 1) in got and all(hit == 0 for key, hit, _ in got if key is not None)
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 0 and kept.count() == odd.count() - 1
    assert decontaminate.clean(odd, bench, block_bytes=1).count() == odd.count() - 1


# --- the pipeline against brute force ---
def brute_pipeline(docs: list[tuple], bench: list[tuple]) -> tuple[dict, dict]:
    """Texts by id after the stages before the mixture, and the mixture's targets, by comparing everything with everything."""
    ascii_low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)

    def bad(t):
        w = WORDS(t)
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORDS(x)]
        n = sum(map(len, w))
        return len(w) < 10 or 100 * len(hit) > 20 * len(w) or 10 * sum(c in "#*$%&|<>" for c in t) > len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or 10 * sum("A" <= c <= "Z" for c in t) > 4 * n or n < 2 * len(w) or n > 15 * len(w)

    kept = [(i, t, s) for i, t, s in docs if t is not None and not bad(t)]
    sets = {i: paragraphs._shingle_set(t.encode()) for i, t, _ in kept}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if paragraphs._similarity(sets[a], sets[b]) >= 0.8:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    kept = sorted((i, t, s) for i, t, s in kept if root[i] == i)
    # repeated lines: components of similar ones, the first stays
    lines = [(i, k, x) for i, t, _ in kept for k, x in enumerate(ascii_low(t).split("\n")) if len(WORDS(x)) >= 30]
    first = {(i, k): (i, k) for i, k, _ in lines}
    for (i, k, x), (j, m, y) in itertools.combinations(lines, 2):
        if paragraphs._similarity(paragraphs._shingle_set(x.encode()), paragraphs._shingle_set(y.encode())) >= 0.8:
            a, b = sorted((first[i, k], first[j, m]))
            first = {p: a if v == b else v for p, v in first.items()}
    words = {i: WORDS(ascii_low(t)) for i, t, _ in kept}
    out = []
    for i, t, s in kept:
        gone = set()
        for j in (j for j, _, _ in kept if j < i):
            x, y = words[i], words[j]
            for p in range(len(x)):
                for q in range(len(y)):
                    n = 0
                    if x[p] == y[q] and (p == 0 or q == 0 or x[p - 1] != y[q - 1]):
                        while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                            n += 1
                    if n >= 40:
                        gone |= set(range(p, p + n))
        at, left = 0, []
        for k, line in enumerate(t.split("\n")):
            w = line.split()
            stay = [v for c, v in enumerate(w) if at + c not in gone]
            at += len(w)
            if first.get((i, k), (i, k)) == (i, k) and (stay or not w):
                left.append(line if len(stay) == len(w) else " ".join(stay))
        if WORDS("\n".join(left)):
            out.append((i, "\n".join(left), s))
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    wins = {tuple(v[k : k + 10]) for _, b in bench for v in [find(ascii_low(b or ""))] for k in range(max(1, len(v) - 9)) if v}
    clean = lambda t: not any(tuple(w[k : k + len(x)]) == x for w in [find(ascii_low(t))] for x in wins for k in range(len(w) - len(x) + 1))
    out = [(i, t, s) for i, t, s in out if clean(t)]
    sums: dict = {}
    for _, t, s in out:
        sums[(s is None, s or "")] = sums.get((s is None, s or ""), 0) + len(WORDS(t))
    weight, want, open_, share = {k: (5, 2, 1)[n % 3] for n, k in enumerate(sorted(sums))}, {}, set(sums), 1.5 * sum(sums.values())
    while open_:
        unit = share / sum(weight[k] for k in open_)
        full = {k for k in open_ if unit * weight[k] >= 2 * sums[k]} or open_
        want |= {k: min(2.0 * sums[k], unit * weight[k]) for k in full}
        if full == open_:
            break
        share -= sum(2 * sums[k] for k in full)
        open_ -= full
    return {i: t for i, t, _ in out}, want


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(17)
    passage, bench = [prose(7000 + k, 55) for k in range(4)], [(1, prose(7100, 14)), (2, "three short words"), (3, None)]
    docs = []
    for k in range(70):
        parts = [prose(7200 + k % 60, r.choice([45, 60, 90]))]
        if k % 4 == 0:
            parts.append(passage[k // 4 % 4])
        if k % 17 == 0:
            parts.append(bench[0][1])
        if k % 23 == 5:
            parts.append("Three short, WORDS")
        r.shuffle(parts)
        docs.append((k, r.choice(["\n", " "]).join(parts), [None, "b", "a"][k % 3]))
    # near copies of earlier ones; one word of 60 or more leaves a similarity of 0.8, and no stretch of a length that is found by chance
    for k, (_, base, _) in zip(range(70, 80), [d for d in docs if len(d[1].split()) >= 90], strict=False):
        w = base.split(" ")
        w[len(w) // 2] = "changed"
        docs.append((k, " ".join(w), "b"))
    docs += [(80, None, "a"), (81, "", "a"), (82, "short one", "b"), (83, "junk### " * 30, "b"), (84, "LOUD WORDS ARE HERE ALL THE TIME AND STAY SO " * 2, "a")]
    r.shuffle(docs)
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 1) for i, t, s in docs], f"{DOCS}, row_uid int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts, want = brute_pipeline(docs, bench)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: x.text for x in rows} == texts and len(rows) == len(texts) < 70
    assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "row_uid", "size", "source_size", "target", "taken"}
    for k, target in want.items():
        own = [x for x in rows if ((x.source is None), x.source or "") == k]
        assert all(x.target == pytest.approx(target) and x.size == len(WORDS(x.text)) and x.taken in (0, x.size, 2 * x.size) for x in own)
        assert abs(sum(x.taken for x in own) - target) <= max(x.size for x in rows)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_features_are_those_of_single_texts():
    """Features of many texts at once against one at a time."""
    rng, known = np.random.default_rng(0), shingles.Known()
    texts = [prose(k, n).encode().split() for k, n in enumerate([1, 3, 5, 30, 200, 7])]
    numbers = [known.numbers(w) for w in texts]
    x, starts = shingles.shingled(np.concatenate(numbers), np.array(list(map(len, texts))))
    parts = [shingles.rolled(n) for n in numbers]
    assert (np.concatenate(parts) == x).all() and starts.tolist() == np.cumsum([0, *map(len, parts)])[:-1].tolist()
    signer = shingles.Signer(3, 2)
    assert (signer.sign(x, starts) == np.concatenate([signer.sign(p, np.array([0])) for p in parts])).all()
    prints = shingles.majorities(x, starts, chunk=7).view(np.uint64)
    for p, f in zip(parts, prints.tolist(), strict=True):
        assert f == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in p) > len(p))
    m = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    m[200:260] = m[100:160]
    at, key = shingles.marks(m, 22, 19)
    assert len(set(key[(at >= 100) & (at < 139)].tolist()) & set(key[at >= 200].tolist())) > 0


def test_mix_of_ties(spark):
    """Rows that share id and text still add up to the target."""
    rows = [(None, "w w w", "en", "a", 5)] * 40 + [(k, "w w", "en", "b", 3) for k in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    for s in "ab":
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 3
