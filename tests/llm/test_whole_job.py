"""Cases of the review where an operator did less than the whole job."""

from __future__ import annotations

import random

from histomesh.llm import paragraphs

from .test_operators import docs_of, prose


def edited(text: str, n: int, seed: int) -> str:
    r, w = random.Random(seed), text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_dedup_stage(spark):
    import corpus_pipeline

    bases = [prose(2000 + k, 200) for k in range(30)]
    copies = [edited(t, 1 + k % 3, k) for k, t in enumerate(bases)]
    far = [edited(t, 60, k) for k, t in enumerate(bases)]
    sets = [paragraphs._shingle_set(t.encode()) for t in bases + copies + far]
    assert all(paragraphs._similarity(sets[k], sets[30 + k]) >= 0.8 > paragraphs._similarity(sets[k], sets[60 + k]) for k in range(30))
    docs = docs_of(spark, bases + copies + far + ["", None, "one", "ONE"])
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), *range(60, 90), 90, 92]


def test_passages_are_tied_to_partners(spark):
    lead, rest = prose(3000, 14), prose(3001, 50)
    texts = [f"{prose(3010, 30)} {lead} {prose(3011, 30)}", f"{prose(3012, 30)} {lead} {rest} {prose(3013, 30)}", f"{prose(3014, 30)} {lead} {rest} {prose(3015, 30)}"]
    # a text stitched of pieces of unrelated earlier ones repeats none of them
    pieces = [prose(3100 + k, 15) for k in range(4)]
    texts += [f"{prose(3110 + k, 30)} {p} {prose(3120 + k, 30)}" for k, p in enumerate(pieces)] + [f"{prose(3130, 30)} {' '.join(pieces)} {prose(3131, 30)}"]
    docs = docs_of(spark, texts)
    got = {r.id: r for r in paragraphs.shared_paragraphs(docs).collect()}
    assert [got[k].class_id for k in range(8)] == [0, 1, 1, 3, 4, 5, 6, 7]
    left = {r.doc_id: r.text for r in paragraphs.remove_repeats(docs).collect()}
    assert left == dict(enumerate(texts)) | {2: f"{prose(3014, 30)} {prose(3015, 30)}"}


def test_passages_are_whole(spark):
    """Every stretch of 40 words is found, to its very ends, repeated words included."""
    shared = [prose(4000 + k, 40 + k % 12) for k in range(40)] + [" ".join(([prose(4100 + k, k)] * 60)[: 60 // k]) for k in range(1, 6)]
    texts = [f"{prose(4200 + k, 20 + k)} {p} {prose(4300 + k, 30)}" for k, p in enumerate(shared)]
    again = [(prose(4400 + k, 25), prose(4500 + k, 30 + k)) for k in range(len(shared))]
    docs = docs_of(spark, texts + [f"{a} {p} {b}" for (a, b), p in zip(again, shared, strict=True)])
    left = {r.doc_id: r.text for r in paragraphs.remove_repeats(docs).collect()}
    assert left == dict(enumerate(texts + [f"{a} {b}" for a, b in again]))


def test_row_numbers_are_written(spark, tmp_path):
    """Rows are numbered in order of id and text, in a written table, however the files' rows are dealt out."""
    from pyspark.sql import functions as F

    from histomesh.llm import common

    docs = docs_of(spark, [prose(5010 + k % 30, 20) for k in range(60)]).withColumn("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 20))
    seen = []
    for n in (1, 8):
        rows = common.ordered(docs.repartition(n), "uid", "doc_id", "text")
        assert "parquet" in str(rows._jdf.queryExecution().executedPlan()).lower() and rows.columns == [*docs.columns, "uid"]
        assert rows.select("uid").distinct().count() == 60
        seen.append([(r.doc_id, r.text) for r in rows.orderBy("uid").collect()])
    assert seen[0] == seen[1] and [i for i, _ in seen[0]] == sorted((i for i, _ in seen[0]), key=lambda i: (i is None, i or 0))


def test_html_attributes():
    """Names and values of other attributes don't make an element unwanted."""
    from histomesh.llm import html

    text = prose(6000, 60)
    kept = ['style="overflow:hidden"', 'aria-hidden="false"', 'title="Hidden gems"', 'data-id="menu"', 'data-x="class=menu"', "title='id=share'", 'data-hidden', 'alt="a" title=hidden']
    for attributes in kept:
        assert html.main_text(f"<body><div {attributes}><p>{text}</p></div></body>") == text, attributes
    assert html.main_text(f'<body><p>{text} <a href="/p?id=share">one</a> <a href="/hidden-valley">two</a></p></body>') == f"{text} one two"
    for attributes in ("hidden", "HIDDEN", 'hidden=""', 'aria-hidden="true"', "aria-hidden=true", 'class="x menu"', "id=share", "role='navigation'", 'title="a"hidden', 'x="1" id = "cookie-box"'):
        assert html.main_text(f"<body><p>{text}</p><div {attributes}><p>no</p></div></body>") == text, attributes


def test_dclf_is_registered_with_the_defaults(monkeypatch):
    import inspect

    import pytest

    from histomesh.operators import patterns
    from histomesh.plans import catalog

    signature, seen = inspect.signature(patterns.dclf_envelope), {}
    monkeypatch.setattr(catalog.ad, "cells", lambda s, d: None)

    def record(*a, **k):
        seen.update(signature.bind(*a, **k).arguments)
        raise InterruptedError

    monkeypatch.setattr(patterns, "dclf_envelope", record)
    with pytest.raises(InterruptedError):
        catalog.QUERIES["dclf_envelope"](None, "")
    assert seen.get("max_cells", 100_000) == 100_000 and seen.get("n_simulations", 199) == 199


def test_ward_is_not_swapped(spark, monkeypatch):
    import pytest

    from histomesh.operators import embedding

    monkeypatch.setattr(embedding, "DRIVER_ROWS", 3)
    rows = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(4)], "cell_id long, v array<double>")
    with pytest.raises(ValueError, match="more than 3 rows"):
        embedding.hierarchical(rows, 2)
