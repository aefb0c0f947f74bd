"""The URL models and the threshold come from every rule-decided URL."""

from __future__ import annotations

import pytest

from histomesh.llm import url_lm


def test_every_decided_url_counts(spark, monkeypatch):
    """Also beyond 4000 URLs a verdict, and a URL of more than 512 characters."""
    rows = [(i, f"http://a{i}.org/{i}") for i in range(6000)] + [(10_000 + i, f"http://b.com/de/{i}") for i in range(6000)] + [(20_000, "http://c.org/" + "q" * 600), (20_001, "http://a1.org/1")]
    learned, seen = [], []
    fit, calibrate = url_lm.fit, url_lm.calibrate
    monkeypatch.setattr(url_lm, "fit", lambda x: learned.append({r.url for r in x.collect()}) or fit(x))
    monkeypatch.setattr(url_lm, "calibrate", lambda x: seen.append(x.selectExpr("count(score)", "sum(n)").first()) or calibrate(x))
    got = url_lm.filter_urls(spark.createDataFrame([*rows, (1, "http://x.net/")], "page_id long, url string"))
    assert got.count() == len(rows) + 1
    every = {u for _, u in rows}
    assert learned[-1] == every and set.union(*learned[:-1]) == every and sum(map(len, learned[:-1])) == (len(learned) - 2) * len(every)
    assert seen == [(len(every), len(rows))]


def test_threshold_of_weighted_rows(spark):
    rows = [(True, 0.5, 1), (True, -0.1, 9), (False, -0.5, 10), (False, 0.1, 1)]
    many = [(a, v) for a, v, n in rows for _ in range(n)]
    whole = spark.createDataFrame(many, "accepted boolean, score double")
    assert url_lm.calibrate(spark.createDataFrame(rows, "accepted boolean, score double, n long")) == url_lm.calibrate(whole) == pytest.approx(-0.48)
