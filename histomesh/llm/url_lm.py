"""URL filter: domain and path rules, and for the rest the ratio of two character language models.

Models: one smoothed variable-order Markov model of accepted URLs, one of rejected URLs (those that rules decide),
interpolated by Witten-Bell from order 3 down to order 0 and a uniform base. Scoring finds the longest known n-gram at
each character and backs off with the weights of the contexts passed. The score is the log-likelihood difference a
character. Models learn from every rule-decided URL; the threshold that filters is calibrated on every one of them too, each scored
by models of the half that it isn't in. DataFrame operations only: URLs are exploded into n-grams, each distinct n-gram is
valued once, and the (size-checked) broadcast values are summed by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.llm.common import free_name, lower_ascii, table, with_row_id, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Characters of an n-gram at most; values under the uniform base.
LENGTH, BASE = 4, 256
START = "\x02"
#: Parts of the rule-decided URLs, each scored for the threshold by models of the others.
FOLDS = 2
#: Rows of a model, or of valued n-grams, that may be broadcast; a larger table is joined by shuffling.
MODEL_ROWS = 500_000
#: Steps of the threshold search a nat of score, and its range.
STEPS, RANGE = 50, 8


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, lower case; path: from there up to ? # or the end. Both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; at one length the longer host, then block, wins; else null."""
    best_rule = best_verdict = F.lit(None).cast("string")
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    parts = sorted((len(r), len(r.split("/", 1)[0]), v == "block", r, v) for v, r in rules)
    for _, _, _, rule, verdict in parts:
        at, rest = rule.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        best_rule = F.when(fits, F.lit(rule)).otherwise(best_rule)
        best_verdict = F.when(fits, F.lit(verdict)).otherwise(best_verdict)
    return best_rule, best_verdict


def _chars(url: Column) -> Column:
    return F.concat(F.array(*[F.lit(START)] * (LENGTH - 1)), F.filter(F.split(lower_ascii(url), ""), lambda c: c != ""))


def _gram(chars: Column, at: Column, length: int) -> Column:
    return F.concat(*[F.get(chars, at - k) for k in range(length - 1, -1, -1)]) if length > 1 else F.get(chars, at)


def fit(labelled: DataFrame) -> DataFrame:
    """labelled: url, accepted (boolean). Returns gram, d (log probability ratio of its last character after the rest), bow (log ratio of the
    weights with which the gram as a context backs off; null where it never was one). The empty gram's bow is of order 0."""
    chars = labelled.where("url is not null").select("accepted", _chars(F.col("url")).alias("c")).where(F.size("c") >= LENGTH)
    every = F.transform(F.sequence(F.lit(LENGTH - 1), F.size("c") - 1), lambda i: F.array(*[_gram(F.col("c"), i, n) for n in range(1, LENGTH + 1)]))
    counts = (
        chars.select("accepted", F.explode(F.flatten(every)).alias("gram")).groupBy("gram").agg(F.count_if("accepted").alias("na"), F.count_if(~F.col("accepted")).alias("nr"))
    )
    counts = written(counts.withColumn("n", F.length("gram")).withColumn("ctx", F.substring("gram", 1, F.col("n") - 1)).withColumn("suffix", F.substring("gram", 2, LENGTH)), "url-grams")
    stats = counts.groupBy(F.col("ctx").alias("of")).agg(
        F.sum("na").alias("all_a"), F.sum("nr").alias("all_r"), F.count_if(F.col("na") > 0).alias("kinds_a"), F.count_if(F.col("nr") > 0).alias("kinds_r")
    )
    stats = written(stats, "url-contexts")
    below = None
    tables = []
    for n in range(1, LENGTH + 1):
        now = counts.where(F.col("n") == n).join(stats, F.col("ctx") == F.col("of"))
        if below is None:
            now = now.withColumns({"la": F.lit(1 / BASE), "lr": F.lit(1 / BASE)})
        else:
            now = now.join(below.select(F.col("gram").alias("lower"), F.col("pa").alias("la"), F.col("pr").alias("lr")), F.col("suffix") == F.col("lower"))
        p = lambda c: F.when(F.col(f"all_{c}") > 0, (F.col(f"n{c}") + F.col(f"kinds_{c}") * F.col(f"l{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"l{c}"))
        below = written(now.select("gram", p("a").alias("pa"), p("r").alias("pr")), f"url-order{n - 1}")
        tables.append(below)
    bow = lambda c: F.when(F.col(f"all_{c}") > 0, F.log(F.col(f"kinds_{c}") / (F.col(f"all_{c}") + F.col(f"kinds_{c}")))).otherwise(0.0)
    weights = stats.select("of", (bow("a") - bow("r")).alias("bow"))
    grams = reduce(DataFrame.union, tables).select("gram", F.log(F.col("pa") / F.col("pr")).alias("d"))
    return grams.join(weights, F.col("gram") == F.col("of"), "full_outer").select(F.coalesce("gram", "of").alias("gram"), "d", "bow")


def scores(rows: DataFrame, model: DataFrame, small: bool) -> DataFrame:
    """rows: uid, url. Returns uid, score (log-likelihood difference a character, accepted less rejected) of every row with characters.
    small: the model may be broadcast. An n-gram has one value wherever it stands, so the model's parts are probed by distinct n-grams."""
    grams = F.transform(F.sequence(F.lit(LENGTH - 1), F.size("c") - 1), lambda i: _gram(F.col("c"), i, LENGTH))
    every = rows.where("url <> ''").select("uid", _chars(F.col("url")).alias("c")).select("uid", F.explode(grams).alias("g"))
    at = every.select("g").distinct()

    def probe(at: DataFrame, key: Column, value: str, name: str) -> DataFrame:
        part = model.where(F.col(value).isNotNull()).select(F.col("gram").alias("of"), F.col(value).alias(name))
        return at.join(F.broadcast(part) if small else part, key == F.col("of"), "left").drop("of")

    value = model.where("gram = ''").select("bow").first()
    value = F.lit(value.bow if value else 0.0)
    for n in range(1, LENGTH + 1):
        at = probe(at, F.substring("g", LENGTH - n + 1, n), "d", f"d{n}")
        if n > 1:
            at = probe(at, F.substring("g", LENGTH - n + 1, n - 1), "bow", f"b{n}")
            value = F.coalesce(F.col(f"b{n}"), F.lit(0.0)) + value
        value = F.coalesce(F.col(f"d{n}"), value)
    values = written(at.select("g", value.alias("v")), "url-values")
    return every.join(F.broadcast(values) if values.count() <= MODEL_ROWS else values, "g").groupBy("uid").agg(F.avg("v").alias("score"))


def calibrate(scored: DataFrame) -> float:
    """scored: accepted, score, and n if a row stands for so many. The threshold with the least sum of both error rates; the lowest one at ties; 0 without rows of both kinds."""
    n = F.col("n") if "n" in scored.columns else F.lit(1)
    step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-RANGE)), F.lit(RANGE)) * STEPS)
    rows = scored.where("score is not null").groupBy(step.alias("s")).agg(F.sum(F.when(F.col("accepted"), n).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(n)).alias("r")).collect()  # at most 2 * RANGE * STEPS + 1
    na, nr = sum(x.a for x in rows), sum(x.r for x in rows)
    if not na or not nr:
        return 0.0
    best, at, lost, caught = 1.0, -float(RANGE), 0, 0
    for x in sorted(rows, key=lambda x: x.s):
        lost, caught = lost + x.a, caught + x.r
        if (error := lost / na + 1 - caught / nr) < best - 1e-12:
            best, at = error, (x.s + 1) / STEPS
    return at


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict, score added.

    The models learn from every distinct rule-decided URL, in which a URL counts once however often it comes. The threshold is calibrated on all
    rule-decided rows: each is scored by models of the other part (by hash, of FOLDS) of those URLs. Every row is judged by the models of all.
    A null or empty URL has no score and is allowed unless a rule says otherwise; so is every row if rules decide no URL of one of the verdicts.
    Repeated rows get equal results. Columns of pages with these names are replaced; an empty table gives an empty result."""
    url, uid = F.col(url_col), free_name(pages, "row_uid")
    host, path = host_path(url)
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    kept = pages.drop(*[c for c in pages.columns if c != url_col and c.lower() in ("host", "path", "rule", "verdict", "score")])
    # numbered once, in a written table that scores and results share
    rows = written(with_row_id(kept, uid).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "verdict": verdict}), "url-rows")
    decided = rows.select(url.alias("url"), F.col("verdict").alias("v")).where("v is not null and url <> ''").groupBy("url", "v").agg(F.count(F.lit(1)).alias("n"))
    once = written(with_row_id(decided, "uid").withColumns({"accepted": F.col("v") == "allow", "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS))}), "url-decided")
    if once.select("v").distinct().count() < 2:
        return rows.withColumns({"verdict": F.coalesce("verdict", F.lit("allow")), "score": F.lit(None).cast("double")}).drop(uid)

    def judged(learned: DataFrame, asked: DataFrame) -> DataFrame:
        model = written(fit(learned.select("url", "accepted")), "url-model")
        return scores(asked, model, model.count() <= MODEL_ROWS)

    parts = [written(judged(once.where(F.col("fold") != k), once.where(F.col("fold") == k).select("uid", "url")), "url-fold") for k in range(FOLDS)]
    threshold = calibrate(once.join(reduce(DataFrame.union, parts), "uid").select("accepted", "score", "n"))
    scored = judged(once, rows.select(F.col(uid).alias("uid"), url.alias("url")))
    lm = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return rows.join(scored.withColumnRenamed("uid", uid), uid, "left").withColumn("verdict", F.coalesce("verdict", lm)).drop(uid)


def op1_url_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
