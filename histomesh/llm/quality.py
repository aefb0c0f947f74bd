"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a Boolean expression over a document's measures. On a bounded sample the cascade measures each rule's
cost (seconds a row beyond a rule that does nothing, compiled beforehand) and selectivity (share rejected) and orders the rules by
rejection per cost; one conditional chain then evaluates them lazily, so that a row which a cheap, selective rule rejects never
reaches the costly ones. The words are split once, before the first rule that asks for them. The order changes the cost alone, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.llm.common import SPACES, UPPER, WORD, free_name, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows, about, on which rules are timed; how often each is, the first time to compile it.
SAMPLE, TIMES = 2000, 3


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _without(text: Column, chars: str, by: str = "") -> Column:
    """text with each of the ASCII characters replaced: plain replacements leave a text without the character as it is."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(_without(text, SPACES[1:], " "), " "), "")


def count_chars(text: Column, chars: str) -> Column:
    return (F.octet_length(text) - F.octet_length(_without(text, chars))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Of a text's words those inside windows found twice or more in it, the first occurrence included. Windows are compared by 64-bit hash;
    sorting keeps it at n log n for the longest texts, and only texts with a repeated window are sorted with positions."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _bound(
            pairs,
            lambda p: F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])),
        )
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return _bound(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(s, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))

    n = F.size(w) - (window - 1)
    hashes = F.transform(F.arrays_zip(*[F.slice(w, k + 1, n) for k in range(window)]), lambda x: F.xxhash64(x))
    some = _bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) <= window, F.lit(0)).otherwise(some).cast("long")


class Measures:
    """A text's measures as columns. words: the text's words, where they are at hand; a measure that is at hand can be given by its name."""

    def __init__(self, text: Column, words: Column | None = None, **known: Column):
        self.text, self.words, self.known = text, words, known

    def __getattr__(self, name: str) -> Column:
        if name in self.known:
            return self.known[name]
        text, make = self.text, {
            "n_words": lambda: F.size(self.words).cast("long"),
            "word_chars": lambda: (F.length(self.text) - count_chars(self.text, SPACES)).cast("long"),
            "n_symbols": lambda: count_chars(text, SYMBOLS),
            "capitals": lambda: F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
            "n_lines": lambda: F.size(_lines(text)).cast("long"),
            "n_dup_lines": lambda: _bound(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": lambda: repeat_words(self.words),
        }
        if name not in make:
            raise AttributeError(name)
        return make[name]()


@dataclass(frozen=True)
class Rule:
    """rejects: from Measures to a Boolean; null counts as not rejected. words: whether it asks for the words."""

    name: str
    rejects: callable
    words: bool = True


#: word counts below 10 or over a fifth of the words in repeated windows: the base, which the contract of op4 fixes.
SHORT = Rule("short", lambda m: m.n_words < 10)
REPEATED = Rule("repeated", lambda m: 100 * m.n_repeat_words > 20 * m.n_words)
#: What the cascade rejects beside: more than one symbol in ten words, half the lines repeated, two fifths of the characters capital, words too short or long on average.
RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("dup_lines", lambda m: 2 * m.n_dup_lines > m.n_lines, False),
    Rule("capitals", lambda m: 10 * m.capitals > 4 * m.word_chars, False),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 15 * m.n_words)),
)


def timed(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample: int = SAMPLE, times: int = TIMES) -> dict[str, tuple[float, float]]:
    """(cost, selectivity) by rule: seconds a row net of the empty rule's, and the share of rows rejected, on about sample rows (nothing for an
    empty table). Every rule is run once to be compiled; of its other runs the quickest counts. The words are at hand, as in the chain."""
    n = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = docs.where(F.rand(5) < min(1.0, 2.0 * sample / max(1, n))).limit(sample).select(text.alias("text"), words(text).alias("words")).persist()

    def run(rule: Rule) -> tuple[float, int]:
        best = float("inf")
        for k in range(times):
            began = time.perf_counter()
            found = part.agg(F.count_if(F.coalesce(rule.rejects(Measures(F.col("text"), F.col("words"))), F.lit(False))).alias("n")).first().n
            best = min(best, time.perf_counter() - began) if k else best
        return best, found

    try:
        if not (n := part.count()):
            return {}
        idle, _ = run(Rule("none", lambda m: F.octet_length(m.text) < 0))
        return {rule.name: (max(cost - idle, 1e-4) / n, (found + 0.5) / (n + 1)) for rule in rules for cost, found in [run(rule)]}
    finally:
        part.unpersist()


def planned(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejection per cost, highest first, as timed; an empty table keeps the order given. The order never affects results."""
    seen = timed(docs, text_col, rules, sample)
    return sorted(rules, key=lambda r: -seen[r.name][1] / seen[r.name][0]) if seen else list(rules)


def rejected_by(m: Measures, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the text, else null; later rules aren't evaluated."""

    def chain(k: int, m: Measures) -> Column:
        if k == len(rules):
            return F.lit(None).cast("string")
        if rules[k].words and m.words is None:
            return _bound(words(m.text), lambda w: chain(k, Measures(m.text, w, **m.known)))
        return F.when(F.coalesce(rules[k].rejects(m), F.lit(False)), F.lit(rules[k].name)).otherwise(chain(k + 1, m))

    return chain(0, m)


def cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = (SHORT, REPEATED, *RULES)) -> DataFrame:
    """docs that no rule rejects. Null and empty texts have no words, so that SHORT rejects them; repeated rows fare alike;
    other columns are carried unchanged, whatever their names; an empty table stays empty."""
    name = free_name(docs, "rejected_by")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(name, rejected_by(Measures(text), planned(docs, text_col, rules))).where(F.col(name).isNull()).drop(name)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text (empty for null), words and the COUNTS of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("words", words(F.col("text")))
    m = Measures(F.col("text"), F.col("words"))
    return rows.select(id_col, "text", "words", *[getattr(m, c).alias(c) for c in COUNTS])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = measures(docs).withColumn("base_failed", failed)
    m = Measures(F.col("text"), F.col("words"), **{c: F.col(c) for c in COUNTS})
    kept = F.when(F.col("base_failed"), False).otherwise(rejected_by(m, planned(docs, "text", RULES)).isNull())
    return rows.withColumn("kept", kept).drop("text", "words")


_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
OP4_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_W} as w from documents),
x as (select r, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5),
g as (select x.r, i, list_slice(w, i, i + 4) as s from x join d using (r)),
c as (select r, i, count(*) over (partition by r, s) as n from g),
p as (select distinct r, i + k as at from c, range(5) t(k) where n > 1),
rep as (select r, count(*) as n from p group by r),
l as (select r, list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\\x20\\x09-\\x0D]')) as ls from d),
m as (select doc_id, text, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from d join l using (r) left join rep using (r)),
b as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 (not base_failed and not (10 * n_symbols > n_words) and not (2 * n_dup_lines > n_lines)
  and not (10 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 4 * word_chars)
  and not (word_chars < 2 * n_words or word_chars > 15 * n_words)) as kept
from b
"""
