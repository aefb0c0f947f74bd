"""Language identification by prediction by partial matching.

Per language a variable-order byte context tree (orders 0 to 4, escapes by method C: distinct symbols over symbols plus
distinct, uniform 1/256 below order 0) is learned once and then frozen. A text's code length under each language is the
exact sum of its bytes' code lengths, escapes included; the shortest code names the language. The trees are stored
resolved, in groups of languages: for every n-gram of a group's training texts its code length under each of the group's languages, for
every context its escape cost, in one open-addressing table that numpy probes for all bytes of a batch at once. So the
model grows with the number of languages, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histomesh.llm.common import bound_arrow, held, sent, table, written

ORDER = 4
#: Characters of training text a language at most, in whole documents of at most LONGEST characters (the documented bound).
TRAIN_CHARS, LONGEST = 400_000, 40_000
#: Languages whose trees share a table.
GROUP = 4
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes scored at once.
CHUNK = 1 << 20


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes up to each byte as a number with n in front, for the bytes that have so many before them."""
    out = np.full(max(0, len(data) - n + 1), n, np.uint64)
    for k in range(n):
        out = out << np.uint64(8) | data[k : len(data) - n + 1 + k]
    return out


class Trees:
    """Frozen context trees of all languages."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        if not self.langs:
            return
        counts = []
        for lang in self.langs:
            own = {}
            for n in range(1, order + 2):
                parts = [_grams(np.frombuffer(t, np.uint8).astype(np.uint64), n) for t in texts[lang]]
                own[n] = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            counts.append(own)
        keys, bits = [], []
        self.escape_keys, escapes = [np.zeros(0, np.uint64)], [np.zeros((0, len(self.langs)))]
        below_keys = below = None
        self.root = np.zeros(len(self.langs))
        for n in range(1, order + 2):
            grams = np.unique(np.concatenate([c[n][0] for c in counts]))
            contexts = (grams & np.uint64((1 << 8 * n) - 1)) >> np.uint64(8) | np.uint64((n - 1) << 8 * (n - 1))
            ctx, of = np.unique(contexts, return_inverse=True)
            if n > 1:
                suffix = grams & np.uint64((1 << 8 * (n - 1)) - 1) | np.uint64((n - 1) << 8 * (n - 1))
                lower = below[np.searchsorted(below_keys, suffix)]
            else:
                lower = np.full((len(grams), len(self.langs)), 1 / 256)
            p, esc = np.empty((len(grams), len(self.langs))), np.empty((len(ctx), len(self.langs)))
            for k, c in enumerate(counts):
                seen = np.zeros(len(grams))
                seen[np.searchsorted(grams, c[n][0])] = c[n][1]
                total, distinct = np.bincount(of, seen, len(ctx)), np.bincount(of, seen > 0, len(ctx))
                esc[:, k] = np.where(total > 0, distinct / np.maximum(1, total + distinct), 1.0)
                p[:, k] = np.where(seen > 0, seen / np.maximum(1, total + distinct)[of], esc[of, k] * lower[:, k])
            if n == 1:
                self.root = -np.log2(esc[0]) if len(esc) else np.zeros(len(self.langs))
            else:
                self.escape_keys.append(ctx)
                escapes.append(-np.log2(esc))
            keys.append(grams)
            bits.append(-np.log2(p) if len(p) else p)
            below_keys, below = grams, p
        keys, bits = np.concatenate(keys), np.concatenate(bits).astype(np.float32)
        self.bits = bits
        # grams of the full length are never contexts, and come last
        self.escapes = np.zeros((int(np.searchsorted(keys, np.uint64((order + 1) << 8 * (order + 1)))), len(self.langs)), np.float32)
        order_ = np.argsort(keys)
        at = np.concatenate(self.escape_keys)
        place = np.searchsorted(keys[order_], at) if len(keys) else at.astype(np.int64)
        self.escapes[order_[place]] = np.concatenate(escapes)
        del self.escape_keys
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(1, 3 * len(keys)))))))
        self.slots, self.rows = np.zeros(1 << int(64 - self.shift), np.uint64), np.zeros(1 << int(64 - self.shift), np.int32)
        todo, where = np.arange(len(keys)), (keys * _MIX >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slots[where] == 0
            self.slots[where[free]] = keys[todo[free]]
            stored = self.slots[where] == keys[todo]
            self.rows[where[stored]] = todo[stored]
            todo, where = todo[~stored], (where[~stored] + 1) % len(self.slots)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of keys, -1 where unknown."""
        where = (keys * _MIX >> self.shift).astype(np.int64)
        got = self.slots[where]
        out = np.where(got == keys, self.rows[where], np.int32(-1))
        open_ = np.flatnonzero((got != keys) & (got != 0))
        where = where[open_]
        while len(open_):
            where = (where + 1) % len(self.slots)
            got = self.slots[where]
            hit = got == keys[open_]
            out[open_[hit]] = self.rows[where[hit]]
            more = ~hit & (got != 0)
            open_, where = open_[more], where[more]
        return out

    def code_bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length in bits of every byte of data under every language. starts: where texts begin; no context reaches back over one."""
        n = len(data)
        if not n or not len(self.langs):
            return np.zeros((n, len(self.langs)), np.float32)
        since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        wide = data.astype(np.uint64)
        cost = np.zeros((n, len(self.langs)), np.float32)
        length = np.minimum(since, self.order) + 1
        whole = wide.copy()
        for k in range(1, self.order + 1):
            whole[k:] |= wide[:-k] << np.uint64(8 * k)
        todo = np.arange(n)
        while len(todo):
            own = length[todo].astype(np.uint64)
            size = own << np.uint64(3)
            key = whole[todo] & ((np.uint64(1) << size) - np.uint64(1)) | own << size
            row = self.find(key)
            known = row >= 0
            cost[todo[known]] += self.bits[row[known]]
            todo = todo[~known]
            own = length[todo]
            last = own == 1
            cost[todo[last]] += (self.root + 8).astype(np.float32)
            todo, own = todo[~last], own[~last].astype(np.uint64) - np.uint64(1)
            size = own << np.uint64(3)
            context = self.find((whole[todo] >> np.uint64(8)) & ((np.uint64(1) << size) - np.uint64(1)) | own << size)
            some = context >= 0
            cost[todo[some]] += self.escapes[context[some]]
            length[todo] -= 1
        return cost

    def total_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every text under every language; memory is bounded by CHUNK, whatever the texts' length."""
        out = np.zeros((len(texts), len(self.langs)))
        if not self.langs:
            return out
        sizes = np.array([len(t) for t in texts], np.int64)
        k = 0
        while k < len(texts):
            upto, size = k, 0
            while upto < len(texts) and (upto == k or size + sizes[upto] <= CHUNK):
                size += sizes[upto]
                upto += 1
            data = np.frombuffer(b"".join(texts[k:upto]), np.uint8)
            if upto - k == 1:
                for at in range(0, size, CHUNK):
                    back = min(at, self.order)
                    out[k] += self.code_bits(data[at - back : at + CHUNK], np.zeros(1, np.int64))[back:].sum(axis=0, dtype=np.float64)
            else:
                some = np.flatnonzero(sizes[k:upto])
                starts = (np.cumsum(sizes[k:upto]) - sizes[k:upto])[some]
                if len(some):
                    out[k + some] = np.add.reduceat(self.code_bits(data, starts).astype(np.float64), starts, axis=0)
            k = upto
        return out


class Forest:
    """Trees of languages in groups."""

    def __init__(self, texts: dict[str, list[bytes]], group: int = GROUP):
        self.langs = sorted(texts)
        self.groups = [Trees({k: texts[k] for k in self.langs[at : at + group]}) for at in range(0, len(self.langs), group)]

    def total_bits(self, texts: list[bytes]) -> np.ndarray:
        return np.concatenate([np.zeros((len(texts), 0)), *(g.total_bits(texts) for g in self.groups)], axis=1)

    def nbytes(self) -> int:
        return sum(x.nbytes for g in self.groups for x in vars(g).values() if isinstance(x, np.ndarray))


def train(labelled: DataFrame, max_chars: int = TRAIN_CHARS, longest: int = LONGEST) -> Forest:
    """labelled: text, lang (rows with nulls are passed over). Learns from whole documents of at most longest characters (of a language's shortest
    one, if all are longer: its first max_chars), each text once, in order of the text's hash, as long as their sum is at most max_chars a language."""
    rows = labelled.where("text is not null and text <> '' and lang is not null").select("lang", "text", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    once = rows.groupBy("lang", "h").agg(F.max("n").alias("n"))
    sizes = once.groupBy("lang").agg(F.sum(F.when(F.col("n") <= longest, F.col("n"))).alias("all"), F.min("n").alias("least"))
    sizes = written(sizes.withColumn("most", F.greatest("least", F.lit(longest))), "lang-sizes")
    # thin out by hash before any row is ranked, so that a window sees about four times the bound, whatever the table's size
    share = F.coalesce(F.lit(4.0 * max_chars + 4.0 * longest) / F.col("all"), F.lit(2.0))
    some = rows.join(sizes, "lang").where((F.col("n") <= F.col("most")) & (F.col("h").cast("double") / 2.0**64 + 0.5 < share))
    # copies of a text have one hash: they become one row before the window
    some = some.groupBy("lang", "h").agg(F.min(F.substring("text", 1, max_chars)).alias("text")).withColumn("n", F.length("text"))
    run = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, 0)
    picked = some.withColumn("upto", F.sum("n").over(run)).where((F.col("upto") <= max_chars) | (F.col("upto") == F.col("n"))).select("lang", "text")
    texts: dict[str, list[bytes]] = {}
    for lang, text in sorted(map(tuple, picked.collect())):
        texts.setdefault(lang, []).append(text.encode())
    return Forest(texts)


def _predict(key: str, broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        trees, letter = held(key, broadcast), regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            which = [k for k, t in enumerate(texts) if t and letter.search(t)] if trees.langs else []
            if which:
                bits = trees.total_bits([texts[k].encode() for k in which])
                best = bits.argmin(axis=1)
                odds = np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                for k, b, o in zip(which, best.tolist(), odds.tolist(), strict=True):
                    lang[k], score[k] = trees.langs[b], 1 / o
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, trees: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (share of the best language's probability among all, under equal priors) of every row, from its whole text.

    Null texts and texts without a letter are und with score 0, as is every row if nothing was learned. Ties go to the first language by name.
    Repeated rows get equal results; only the two columns named are read."""
    bound_arrow(docs.sparkSession)
    model = sent(docs.sparkSession, trees)  # bounded by max_chars a language
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(*model), f"id {kind}, lang_pred string, score double")


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train(docs.where(~held_out("doc_id")).select("text", "lang"))
    out = identify(docs, trees)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
