"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared only at anchors. The anchors are pairs of codewords of two binary Golay codes [23, 12, 7],
laid on bits 0-22 and 23-45 of the 64. The code is perfect: every 23-bit word has exactly one codeword within
distance 3. A fingerprint's home is its nearest anchor (covering radius 3 in each block). If x and y differ in at
most 2 bits, d(y_i, home(x)_i) <= 3 + f_i with f_1 + f_2 <= 2, where f_i are the flips in block i; so y is replicated
to every anchor within covering radius plus threshold in that sense (61 of 2^24 on average, whatever the data), and
the pair meets at x's home. Only fingerprints that differ are replicated: equal ones are one row from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.llm.common import bound_arrow, discard, free_name, ordered, table, written
from histomesh.llm.components import components
from histomesh.llm.paragraphs import THRESHOLD as THRESHOLD_SIMILARITY
from histomesh.llm.paragraphs import Search, features

THRESHOLD = 2
SHINGLE = 3
SEED = 42
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY, BLOCK, CHECK = 0b101011100011, 23, 11
CHUNK = 1 << 15


def fingerprint(text: bytes | None, words, digest) -> int:
    """words: finds a text's words; digest: XXH64 of bytes. No shingle: zero."""
    found = words(text.lower()) if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = [0, *(ends[: len(found) - SHINGLE] + 1).tolist()]
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    import xxhash

    words = re.compile(rb"[^\x20\x09-\x0D]+").findall
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py(), words, xxhash.xxh64_intdigest) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a long) of every row."""
    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, f"id {kind}, fp long")


@cache
def _golay():
    """Of each syndrome, the errors of weight 0-3, 4 and 5: (leader, offsets4, errors4, offsets5, errors5); and the two halves of the syndrome table."""
    syndrome = np.zeros(1, np.int64)
    for bit in range(BLOCK):
        value = 1 << bit
        for k in range(BLOCK - 1, CHECK - 1, -1):
            if value >> k & 1:
                value ^= GOLAY << (k - CHECK)
        syndrome = np.concatenate([syndrome, syndrome ^ value]) if bit < 12 else syndrome
        single = np.array([value]) if bit == 0 else np.append(single, value)
    low = syndrome
    high = np.zeros(1, np.int64)
    for bit in range(12, BLOCK):
        high = np.concatenate([high, high ^ single[bit]])
    every = np.arange(1 << BLOCK, dtype=np.int64)
    weight = np.bitwise_count(every)
    near = every[weight <= 5]
    of, w = low[near & 4095] ^ high[near >> 12], np.bitwise_count(near)
    leader = np.zeros(1 << CHECK, np.int64)
    leader[of[w <= 3]] = near[w <= 3]
    lists = []
    for k in (4, 5):
        errors, at = near[w == k], of[w == k]
        order = np.argsort(at, kind="stable")
        lists += [np.concatenate([[0], np.cumsum(np.bincount(at, minlength=1 << CHECK))]), errors[order]]
    return low, high, leader, *lists


def _ragged(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each output and its place in the row's list."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every anchor within covering radius plus threshold of each fingerprint."""
    low, high, leader, o4, e4, o5, e5 = _golay()
    x = prints.astype(np.uint64)
    a, b = (x & 0x7FFFFF).astype(np.int64), (x >> np.uint64(BLOCK) & 0x7FFFFF).astype(np.int64)
    sa, sb = low[a & 4095] ^ high[a >> 12], low[b & 4095] ^ high[b >> 12]
    rows, found, home = [np.arange(len(x))], [(a ^ leader[sa]) << BLOCK | (b ^ leader[sb])], [np.ones(len(x), bool)]

    def add(row, code):
        rows.append(row), found.append(code), home.append(np.zeros(len(row), bool))

    for offsets, errors in ((o4, e4), (o5, e5)):
        row, at = _ragged(offsets[sa], offsets[sa + 1] - offsets[sa])
        add(row, (a[row] ^ errors[at]) << BLOCK | (b ^ leader[sb])[row])
        row, at = _ragged(offsets[sb], offsets[sb + 1] - offsets[sb])
        add(row, (a ^ leader[sa])[row] << BLOCK | (b[row] ^ errors[at]))
    na, nb = o4[sa + 1] - o4[sa], o4[sb + 1] - o4[sb]
    row, at = _ragged(np.zeros(len(x), np.int64), na * nb)
    add(row, (a[row] ^ e4[o4[sa][row] + at // nb[row]]) << BLOCK | (b[row] ^ e4[o4[sb][row] + at % nb[row]]))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def homes(prints: np.ndarray) -> np.ndarray:
    """The home anchor of each fingerprint."""
    low, high, leader, *_ = _golay()
    x = prints.astype(np.uint64)
    a, b = (x & 0x7FFFFF).astype(np.int64), (x >> np.uint64(BLOCK) & 0x7FFFFF).astype(np.int64)
    return (a ^ leader[low[a & 4095] ^ high[a >> 12]]) << BLOCK | (b ^ leader[low[b & 4095] ^ high[b >> 12]])


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(homes(batch.column(0).to_numpy().view(np.uint64))), batch.column(0)], ["anchor", "b"])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        row, anchor, _ = anchors(prints.view(np.uint64))
        for at in range(0, len(row), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[s]), pa.array(prints[row[s]])], ["anchor", "a"])


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """distinct: one column, fp. Returns every pair a > b of fingerprints at 1 to threshold (at most 2) differing bits, once."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the covering is laid out for thresholds of at most 2 bits")
    home, lists = distinct.mapInArrow(_at_home, "anchor long, b long"), distinct.mapInArrow(_anchored, "anchor long, a long")
    meet = (lists["anchor"] == home["anchor"]) & (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return lists.join(home.hint("shuffle_hash"), meet).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, fp (long), component (the least id reachable over links).

    Nulls and empty texts have fingerprint zero and link like any other. Null ids are kept; they never name a
    component unless all its ids are null (then it is null). Repeated rows and ties are kept as they are. Columns of
    docs other than the two named are not looked at. An empty table gives an empty result."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fp")
    reach = components(links(distinct.select("fp")))
    group = distinct.join(reach, distinct["fp"] == reach["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = group.groupBy("root").agg(F.min("least").alias("component"))
    named = written(group.join(names, "root").select("fp", "component"), "fp-components")
    return prints.join(named, "fp").select("id", "fp", "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def near_copies(rows: DataFrame, threshold: float = THRESHOLD_SIMILARITY) -> DataFrame:
    """rows: uid (unique long), text. uid, first_uid (the least uid reachable) of every row whose text has another one of a Jaccard similarity of
    threshold or more on 5-word shingles. A text of fewer words is one shingle; null, empty and blank texts are equal.

    Candidates come from fingerprints of 5-word shingles that meet at anchors. At that similarity fingerprints differ by far more bits than the covering
    is laid out for, so MinHash bands of the same shingles give the others. Each candidate is verified exactly, and links form components."""
    found = features(rows, whole=True)
    search = Search(found)
    distinct = search.distinct.select("pid", "fp")
    prints = written(distinct.groupBy("fp").agg(F.min("pid").alias("lo")), "distinct-fp")
    group = prints.join(components(links(prints.select("fp"))), F.col("fp") == F.col("node"), "left").select("fp", "lo", F.coalesce("component", "fp").alias("root"))
    group = written(group, "fp-groups")
    # each text of a group of fingerprints against one of them
    least = written(group.groupBy("root").agg(F.min("lo").alias("lo")), "fp-least")
    near = distinct.join(group.select("fp", "root"), "fp").join(least, "root").where("pid <> lo").select(F.col("lo").alias("a"), F.col("pid").alias("b"))
    search.pairs = search.pairs.union(written(near, "fp-pairs"))
    texts = written(rows.select("uid", F.col("text").cast("string").alias("text")).join(search.wanted().distinct(), "uid"), "texts")
    out = search.clusters(texts, threshold, whole=True).select("uid", "first_uid")
    discard(found, prints, group, least, texts)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD_SIMILARITY) -> DataFrame:
    """docs without all but one row of each group of near_copies(): the one with the least id (nulls last), then text hash."""
    uid = free_name(docs, "row_uid")
    rows = ordered(docs, uid, id_col, text_col)
    like = near_copies(rows.select(F.col(uid).alias("uid"), F.col(text_col).alias("text")), threshold)
    gone = like.where("uid <> first_uid").select(F.col("uid").alias(uid))
    return rows.join(gone.hint("shuffle_hash"), uid, "left_anti").drop(uid)
