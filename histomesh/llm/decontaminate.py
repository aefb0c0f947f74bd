"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of benchmark items: runs of 10 words, or a shorter item whole. Patterns of one length form a
searcher: a table of blocks (two neighbouring words; one for patterns of one word) gives how far the search may jump;
patterns whose last block allows no jump lie in buckets by that block's slot, sorted by a hash of the whole pattern; direct
comparison of the words confirms. An index holds a block of benchmark items in flat arrays, built once on the driver and
unpickled once a Python worker. Each task scans its documents' whole texts once, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.llm.common import bound_arrow, held, sent, table, with_row_id, written

WINDOW = 10
#: Bytes of benchmark text in one broadcast; more are searched in further passes. An index takes about INDEX_FACTOR times that at most.
BLOCK_BYTES, INDEX_FACTOR = 16 << 20, 20
FIND = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
_P = np.uint64(0x9E3779B97F4A7C15)
#: Slots of a shift table: a power of two, at least so many for each block, within these bounds.
SPARE, SLOTS = 8, (16, 26)


def words(text: bytes | None) -> list[bytes]:
    return FIND(text.lower()) if text else []


def hashes(found: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def _codes(h: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Hash of the length words up to each end (excluded)."""
    out = np.zeros(len(ends), np.uint64)
    for k in range(length):
        out = (out ^ h[ends - length + k]) * _P
        out ^= out >> np.uint64(29)
    return out


class Searcher:
    """Wu-Manber over sequences of word hashes, all patterns of one length. starts: the place of each pattern's first word in h."""

    def __init__(self, length: int, starts: np.ndarray, h: np.ndarray):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.bits = int(min(SLOTS[1], max(SLOTS[0], np.ceil(np.log2(SPARE * max(1, len(starts)))))))
        shift = np.full(1 << self.bits, min(self.most, 255), np.uint8)
        for end in range(self.block, length + 1):
            # shifts fall with end, so that the least one stays
            shift[self.slots(h, starts + end)] = min(length - end, 255)
        self.shift = shift
        keys = self.keys(h, starts + length)
        order = np.argsort(keys, kind="stable")
        self.bucket, self.starts = keys[order], starts[order].astype(np.int32)

    def slots(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slot of the block up to each end (excluded)."""
        x = h[ends - 1] if self.block == 1 else (h[ends - 2] * _P) ^ h[ends - 1]
        return (x * _P >> np.uint64(64 - self.bits)).astype(np.int64)

    def keys(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The last block's slot in front, then the hash of the whole pattern."""
        rest = np.uint64(64 - self.bits)
        return self.slots(h, ends).astype(np.uint64) << rest | _codes(h, ends, self.length) >> np.uint64(self.bits)

    def search(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, first place in the bucket) of each stretch whose pattern hash is that of a pattern."""
        n = len(h)
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        shift, end, ends = self.shift[self.slots(h, np.arange(self.block, n + 1))].tobytes(), self.length, []
        back = self.block
        while end <= n:
            if jump := shift[end - back]:
                end += jump
            else:
                ends.append(end)
                end += 1
        ends = np.array(ends, np.int64)
        if not len(ends):
            return ends, ends
        keys = self.keys(h, ends)
        at = np.searchsorted(self.bucket, keys)
        same = self.bucket[np.minimum(at, len(self.bucket) - 1)] == keys
        return ends[same], at[same]


class Index:
    """Searchers of a block of benchmark items, and the items of each pattern."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        ids, counts, parts, sizes = [], [], [], [np.zeros(0, np.int64)]
        found = []
        for item, text in items:
            if w := words(text):
                ids.append(item)
                counts.append(len(w))
                parts.append(b" ".join(w))
                sizes.append(np.fromiter(map(len, w), np.int64, len(w)))
                found.append(hashes(w))
        #: the words of all items, one space behind each, and where each begins
        self.ids, self.text = ids, b" ".join([*parts, b""])
        self.places = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes) + 1)]).astype(np.int32)
        h, n = np.concatenate([np.zeros(0, np.uint64), *found]), np.array(counts, np.int64)
        self.firsts = (np.cumsum(n) - n).astype(np.int32)
        last = np.repeat(self.firsts + np.maximum(n - window, 0), n)
        place = np.arange(len(h))
        length = np.repeat(np.minimum(n, window), n)
        start = place <= last
        self.searchers = [Searcher(int(k), place[start & (length == k)], h) for k in np.unique(length).tolist()]
        self._known: dict[tuple, dict] = {}

    def nbytes(self) -> int:
        return len(self.text) + self.places.nbytes + self.firsts.nbytes + sum(s.shift.nbytes + s.bucket.nbytes + s.starts.nbytes for s in self.searchers)

    def _owners(self, k: int, at: int) -> dict[bytes, set]:
        """Of the patterns whose key is that at place at of searcher k's buckets: their words, and the items that have them."""
        if (out := self._known.get((k, at))) is None:
            s = self.searchers[k]
            to = int(np.searchsorted(s.bucket, s.bucket[at], "right"))
            starts, out = s.starts[at:to], {}
            which = np.searchsorted(self.firsts, starts, "right") - 1
            for a, b, i in zip(self.places[starts].tolist(), self.places[starts + s.length].tolist(), which.tolist(), strict=True):
                own = out.setdefault(self.text[a : b - 1], set())
                if self.ids[i] is not None:
                    own.add(str(self.ids[i]))
            if len(self._known) > 256:
                self._known.clear()
            self._known[k, at] = out
        return out

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit stretches (start, end; of one searcher in order) and the items that occur, as strings."""
        h, spans, items = hashes(found), [], set()
        for k, searcher in enumerate(self.searchers):
            n, fresh = searcher.length, True
            for end, at in zip(*(x.tolist() for x in searcher.search(h)), strict=True):
                own = self._owners(k, at).get(b" ".join(found[end - n : end]))
                if own is None:
                    continue
                items |= own
                if not fresh and spans[-1][1] >= end - n:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((end - n, end))
                    fresh = False
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    n = upto = 0
    for start, end in sorted(spans):
        n += max(0, end - max(start, upto))
        upto = max(upto, end)
    return n


def _blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """(key, broadcast of a pickled index) of each block_bytes of text or so. Items stream to the driver, one block in memory at a time."""
    out, block, size = [], [], 0

    def send():
        out.append(sent(spark, Index(block, window)))

    rows = benchmark.select(F.col(item_col), F.col(text_col).cast("string").cast("binary")).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        block.append((item, bytes(text)))
        size += len(text) + 64
        if size >= block_bytes:
            send()
            block, size = [], 0
    if block or not out:
        send()
    return out


def _scan(key: str, broadcast):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(key, broadcast)
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = words(text.as_py())
                where, which = index.hits(found) if found else ([], set())
                n.append(len(found))
                spans.append([x for pair in where for x in pair])
                items.append(sorted(which))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["key", "n_words", "spans", "items"])

    return scan


def _pass(key: str, broadcast, place: int):
    """Rows in whose column at place no pattern occurs."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(key, broadcast)
        for batch in batches:
            clean = [not (found := words(x.as_py())) or not index.hits(found)[0] for x in batch.column(place).cast(pa.binary())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return keep


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [sorted(set(x)) for x in batch.column(3).to_pylist()]
        hit = [covered(list(zip(x[::2], x[1::2], strict=True))) for x in batch.column(2).to_pylist()]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(sha)],
            ["key", "n_words", "n_hit", "n_items", "items", "items_sha256"],
        )


def search(docs: DataFrame, benchmark: DataFrame, key_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, n_hit (words inside an occurrence), n_items, items (ids as sorted strings), items_sha256 per row of docs.

    Null and empty texts have no words; items without words have no window; equal ids count once and null ids not at
    all (their windows still hit). An empty benchmark hits nothing. Only the two columns named are read. The benchmark
    is broadcast in blocks of about block_bytes of text (an item is never split); with more than one, docs are scanned once for each and a
    row's hits are united by row number."""
    spark = docs.sparkSession
    bound_arrow(spark)
    blocks = _blocks(spark, benchmark, item_col, item_text_col, window, block_bytes)
    kind = docs.schema[key_col].dataType.simpleString()
    out = "key {}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string"
    text = F.col(text_col).cast("string").alias("text")
    if len(blocks) == 1:
        found = docs.select(F.col(key_col).alias("key"), text).mapInArrow(_scan(*blocks[0]), f"key {kind}, n_words long, spans array<int>, items array<string>")
        return found.mapInArrow(_digest, out.format(kind))
    rows = written(with_row_id(docs.select(F.col(key_col).alias("k"), text), "r").select(F.struct("r", "k").alias("key"), "text"), "decon-rows")
    keys = f"struct<r:bigint,k:{kind}>"
    passes = [rows.mapInArrow(_scan(*b), f"key {keys}, n_words long, spans array<int>, items array<string>") for b in blocks]
    union = passes[0]
    for x in passes[1:]:
        union = union.union(x)
    # one row a block for each key
    found = union.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return found.mapInArrow(_digest, out.format(keys)).withColumn("key", F.col("key.k"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows in which a benchmark window occurs, in one pass over whole rows for each block of the benchmark: no shuffle, no join.
    Null and empty texts stay; repeated rows fare alike; other columns, whatever their names, are carried unchanged."""
    bound_arrow(docs.sparkSession)
    out = docs
    for block in _blocks(docs.sparkSession, benchmark, item_col, item_text_col, window, block_bytes):
        out = out.mapInArrow(_pass(*block, docs.columns.index(text_col)), docs.schema)
    return out


_FIND = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_FIND} as w from documents),
b as (select item_id, {_FIND} as w from benchmark),
p as (select item_id, len(s) as k, s from (select item_id, unnest(case when len(w) = 0 then []
 else list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_slice(w, i, least(i + 9, len(w)))) end) as s from b)),
k as (select distinct k from p),
x as (select r, k, unnest(range(1, len(w) - k + 2)) as i from d, k where len(w) >= k),
g as (select x.r, x.k, x.i, list_slice(d.w, x.i, x.i + x.k - 1) as s from x join d using (r)),
h as (select distinct g.r, g.i, g.k, p.item_id from g join p on g.k = p.k and g.s = p.s),
hit as (select r, count(distinct i + j) as n from (select r, i, unnest(range(k)) as j from h) group by r),
it as (select r, count(*) as n, string_agg(v, ',' order by v) as ids from (select distinct r, item_id::varchar as v from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(it.n, 0)::bigint as n_items,
 sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (r) left join it using (r)
"""
