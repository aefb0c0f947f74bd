"""Substring dedup by paragraph MinHash banding.

Paragraphs are a text's lines of at least MIN_WORDS words (lower case A-Z). Equal ones collapse to one row first. MinHash
signatures over 5-word shingles are banded; the bands are tuned so that paragraphs at the threshold collide with
probability RECALL at least. Colliding paragraphs are verified by the exact Jaccard similarity of their shingle sets, and
verified links form components; of each component the first paragraph stays, the others are removals.

No bucket emits all its pairs. Its members are first verified against two of them. What larger
buckets still hold apart is compared block against block: a task holds two blocks, counts common shingles by matrix
products and returns links enough to join what belongs together. So no link is lost, whatever a bucket's size.

Passages that sit inside different lines are found by winnowed stretches of words, which fall on the same words wherever a
passage stands. Each is extended word by word against one earlier text that has it; what that text has too is a removal as well.

Rows are numbered in order of id and text, so what stays does not depend on the files' layout. One scan of the texts gives both searches
their features; the texts that they compare are fetched once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histomesh.llm.common import bound_arrow, discard, free_name, ordered, table, with_row_id, written
from histomesh.llm.components import components
from histomesh.llm.shingles import FIND, SHINGLE, Known, Signer, majorities, marks, shingled

THRESHOLD, MIN_WORDS = 0.8, 30
#: Chance at least that a pair at the threshold collides, chance at most that one at NOISE does.
RECALL, NOISE, CHANCE = 0.999, 0.1, 0.1
#: The same for whole texts, of which more share a little.
WHOLE_NOISE = 0.25
#: Bytes of text whose features are computed at once, about.
CHUNK = 1 << 20
#: Members of a block and bytes of it, about; shingles counted in one matrix product.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 1 << 20, 1 << 13
#: Words of a passage at least; of so many successive stretches of that length one is a mark. Every equal stretch of 40 words is found.
LEAST = 22
WINDOW = 40 - LEAST + 1


def tune(threshold: float = THRESHOLD, recall: float = RECALL, noise: float = NOISE, chance: float = CHANCE) -> tuple[int, int]:
    """(bands, rows): the fewest bands, of as few rows as keep noise down, that reach the recall."""
    for rows in range(1, 33):
        bands = next(b for b in range(1, 1 << 20) if 1 - (1 - threshold**rows) ** b >= recall)
        if 1 - (1 - noise**rows) ** bands <= chance:
            return bands, rows
    raise ValueError("no banding fits")


_PARAGRAPHS = pa.struct([("idx", pa.int32()), ("n_words", pa.int32()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("fp", pa.int64())])
_MARKS = pa.struct([("start", pa.int32()), ("key", pa.int64())])
FEATURES = "uid long, ps array<struct<idx:int,n_words:int,key:binary,bands:array<bigint>,fp:bigint>>, ms array<struct<start:int,key:bigint>>"


def _features(bands: int, rows: int, min_words: int, whole: bool):
    """uid, ps (the text's paragraphs), ms (its marks). whole: the text is one paragraph, has a fingerprint and no marks."""

    def of(uids: list[int], texts: list[bytes], known: Known, signer: Signer) -> pa.RecordBatch:
        import xxhash

        words, keys, at, counts, first, n_marks, places, hashes = [], [], [], [], [0], [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for text in texts:
            lines = [FIND(line) for line in ([text] if whole else text.split(b"\n"))]
            for k, line in enumerate(lines):
                if len(line) >= min_words:
                    words += line
                    keys.append(xxhash.xxh3_128_digest(b" ".join(line)))
                    at.append(k)
                    counts.append(len(line))
            first.append(len(keys))
            if not whole:
                start, key = marks(known.numbers([w for line in lines for w in line]), LEAST, WINDOW)
                places.append(start), hashes.append(key), n_marks.append(len(start))
            else:
                n_marks.append(0)
        x, starts = shingled(known.numbers(words), np.array(counts, np.int64))
        sign = signer.sign(x, starts).reshape(-1) if len(starts) else np.zeros(0, np.int64)
        prints = majorities(x, starts) if whole and len(starts) else np.zeros(len(starts), np.int64)
        if whole:
            prints[np.array(counts, np.int64) == 0] = 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sign) + 1, bands), pa.int32()), pa.array(sign))
        ps = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(counts, pa.int32()), pa.array(keys, pa.binary()), lists, pa.array(prints, pa.int64())], fields=list(_PARAGRAPHS))
        ms = pa.StructArray.from_arrays([pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(hashes).view(np.int64))], fields=list(_MARKS))
        ends = np.concatenate([[0], np.cumsum(n_marks)])
        return pa.RecordBatch.from_arrays(
            [pa.array(uids, pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), ps), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ms)], ["uid", "ps", "ms"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = Known(), Signer(bands, rows)
        uids, texts, size = [], [], 0
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                uids.append(uid)
                texts.append((text.as_py() or b"").lower())
                size += len(texts[-1])
                if size >= CHUNK:
                    yield of(uids, texts, known, signer)
                    uids, texts, size = [], [], 0
        if uids:
            yield of(uids, texts, known, signer)

    return run


def features(rows: DataFrame, whole: bool = False) -> DataFrame:
    """rows: uid, text. The features of every row, in a written table."""
    bound_arrow(rows.sparkSession)
    bands, per_band = tune(noise=WHOLE_NOISE if whole else NOISE)
    return written(rows.select("uid", F.col("text").cast("string")).mapInArrow(_features(bands, per_band, 0 if whole else MIN_WORDS, whole), FEATURES), "features")


def jaccard(a: bytes, b: bytes) -> float:
    """Exact similarity of the sets of 5-word shingles; a shorter paragraph is one shingle."""
    return _similarity(_shingle_set(a), _shingle_set(b))


def _shingle_set(body: bytes) -> set:
    w = FIND(body.lower())
    return set(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) or {tuple(w)}


def _similarity(x: set, y: set) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            keep = []
            for a, body_a, body_b in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                if a != last:
                    last, own = a, _shingle_set(body_a.as_py())
                keep.append(_similarity(own, _shingle_set(body_b.as_py())) >= threshold)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _compare(threshold: float):
    """Links among the members of two blocks of a bucket, enough to join every pair at the threshold that is still apart."""

    def run(rows: pa.Table) -> pa.Table:
        keys, parts = rows.column("pid").to_pylist(), rows.column("c").to_pylist()
        sets = [_shingle_set(x.as_py()) for x in rows.column("body").cast(pa.binary())]
        number: dict = {}
        owner, column = [], []
        for k, own in enumerate(sets):
            owner += [k] * len(own)
            column += [number.setdefault(x, len(number)) for x in own]
        owner, column = np.array(owner), np.array(column)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, len(number), COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, len(number) - at)), np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            common += part @ part.T
        sizes = np.array([len(x) for x in sets], np.float32)
        similar = common >= threshold * (sizes[:, None] + sizes - common) - 1e-4
        root = {c: c for c in parts}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        left, right = [], []
        for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
            if (x := find(parts[i])) != (y := find(parts[j])):
                root[x] = y
                left.append(keys[i]), right.append(keys[j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


class Search:
    """Clusters of equal or similar paragraphs among rows of features(). wanted(): the rows whose texts it compares; clusters(): the result."""

    def __init__(self, found: DataFrame):
        self.every = found.select("uid", F.explode("ps").alias("p")).select("uid", "p.*")
        distinct = self.every.groupBy("key").agg(F.min(F.struct("uid", "idx")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp"))
        # one number for each distinct paragraph, written with it
        self.distinct = written(with_row_id(distinct, "pid"), "distinct-paragraphs")
        where = self.distinct.select("pid", F.posexplode("bands").alias("band", "hash"))
        crowded = written(where.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("size"), F.min("pid").alias("lo"), F.max("pid").alias("hi")).where("size > 1"), "buckets")
        self.members = written(where.join(crowded, ["band", "hash"]), "bucket-members")
        discard(crowded)
        pair = lambda other: self.members.where(F.col("pid") != F.col(other)).select(F.least("pid", other).alias("a"), F.greatest("pid", other).alias("b"))
        self.pairs = pair("lo").union(pair("hi"))

    def wanted(self) -> DataFrame:
        pids = self.pairs.select("a").union(self.pairs.select("b")).distinct()
        return pids.join(self.distinct, F.col("a") == F.col("pid")).select("first.uid")

    def clusters(self, texts: DataFrame, threshold: float = THRESHOLD, whole: bool = False) -> DataFrame:
        """texts: uid, text of the rows wanted. Returns every paragraph that has an equal or similar one elsewhere (same text included): uid, idx
        (line number from 0), n_words, first_uid, first_idx (of the one that stays: least uid, then line)."""
        pairs = written(self.pairs.distinct(), "pairs")
        need = pairs.select("a").union(pairs.select("b")).distinct().join(self.distinct, F.col("a") == F.col("pid")).select("pid", "first.uid", "first.idx")
        line = F.col("text") if whole else F.get(F.split("text", "\n"), F.col("idx"))
        bodies = written(need.join(texts, "uid").select("pid", line.alias("body")), "bodies")

        left, right = bodies.select(F.col("pid").alias("a"), F.col("body").alias("body_a")), bodies.select(F.col("pid").alias("b"), F.col("body").alias("body_b"))
        links = written(pairs.join(right, "b").join(left, "a").select("a", "b", "body_a", "body_b").mapInArrow(_verify(threshold), "a long, b long"), "verified")
        of = written(components(links), "paragraph-components")
        # in buckets of up to three, the two comparisons of each member were all; of larger ones, those that still hold more than one component
        now = self.members.where("size >= 4").join(of, F.col("pid") == F.col("node"), "left").select("band", "hash", "pid", F.coalesce("component", "pid").alias("c"))
        now = written(now, "bucket-components")
        split = now.groupBy("band", "hash").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band", "hash")
        apart = written(now.join(written(split, "split"), ["band", "hash"]).join(bodies, "pid"), "apart")
        blocks = apart.groupBy("band", "hash").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("body")) / BLOCK_BYTES)).cast("int").alias("blocks"))
        rest = apart.join(written(blocks, "blocks"), ["band", "hash"]).withColumn("own", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = rest.select("band", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "pid", "c", "body")
        more = written(rest.groupBy("band", "hash", "i", "j").applyInArrow(_compare(threshold), "a long, b long"), "block-links")
        if not more.isEmpty():
            of = written(components(links.union(more)), "paragraph-components")
        named = self.distinct.select("pid", "key", "first", "n").join(of, F.col("pid") == F.col("node"), "left").select("key", "first", "n", F.coalesce("component", "pid").alias("c"))
        named = written(named, "paragraph-clusters")
        groups = written(named.groupBy("c").agg(F.sum("n").alias("n"), F.min("first").alias("stays")).where("n > 1").select("c", "stays"), "clusters")
        shared = written(named.select("key", "c").join(groups, "c").select("key", "stays"), "shared-keys")
        out = written(self.every.select("uid", "idx", "n_words", "key").join(shared, "key").select("uid", "idx", "n_words", F.col("stays.uid").alias("first_uid"), F.col("stays.idx").alias("first_idx")), "shared-paragraphs")
        discard(pairs, bodies, links, of, now, apart, more, named, groups, shared, self.distinct, self.members)
        return out


def stretches(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in x, stop in x, start in y) of the longest equal stretches around the seeds, those of least words or more."""
    out, upto = [], {}
    for i, j in sorted(seeds):
        if i < upto.get(i - j, 0):
            continue
        n, back = min(len(x) - i, len(y) - j), min(i, j)
        differs = x[i : i + n] != y[j : j + n]
        right = int(differs.argmax()) if differs.any() else n
        differs = x[i - back : i][::-1] != y[j - back : j][::-1]
        left = int(differs.argmax()) if differs.any() else back
        upto[i - j] = i + max(right, 1)
        if left + right >= least:
            out.append((i - left, i + right, j - left))
    return out


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Known()
    last, other = None, None
    for batch in batches:
        rows = []
        columns = [batch.column(k).to_pylist() for k in range(3)]
        for uid, first, seeds, text, early in zip(*columns, batch.column(3).cast(pa.binary()), batch.column(4).cast(pa.binary()), strict=True):
            if first != last:
                last, other = first, known.numbers(FIND(early.as_py().lower()))
            own = known.numbers(FIND(text.as_py().lower()))
            for start, stop, at in stretches(own, other, [(x["start"], x["at"]) for x in seeds]):
                rows += [(uid, start, stop, first), (first, at, at + stop - start, first)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["uid", "start", "stop", "first_uid"])


def seeds(found: DataFrame) -> DataFrame:
    """found: features. uid, first_uid, seeds (start, at): a row's marks that an earlier row has too, by the earliest row that has them."""
    every = found.select("uid", F.explode("ms").alias("m")).select("uid", "m.start", "m.key")
    shared = written(every.groupBy("key").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi").select("key", F.col("lo").alias("first_uid")), "shared-marks")
    marked = written(every.join(shared, "key"), "marks")
    at = written(marked.where("uid = first_uid").groupBy("key").agg(F.min("start").alias("at")), "first-marks")
    rows = marked.where("uid <> first_uid").join(at, "key").groupBy("uid", "first_uid").agg(F.collect_list(F.struct("start", "at")).alias("seeds"))  # a text's own marks
    rows = written(rows, "seeds")
    discard(shared, marked, at)
    return rows


def passages(seeds: DataFrame, texts: DataFrame) -> DataFrame:
    """seeds: of seeds(); texts: uid, text of their rows. Returns the stretches of LEAST words or more that a row and an earlier one (lesser uid)
    have in common: uid, start, stop (words of the text, stop excluded), first_uid (the earlier row). Each is compared word by word with that
    row and as long as can be; the earlier row has its own (first_uid = uid). Every equal stretch of LEAST + WINDOW - 1 words has a mark that
    names the earliest row with that mark, so rows that share one are linked through rows that truly share LEAST words. Words are compared
    by 64-bit hash."""
    early = texts.select(F.col("uid").alias("first_uid"), F.col("text").alias("early"))
    full = seeds.join(texts, "uid").join(early, "first_uid").select("uid", "first_uid", "seeds", "text", "early")
    return written(full.mapInArrow(_extend, "uid long, start int, stop int, first_uid long").distinct(), "passages")


def repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: uid, text. (paragraphs, passages): what Search.clusters() and passages() find among them."""
    found = features(rows)
    search, start = Search(found), seeds(found)
    wanted = search.wanted().union(start.select("uid")).union(start.select("first_uid")).distinct()
    texts = written(rows.select("uid", F.col("text").cast("string").alias("text")).join(written(wanted, "wanted"), "uid"), "texts")
    out = search.clusters(texts), passages(start, texts)
    discard(found, start, texts)
    return out


def merged(runs: DataFrame) -> DataFrame:
    """uid, start, stop: the stretches of each row, those that overlap or touch as one."""
    w = Window.partitionBy("uid").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.select("uid", "start", "stop", F.coalesce(F.col("start") > before, F.lit(True)).cast("int").alias("fresh"))
    return fresh.withColumn("run", F.sum("fresh").over(w)).groupBy("uid", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


REMOVED = "(uid <> first_uid or idx <> first_idx)"


def shared_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, class_id (least id reachable over paragraphs and passages shared with other documents; its own if none), n_paragraphs
    shared with another row or line, n_removed of them that are not their cluster's first, n_passages (stretches that another row has too, overlapping ones as one),
    n_passages_removed (the same of those that an earlier row has).

    Null and empty texts have no paragraphs. Which paragraph stays is settled by id (nulls last), the text's hash, then line. Repeated rows share all
    their paragraphs; null ids have class null and link nothing. Only the two columns named are read."""
    rows = ordered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "uid", "id", "text")
    lines, runs = repeats(rows)
    ids = rows.select("uid", "id")
    first = ids.select(F.col("uid").alias("first_uid"), F.col("id").alias("first_id"))
    pairs = lines.select("uid", "first_uid").union(runs.select("uid", "first_uid")).where("uid <> first_uid").distinct().join(first, "first_uid").join(ids, "uid")
    reach = written(components(pairs.select(F.col("id").alias("a"), F.col("first_id").alias("b"))), "document-components")
    per_line = lines.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.expr(f"count_if{REMOVED}").alias("r"))
    per_run = merged(runs).groupBy("uid").agg(F.count(F.lit(1)).alias("p"))
    per_cut = merged(runs.where("uid <> first_uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("q"))
    out = ids.join(per_line, "uid", "left").join(per_run, "uid", "left").join(per_cut, "uid", "left").join(reach, F.col("id") == F.col("node"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("id", F.coalesce("component", "id").alias("class_id"), zero("n").alias("n_paragraphs"), zero("r").alias("n_removed"), zero("p").alias("n_passages"), zero("q").alias("n_passages_removed"))


def op2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. A document with n_paragraphs = 0 and n_passages = 0 shares no passage."""
    return shared_paragraphs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _without(text: bytes, lines: set[int], spans: list[tuple[int, int]]) -> bytes:
    """text less the lines and the stretches of words given; line breaks beside what stays are kept."""
    out, at = [], 0
    spans = sorted(spans)
    for idx, line in enumerate(text.split(b"\n")):
        words = list(re.finditer(rb"[^\x20\x09-\x0D]+", line))
        gone = [any(a <= at + k < b for a, b in spans if a < at + len(words) and b > at) for k in range(len(words))]
        at += len(words)
        if idx in lines or words and all(gone):
            continue
        if any(gone):
            stay, since = [], 0
            for m, g in zip(words, gone, strict=True):
                if g:
                    stay.append(line[since : m.start()].rstrip())
                    since = m.end()
            line = b" ".join(x.strip() for x in [*stay, line[since:]] if x.strip())
        out.append(line)
    return b"\n".join(out)


def _cut():
    """text less lines and spans; null for a null text. Only the texts that lose something go to Python."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, lines: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, gone, stretches in zip(text, lines, spans, strict=True):
            at = [(x["start"], x["stop"]) for x in stretches] if stretches is not None else []
            out.append(None if t is None else _without(t.encode(), set() if gone is None else {int(x) for x in gone}, at).decode())
        return pd.Series(out, dtype=object)

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every paragraph and passage that repeats an earlier one (by id, nulls last, then the text's hash) taken out of its text; a text of
    nothing but such goes with its row. Rows without repeats, null texts among them, are unchanged. chars_col, if there, is counted anew."""
    uid, cut, lines_col, spans_col = (free_name(docs, n) for n in ("row_uid", "text_cut", "lines_gone", "spans_gone"))
    rows = ordered(docs, uid, id_col, text_col)
    lines, runs = repeats(rows.select(F.col(uid).alias("uid"), F.col(text_col).alias("text")))
    lines = lines.where(REMOVED).groupBy("uid").agg(F.collect_set("idx").alias("lines"))  # a text's own lines
    runs = merged(runs.where("uid <> first_uid")).groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # and stretches
    gone = written(lines.join(runs, "uid", "full_outer"), "removals")
    # texts are joined once, by the same shuffle at every size, against the smaller side, without being sorted; the cut ones are told by a non-null list
    gone = gone.select(F.col("uid").alias(uid), F.col("lines").alias(lines_col), F.col("spans").alias(spans_col)).hint("shuffle_hash")
    both = rows.join(gone, uid, "left")
    lost = F.col(lines_col).isNotNull() | F.col(spans_col).isNotNull()
    both = both.withColumn(cut, _cut()(F.when(lost, F.col(text_col)), F.col(lines_col), F.col(spans_col)))
    out = both.withColumn(text_col, F.when(lost, F.col(cut)).otherwise(F.col(text_col))).where(~lost | F.col(cut).rlike(r"[^\x20\x09-\x0D]")).drop(uid, cut, lines_col, spans_col)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
