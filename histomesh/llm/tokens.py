"""Token counts: batch encoding in Arrow functions that return lengths only.

A batch for the library holds about BATCH bytes, whatever the number of texts. Texts longer than LONG characters are cut at
safe boundaries: before a single space between two ASCII letters, the space itself dropped. This is exact for a
sentence-piece model without normalisation that marks the start of a text like a space and has no piece with a
space mark after another character: no merge can cross such a place. Other models are encoded uncut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.llm.common import bound_arrow, table

MODEL = "piece_bpe_32k.model"
LIMIT, LONG, BATCH = 4096, 1 << 13, 1 << 20
MARK = "▁"


def cuts(text: str, long: int = LONG) -> list[str]:
    """text in parts of about long characters, cut at safe boundaries only; a text without any stays whole."""
    parts, at, safe = [], 0, re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
    while len(text) - at > long and (m := safe.search(text, at + long)):
        parts.append(text[at : m.start()])
        at = m.end()
    return [*parts, text[at:]]


class PieceCounter:
    """Counts of a sentencepiece model: no begin, end or special tokens added, their strings in a text being plain text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        plain = self.model.encode("a b", out_type=str) == [MARK + "a", MARK + "b"] and len(self.model.encode(" a  b ")) > len(self.model.encode("a b"))
        self.cuttable = plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class JsonCounter:
    """Counts of a tokenizers file, uncut."""

    cuttable = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _counter(path: str | None, name: str):
    path = path or model_path(name)
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def lengths(counter, texts: list[str], long: int = LONG, batch: int = BATCH) -> list[int]:
    out, parts, of, size = [0] * len(texts), [], [], 0

    def flush():
        for k, n in zip(of, counter.counts(parts), strict=True):
            out[k] += n
        parts.clear(), of.clear()

    for k, text in enumerate(texts):
        for part in cuts(text, long) if counter.cuttable else [text]:
            parts.append(part)
            of.append(k)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= batch:
                flush()
                size = 0
    flush()
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = MODEL, path: str | None = None) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens of every row. Null counts as empty: 0 and 0. path: of the model file on every machine; else
    public_tokenizers.path(name) there. Rows, ties and repeats stay as they are; columns beside the two named aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, name)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lengths(counter, texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
