"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). Per source, whole copies and a proportional share of each length come
first; what remains of the budget is fitted by bounded-knapsack dynamic programming over the lengths left. Documents
are then chosen by seeded hash, as many of each length as the plan says. Only counts by length reach Python; the
choice of documents never sorts more than one hash bucket of a length at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from histomesh.llm.common import WORD, free_name, table, written

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, 17
#: Words of the budget that are left to the knapsack at least (all of a smaller budget); documents in a hash bucket, about.
ROOM, BUCKET = 4096, 64
#: Rows of a plan (a row a source and length) that may be broadcast.
PLAN_ROWS = 200_000
KEY, ADDED = ["missing", "src", "size"], ("size", "source_size", "target", "taken")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """totals: missing (1 for the null source), src, source_size. Adds target: share of all sizes by weight in order of code point,
    null last; none above cap times its size, the excess reshared by weight. One row a source."""
    order = Window.orderBy("missing", "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("w", w).withColumn("most", cap * F.col("source_size"))
    below, every = Window.orderBy(F.col("most") / F.col("w"), "missing", "src").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum(share * F.col("source_size")).over(every) - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    first = F.when(F.col("most") >= F.col("level") * F.col("w"), F.struct((F.col("most") / F.col("w")).alias("ratio"), "missing", "src", "level"))
    rows = rows.withColumn("fill", F.min(first).over(every)["level"])
    return rows.select("missing", "src", "source_size", F.least("most", F.coalesce(F.col("fill") * F.col("w"), F.col("most"))).alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length (positive, distinct) to take so that their sum is as near below budget as can be
    found: proportional shares, one more of the longest while room is left, then subset sums exactly."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total or not total:
        return list(counts)
    take = [max(0, budget - ROOM) * c // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if take[i] < counts[i] and left - lengths[i] >= ROOM:
            take[i] += 1
            left -= lengths[i]
    items, steps, reach, full = [], [], 1, (1 << left + 1) - 1
    for i in order:
        n, room = lengths[i], min(counts[i] - take[i], left // lengths[i])
        part = 1
        while room and not reach >> left & 1:
            k = min(part, room)
            steps.append(reach)
            items.append((i, k))
            reach |= reach << n * k & full
            room, part = room - k, 2 * part
    at = reach.bit_length() - 1
    for (i, k), before in zip(reversed(items), reversed(steps), strict=True):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    copies = int(target // size) if size else 0
    some = rows[rows["size"] > 0]
    rest = int(round(target)) - copies * size
    take = fit_budget(some["size"].tolist(), some["n"].tolist(), max(0, rest)) if len(some) else []
    return some.assign(copies=copies, extra=take)[["missing", "src", "size", "n", "source_size", "target", "copies", "extra"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns keep; all by default) with size (words), source_size, target, taken (words, repeats counted) added; columns of these
    names are replaced.

    Null and empty texts have size 0 and are taken 0 times; the null source is one more source; a source of size 0 has
    target 0. Documents are chosen in order of a seeded hash of id and text; rows that share both are chosen in any order. So reruns agree.
    An empty table gives an empty result."""
    own = free_name(docs, "mix_key")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    named = F.struct(F.col(source_col).isNull().cast("int").alias("missing"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), size.alias("size"), h.alias("h"))
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    rows = written(docs.select(*[F.col(f"`{c}`") for c in cols], named.alias(own)), "mix-rows")
    small = rows.select(f"{own}.*")
    hist = written(small.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    goal = written(targets(hist.groupBy("missing", "src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "mix-targets")
    schema = "missing int, src string, size long, n long, source_size long, target double, copies int, extra long"
    plan = hist.join(goal, ["missing", "src"]).groupBy("missing", "src").applyInPandas(_plan, schema)
    none = hist.where("size = 0").join(goal, ["missing", "src"]).select(*KEY, "n", "source_size", "target", F.lit(0).alias("copies"), F.lit(0).cast("long").alias("extra"))
    plan = written(plan.union(none), "mix-plan")
    # of a length that is taken in part, the hash up to which: only the bucket of the hash order in which the quota ends is ranked
    place = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.ceil(F.col("n") / BUCKET))
    part = written(small.join(plan.where("extra > 0 and extra < n").select(*KEY, "n", "extra"), KEY).withColumn("b", place), "mix-parts")
    bins = part.groupBy(*KEY, "b", "extra").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", F.sum("m").over(Window.partitionBy(*KEY).orderBy("b")))
    cut = written(bins.where("upto >= extra and upto - m < extra").select(*KEY, "b", (F.col("extra") - F.col("upto") + F.col("m")).alias("quota")), "mix-cuts")
    ranked = part.join(cut, [*KEY, "b"]).groupBy(*KEY, "quota", "h").agg(F.count(F.lit(1)).alias("ties"))
    ranked = ranked.withColumn("upto", F.sum("ties").over(Window.partitionBy(*KEY).orderBy("h"))).where("upto >= quota and upto - ties < quota")
    plan = written(plan.join(ranked.select(*KEY, F.col("h").alias("last"), "ties", (F.col("quota") - F.col("upto") + F.col("ties")).alias("quota")), KEY, "left"), "mix-plan")
    if plan.count() <= PLAN_ROWS:
        plan = F.broadcast(plan)  # of checked size; beyond it rows are joined by a shuffle
    it = lambda c: F.col(f"{own}.{c}")
    both = rows.join(plan.select(F.struct("*").alias("plan")), (it("missing") == F.col("plan.missing")) & (it("src") == F.col("plan.src")) & (it("size") == F.col("plan.size")))
    more = F.when(F.col("plan.last").isNull(), F.col("plan.extra") > 0).otherwise(it("h") <= F.col("plan.last"))
    added = lambda more: [it("size").alias("size"), F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), (it("size") * (F.col("plan.copies") + more.cast("int"))).alias("taken")]
    tied = F.coalesce((it("h") == F.col("plan.last")) & (F.col("plan.ties") > F.col("plan.quota")), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("plan.missing", "plan.src", "plan.size").orderBy(it("h")))
    some = both.where(tied).withColumn("place", rank)
    kept = [F.col(f"`{c}`") for c in cols]
    return both.where(~tied).select(*kept, *added(more)).union(some.select(*kept, *added(F.col("place") <= F.col("plan.quota"))))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
