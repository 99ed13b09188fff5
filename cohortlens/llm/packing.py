"""Packing of texts into batches under a token budget, with length buckets that waste the least padding.

The lengths of all texts go into one histogram: exact below 1,024 tokens, above it in bins 1/256 of their size
wide, so it has some thousand bins whatever the corpus. Dynamic programming over the bins chooses the bucket
boundaries with the least padding in total; a boundary is the longest text of its bin. Within a bucket, texts get
consecutive places, counted in parallel by chunks of ids with offsets from the chunks' sizes, and a batch takes as
many as fit the budget at the bucket's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.textops import pieces, split_words
from cohortlens.runtime import Scratch, shuffle_partitions, with_fields

EXACT_BELOW, FINE = 1024, 256


def length_bin(length: Column) -> Column:
    """The histogram bin of a length; longer lengths have no smaller bins."""
    octave = F.greatest(F.floor(F.log2(length / EXACT_BELOW)), F.lit(0))
    width = F.pow(F.lit(2), octave).cast("long") * (EXACT_BELOW // FINE)
    return F.when(length < EXACT_BELOW, length).otherwise(EXACT_BELOW * 16 * (octave + 1) + F.floor(length / width)).cast("long")


def best_boundaries(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Bucket boundaries (ascending, the last is the longest text) and their padding.

    Bin k holds ``count[k]`` texts with ``total[k]`` tokens, the longest ``longest[k]``; bins ascend. Of solutions
    with equal padding the one with fewer buckets, then the one with lower boundaries, is taken.
    """
    n = len(longest)
    if not n:
        return [], 0
    texts, tokens = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(total)))
    cost = np.full(n + 1, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    picks, best = [], None
    for used in range(1, min(buckets, n) + 1):
        new, pick = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            pad = cost[:j] + longest[j - 1] * (texts[j] - texts[:j]) - (tokens[j] - tokens[:j])
            pick[j] = pad.argmin()
            new[j] = pad[pick[j]]
        cost = new
        picks.append(pick)
        if best is None or cost[n] < best[0]:
            best = (int(cost[n]), used)
    out, j = [], n
    for k in range(best[1] - 1, -1, -1):
        out.append(int(longest[j - 1]))
        j = picks[k][j]
    return out[::-1], best[0]


def count_words(docs: DataFrame, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """Adds the number of words (runs without ASCII white space); a null text has 0."""
    docs = docs.drop(*([name] if name in docs.columns else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(split_words(part[text_col]).count, pa.int64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, with_fields(docs.schema, f"`{name}` long"))


def pack(docs: DataFrame, budget: int = 65_536, buckets: int = 16, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """Adds ``bucket`` (0 is the shortest), ``padded_to`` (its boundary) and ``batch`` (number within the bucket).

    A batch holds ``max(1, budget div padded_to)`` texts, all but a bucket's last exactly so many; a text above the
    budget is a batch of its own. In a bucket, texts are placed by the chunk of their id, then by id, null ids first;
    rows that repeat an id take places of their own, in any order. A null or negative length counts as 0. An empty
    table gives an empty one. Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    new = ["bucket", "padded_to", "batch"]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    names = docs.columns
    scratch = Scratch(spark, "packing")
    sized = docs.withColumn("__length", F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)))
    length = F.col("__length")
    bins = sized.groupBy(length_bin(length).alias("bin")).agg(F.max(length).alias("longest"), F.count("*").alias("n"), F.sum(length).alias("total"))
    rows = sorted(bins.collect(), key=lambda r: r["bin"])
    bounds, _ = best_boundaries(*(np.array([r[c] for r in rows], dtype=np.int64) for c in ("longest", "n", "total")), buckets)
    if not bounds:
        return docs.select("*", *[F.lit(None).cast("long").alias(c) for c in new])
    which, padded = F.lit(0), F.lit(bounds[0])
    for k, low in enumerate(bounds[:-1]):
        which, padded = F.when(length > low, F.lit(k + 1)).otherwise(which), F.when(length > low, F.lit(bounds[k + 1])).otherwise(padded)
    chunks = 4 * shuffle_partitions(spark)
    placed = sized.withColumn("bucket", which.cast("long")).withColumn("padded_to", padded.cast("long"))
    placed = placed.withColumn("__chunk", F.pmod(F.coalesce(F.xxhash64(id_col), F.lit(0)), F.lit(chunks)))
    full = placed.groupBy("bucket", "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("bucket").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # over buckets x chunks rows
    offset = scratch.keep(full.select("bucket", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")), "offsets")
    own = Window.partitionBy("bucket", "__chunk").orderBy(F.col(id_col).asc_nulls_first())
    placed = placed.withColumn("__place", F.row_number().over(own) - 1).join(F.broadcast(offset), ["bucket", "__chunk"])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1))))
    batch = F.floor((F.col("__place") + F.col("__offset")) / capacity).cast("long")
    return placed.select(*names, "bucket", "padded_to", batch.alias("batch"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document; lengths in words, 65,536 words a batch, 16 buckets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(count_words(docs).drop("text"))
