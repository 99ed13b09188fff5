"""Sinks. Spark's commit protocol makes every written folder appear whole or not at all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from cohortlens.functions.scalar import not_reference
from cohortlens.runtime import Scratch


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; array columns must be flattened first."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def write_tiers(df: DataFrame, path: str, tier: str = "tier") -> None:
    """``master`` with the tier column, and ``tiers`` partitioned by tier (A, B, C only, the column in the folder name)."""
    write_tsv(df, f"{path}/master")
    df.where(F.col(tier).isin("A", "B", "C")).write.mode("overwrite").partitionBy(tier).csv(f"{path}/tiers", sep="\t", header=True, emptyValue="")


def write_per_sample(calls: DataFrame, path: str, sample: str, gt: str, key: Sequence[str]) -> None:
    """One folder per sample with its non-reference calls, sorted by key."""
    kept = calls.where(not_reference(gt))
    kept.repartition(sample).sortWithinPartitions(sample, *key).write.mode("overwrite").partitionBy(sample).csv(path, sep="\t", header=True)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, order: Sequence[str], fill=0) -> DataFrame:
    """Long to wide with the columns in the given order; names outside it are dropped, absent cells filled."""
    return df.groupBy(*ids).pivot(name, list(order)).agg(F.first(value)).na.fill(fill, list(order)).select(*ids, *[F.col(f"`{c}`") for c in order])


def write_wide(df: DataFrame, path: str, ids: Sequence[str], name: str, value: str, order: Sequence[str]) -> None:
    """The wide table, and ``columns`` beside it with the order."""
    write_tsv(to_wide(df, ids, name, value, order), f"{path}/matrix")
    write_tsv(df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(order)], "n int, column string"), f"{path}/columns")


def dense_ids(df: DataFrame, col: str) -> DataFrame:
    """(col, id): ids from 1 in sorted order, by range partitions and offsets of their sizes."""
    part = df.select(col).distinct().repartitionByRange(col).withColumn("__p", F.spark_partition_id())
    own = part.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(col)))
    sizes = part.groupBy("__p").agg(F.count("*").alias("__s"))
    before = sizes.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return own.join(F.broadcast(before), "__p").select(col, (F.col("__n") + F.col("__b")).alias("id"))


def write_mtx(df: DataFrame, folder: str, gene: str, cell: str, count: str, facts: Mapping[str, object] = {}) -> None:  # noqa: B006
    """A MatrixMarket triple (``matrix.mtx``, ``features.tsv``, ``cells.tsv``, each of ordered part files) and a provenance row."""
    scratch = Scratch(df.sparkSession, "mtx-ids")
    genes, cells = scratch.keep(dense_ids(df, gene), "genes"), scratch.keep(dense_ids(df, cell), "cells")
    entries = df.join(genes.withColumnRenamed("id", "i"), gene).join(cells.withColumnRenamed("id", "j"), cell).select("i", "j", count)
    entries = scratch.keep(entries, "entries", tidy=False)
    size = entries.count()
    head = df.sparkSession.createDataFrame([(-2, "%%MatrixMarket matrix coordinate integer general"), (-1, f"{genes.count()} {cells.count()} {size}")], "i long, value string")
    lines = entries.select(F.col("i").cast("long").alias("i"), F.concat_ws(" ", "i", "j", count).alias("value")).unionByName(head)
    lines.repartitionByRange("i").sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{folder}/matrix.mtx")
    for ids, col, name in ((genes, gene, "features"), (cells, cell, "cells")):
        ids.repartitionByRange("id").sortWithinPartitions("id").select(F.col(col).cast("string")).write.mode("overwrite").text(f"{folder}/{name}.tsv")
    df.sparkSession.createDataFrame([(k, str(v)) for k, v in {**facts, "entries": size}.items()], "fact string, value string").write.mode("overwrite").json(f"{folder}/provenance")
    scratch.drop("genes", "cells", "entries")


def flatten_lists(df: DataFrame, sep: str = ", ") -> DataFrame:
    """Every array column as joined text."""
    joined = {f.name: F.array_join(F.transform(f.name, lambda x: x.cast("string")), sep) for f in df.schema if isinstance(f.dataType, ArrayType)}
    return df.withColumns(joined) if joined else df


def write_bundle(tables: Mapping[str, DataFrame], path: str) -> None:
    """Several named tables, one folder each."""
    for name, table in tables.items():
        write_tsv(flatten_lists(table), f"{path}/{name}")


def signature_inputs(counts: DataFrame, cells: DataFrame, gene: str, cell: str, cls: str, count: str, cap: int, seed: int) -> DataFrame:
    """Genes x capped cells: duplicate symbols summed, one column per cell named ``class_cell``; at most ``cap`` cells a class."""
    from cohortlens.operators.ranking import stratified_cap

    chosen = stratified_cap(cells.select(cell, cls), cls, cell, cap, seed)
    named = chosen.withColumn("column", F.concat(cls, F.lit("_"), F.col(cell).cast("string")))
    order = sorted(r["column"] for r in named.select("column").collect())  # capped cells only
    t = counts.join(named, cell).groupBy(gene, "column").agg(F.sum(count).alias(count))
    return to_wide(t, [gene], "column", count, order)
