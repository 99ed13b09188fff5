"""Incremental ingestion of per-sample count files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.operators.aggregate import marker_expression


def incremental_samples(spark: SparkSession, source: str, target: str, checkpoint: str, panel: DataFrame, sample: Column | None = None) -> None:
    """Takes the count files that are new under ``source``, appends their counts and marker rows under ``target``, and ends.

    A file stream with the available-now trigger; each sample is a file of its own, so batches do not interact and no
    watermark is needed. ``sample`` gives a sample's name from the column ``path`` (default: the file's name). The checkpoint makes a batch that is run again overwrite its own folder.
    """
    parts = F.split("value", "\t")
    lines = spark.readStream.schema("value string").text(source).select(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_path").alias("path"), "value")
    name = F.regexp_replace("f", r"(ReadsPerGene.*|\..*)$", "") if sample is None else sample
    counts = lines.select(name.alias("sample"), F.get(parts, F.lit(0)).alias("gene"), F.get(parts, F.lit(1)).try_cast("long").alias("count")).where(~F.col("gene").startswith("N_"))

    def append(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{target}/counts/batch={epoch}")
        marker_expression(batch, panel, "sample", "gene", "count", "ord").write.mode("overwrite").parquet(f"{target}/markers/batch={epoch}")
        batch.unpersist()

    counts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
