"""Strict mappings, labels, rule tables, provenance and expectations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DROP = "DROP"


def strict_map(rows: DataFrame, col: str, mapping: Mapping[str, str], name: str) -> DataFrame:
    """Adds the mapped label; rows mapped to DROP go; raises with the labels that have no mapping.

    A mapping is a short hand-written table; it is one literal map.
    """
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    label = F.try_element_at(table, F.col(col))
    unknown = [r[0] for r in rows.where(label.isNull()).select(col).distinct().limit(20).collect()]
    if unknown:
        raise ValueError(f"unmapped values of {col}: {sorted(map(str, unknown))}")
    return rows.withColumn(name, label).where(F.col(name) != DROP)


def hierarchical_label(rows: DataFrame, col: str, rules: Mapping[str, str], fine: str, name: str, default: str | None = None) -> DataFrame:
    """COARSE:<label> gives that label, FINE the fine column, DROP removes; raises for a value without a rule."""
    t = strict_map(rows.withColumn("__k", F.coalesce(col, F.lit(default))), "__k", rules, "__rule")
    label = F.when(F.col("__rule") == "FINE", F.col(fine)).otherwise(F.regexp_replace("__rule", "^COARSE:", ""))
    return t.withColumn(name, label).drop("__k", "__rule")


def labelled(rows: DataFrame, name: str, label_fn: Callable[[DataFrame], Column]) -> DataFrame:
    """Adds the label that a caller's function gives as a Column; null labels go."""
    return rows.withColumn(name, label_fn(rows)).where(F.col(name).isNotNull())


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Threshold rules as data: (rule, metric, op, limit)."""
    return spark.createDataFrame([(a, b, c, float(x)) for a, b, c, x in rules], "rule string, metric string, op string, limit double")


def apply_rules(metrics: DataFrame, rules: DataFrame, key: str, metric: str, value: str) -> DataFrame:
    """(key, rule, fired) for every metric with a rule; a null value fires nothing. Rules are a short table and broadcast."""
    t = metrics.join(F.broadcast(rules), metrics[metric] == rules["metric"])
    x = F.col(value)
    test = F.when(F.col("op") == "<", x < F.col("limit")).when(F.col("op") == "<=", x <= F.col("limit")).when(F.col("op") == ">", x > F.col("limit")).otherwise(x >= F.col("limit"))
    return t.select(key, "rule", F.coalesce(test, F.lit(False)).alias("fired"))


def provenance(rows: DataFrame, cls: str, **facts) -> DataFrame:
    """One JSON row: counts per class (a label column, so few) and the facts given."""
    counts = rows.groupBy(cls).agg(F.count("*").alias("n"))
    made = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(cls).cast("string"), "n")))).alias("classes"), F.sum("n").alias("rows"))
    return made.select(F.to_json(F.struct("classes", "rows", *[F.lit(v).alias(k) for k, v in facts.items()])).alias("provenance"))


def expectations(rows: DataFrame, rules: Mapping[str, Column], warn: Sequence[str] = ()) -> dict[str, int]:
    """Rows that break each rule, in one aggregation; raises if a rule outside ``warn`` is broken. A null test is broken."""
    broken = rows.agg(*[F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()]).first().asDict()
    if bad := {k: v for k, v in broken.items() if v and k not in warn}:
        raise ValueError(f"broken expectations: {bad}")
    return broken
