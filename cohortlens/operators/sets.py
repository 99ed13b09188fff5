"""Set operators: panels, similarity of set collections, leave-one-out collections, hubness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.graph import connected_components


def merge_filtered(a: DataFrame, b: DataFrame, status: str, *order: str) -> DataFrame:
    """Rows of both that passed, range-sorted."""
    return a.unionByName(b).where(F.col(status) == "PASS").repartitionByRange(*order).sortWithinPartitions(*order)


def invert_sets(sets: DataFrame, universe: DataFrame, set_col: str, gene: str) -> DataFrame:
    """gene x set pairs, restricted to the universe's genes."""
    return sets.select(gene, set_col).distinct().join(universe.select(gene).distinct(), gene, "left_semi")


def set_panels(*panels: DataFrame, symbol: str) -> DataFrame:
    """Distinct symbols of all panels."""
    return reduce(DataFrame.unionByName, [p.select(symbol) for p in panels]).distinct()


def set_similarity(sets: DataFrame, set_col: str, gene: str, kind: str = "jaccard", cutoff: float = 0.3) -> DataFrame:
    """(set_a, set_b, common, similarity) of pairs with a common gene and at least the cutoff.

    A collection has thousands of sets; the pairs of one gene are bounded by the sets that hold it.
    """
    rows = sets.select(F.col(set_col).alias("set"), F.col(gene).alias("__g")).distinct()
    size = rows.groupBy("set").agg(F.count("*").alias("__n"))
    a = rows.select(F.col("set").alias("set_a"), "__g")
    b = rows.select(F.col("set").alias("set_b"), "__g")
    t = a.join(b, "__g").where("set_a < set_b").groupBy("set_a", "set_b").agg(F.count("*").alias("common"))
    t = t.join(size.select(F.col("set").alias("set_a"), F.col("__n").alias("__a")), "set_a").join(size.select(F.col("set").alias("set_b"), F.col("__n").alias("__b")), "set_b")
    under = F.col("__a") + F.col("__b") - F.col("common") if kind == "jaccard" else F.least("__a", "__b")
    return t.select("set_a", "set_b", "common", (F.col("common") / under).alias("similarity")).where(F.col("similarity") >= cutoff)


def remove_member(sets: DataFrame, candidates: DataFrame, gene: str) -> DataFrame:
    """The collection once for each candidate, without its gene; candidates are a short list and are broadcast as one array."""
    names = candidates.select(gene).distinct().agg(F.array_sort(F.collect_set(gene)).alias("__all"))
    return sets.join(F.broadcast(names), how="cross").withColumn("left_out", F.explode("__all")).drop("__all").where(F.col("left_out") != F.col(gene))


def sizes_without(sets: DataFrame, candidates: DataFrame, set_col: str, gene: str) -> DataFrame:
    """(set, left_out, n): how many genes each set of :func:`remove_member` keeps; a set left empty has no row.

    A set loses one gene to a candidate that it holds and none to others, so its genes are counted once, and the
    candidates are taken off that count: the collection is not copied. Rows of the result are all sets by all candidates.
    """
    names = candidates.select(F.col(gene).alias("left_out")).where("left_out is not null").distinct()
    held = sets.where(F.col(gene).isNotNull()).join(F.broadcast(names), F.col(gene) == F.col("left_out"), "left")
    held = held.groupBy(set_col).agg(F.count("*").alias("__n"), F.collect_list("left_out").alias("__held"))
    out = held.join(F.broadcast(names.agg(F.array_sort(F.collect_list("left_out")).alias("__all"))), how="cross")
    out = out.withColumn("left_out", F.explode("__all"))
    lost = F.when(F.size("__held") == 0, 0).otherwise(F.size(F.filter("__held", lambda x: x == F.col("left_out"))))
    return out.select(set_col, "left_out", (F.col("__n") - lost).alias("n")).where("n > 0")


def hubness(signatures: DataFrame, universe: DataFrame, set_col: str, gene: str, collapse: float = 0.5) -> DataFrame:
    """Per gene of the universe: its signatures, and the similarity components among them; zeros where none."""
    similar = set_similarity(signatures, set_col, gene, "jaccard", collapse)
    groups = connected_components(similar, "set_a", "set_b").select(F.col("node").alias(set_col), F.col("component").alias("__c"))
    t = signatures.select(set_col, gene).distinct().join(groups, set_col, "left").withColumn("__c", F.coalesce("__c", set_col))
    n = t.groupBy(gene).agg(F.count("*").alias("n_signatures"), F.count_distinct("__c").alias("n_components"))
    return universe.select(gene).distinct().join(n, gene, "left").na.fill(0, ["n_signatures", "n_components"])
