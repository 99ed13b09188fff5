"""Joins: keys, exact annotation, panels, identifier maps, canonical order, call matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.scalar import strip_version
from cohortlens.operators.aggregate import first_per_key


def join_on_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join on the key columns."""
    return left.join(right, list(keys))


def drop_listed(rows: DataFrame, listed: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed; no list, or an empty one, drops nothing."""
    return rows if listed is None else rows.join(listed.select(*keys).distinct(), list(keys), "left_anti")


def annotate_exact(rows: DataFrame, sites: DataFrame, keys: Sequence[str], fields: Sequence[str], prefix: str) -> DataFrame:
    """Copies fields of the site with the same key, prefixed; null without one."""
    return rows.join(sites.select(*keys, *[F.col(f).alias(f"{prefix}{f}") for f in fields]), list(keys), "left")


def _first_rows(table: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row a key: the first by ``order``, or as the table is read where none is given."""
    if order is not None:
        return first_per_key(table, [key], order)
    return first_per_key(table.withColumn("__row_order", F.monotonically_increasing_id()), [key], "__row_order").drop("__row_order")


def annotate_by_symbol(rows: DataFrame, tables: Mapping[str, DataFrame], symbol: str, order: str | None = None) -> DataFrame:
    """Left joins of per-symbol tables with their columns prefixed by the table's name, and ``in_<name>`` flags.

    A symbol that a table repeats counts with its first row, by ``order`` or as the table is read; rows never multiply.
    """
    for name, table in tables.items():
        table = _first_rows(table, symbol, order)
        fields = [c for c in table.columns if c != symbol]
        side = table.select(symbol, *[F.col(c).alias(f"{name}_{c}") for c in fields], F.lit(True).alias(f"in_{name}"))
        rows = rows.join(side, symbol, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return rows


def join_constraint(rows: DataFrame, constraint: DataFrame, symbol: str, fields: Sequence[str]) -> DataFrame:
    """Left join of one preferred row per symbol."""
    return rows.join(constraint.select(symbol, *fields), symbol, "left")


def full_outer_annotations(first: DataFrame, concatenated: DataFrame, key: str) -> DataFrame:
    """First-row columns and concatenated columns side by side."""
    return first.join(concatenated, key, "full_outer")


def map_ids(rows: DataFrame, dictionary: DataFrame, id_col: str, symbol_col: str, order: str, keep_unmapped: bool = True) -> DataFrame:
    """Symbol of each versionless id, the first mapping by ``order``; unmapped rows stay under their id or go."""
    first = first_per_key(dictionary.withColumn("__id", strip_version(id_col)), ["__id"], order).select("__id", F.col(symbol_col).alias("__symbol"))
    out = rows.withColumn("__id", strip_version(id_col)).join(first, "__id", "left" if keep_unmapped else "inner")
    return out.withColumn(symbol_col, F.coalesce("__symbol", id_col) if keep_unmapped else F.col("__symbol")).drop("__id", "__symbol")


def align_to_order(counts: DataFrame, reference: DataFrame, id_col: str, value: str, order: str, first: str | None = None) -> DataFrame:
    """Every reference id in its order with its value, 0 where absent; ids outside the reference go.

    Ids are compared without their versions. Of rows with equal ids the first counts: by the column ``first`` of the
    counts, or as they are read where none is given.
    """
    own = _first_rows(counts.withColumn("__id", strip_version(id_col)), "__id", first).select("__id", F.col(value).alias("__value"))
    side = reference.withColumn("__id", strip_version(id_col)).join(own, "__id", "left")
    return side.select(F.col(order), F.col(id_col), F.coalesce("__value", F.lit(0)).alias(value))


def overlap_counts(left: DataFrame, right: DataFrame, key: str, warn_below: float = 0.5) -> DataFrame:
    """One row: ids in both, only left, only right, and whether fewer than ``warn_below`` of the right are covered."""
    a, b = left.select(key).distinct().withColumn("__l", F.lit(1)), right.select(key).distinct().withColumn("__r", F.lit(1))
    n = a.join(b, key, "full_outer").agg(F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("both"), F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"))
    return n.withColumn("low", F.col("both") < warn_below * (F.col("both") + F.col("only_right")))


def lookup_default(rows: DataFrame, mapping: DataFrame, key: str, value: str, default: str = "unknown", order: str | None = None) -> DataFrame:
    """Value of the mapping, or the default. A repeated key counts with its first row, by ``order`` or as it is read."""
    return rows.join(_first_rows(mapping, key, order).select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def shared_keys(a: DataFrame, b: DataFrame, key: str, least: int = 200) -> DataFrame:
    """Distinct keys in both; raises if there are fewer than ``least``."""
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    if (n := both.count()) < least:
        raise ValueError(f"{n} shared keys, {least} needed")
    return both


def evidence_pairs(candidates: DataFrame, sets: DataFrame, leading: DataFrame, gene: str, set_col: str) -> DataFrame:
    """Candidate x set pairs: ``leading_edge`` where the gene leads the set, else ``pathway`` where it is a member."""
    lead = candidates.join(leading, gene).select(gene, set_col).distinct()
    member = candidates.join(sets, gene).select(gene, set_col).distinct().join(lead, [gene, set_col], "left_anti")
    return lead.withColumn("evidence", F.lit("leading_edge")).unionByName(member.withColumn("evidence", F.lit("pathway")))


def cohort_matrix(calls: DataFrame, samples: DataFrame, site: Sequence[str], sample: str, value: str, missing) -> DataFrame:
    """All sites x all samples; cells without a call get ``missing``. The samples are a cohort's, few beside sites."""
    names = samples.agg(F.array_sort(F.collect_set(sample)).alias("__all"))
    grid = calls.select(*site).distinct().join(names, how="cross").select(*site, F.explode("__all").alias(sample))
    return grid.join(calls, [*site, sample], "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def prefix_contigs(rows: DataFrame, contig: str, pos: str, prefix: str = "chr") -> DataFrame:
    """Rows with a numeric position, the contig's name prefixed, sorted by contig and position over range partitions."""
    kept = rows.withColumn(pos, F.col(pos).try_cast("int")).where(F.col(pos).isNotNull()).withColumn(contig, F.concat(F.lit(prefix), contig))
    return kept.repartitionByRange(contig, pos).sortWithinPartitions(contig, pos)


def project_info(tables: Sequence[DataFrame], info: str, keep: Sequence[str]) -> DataFrame:
    """The tables one below the other, in their order by ``contig_order``, with only the named keys of the info map."""
    parts = [t.withColumn(info, F.map_filter(info, lambda k, _: k.isin(*keep))).withColumn("contig_order", F.lit(i)) for i, t in enumerate(tables)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
