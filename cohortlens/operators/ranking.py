"""Windows and ranking: replicates, adjusted p values, bins, strata, donor specificity, tops."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.runtime import Scratch, shuffle_partitions


def best_per_symbol(rows: DataFrame, keys: Sequence[str], z: str, tie: str) -> DataFrame:
    """The row with the largest absolute value per key, the smallest ``tie`` among equals; null values go."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.where(F.col(z).isNotNull()).groupBy(*keys).agg(F.min(F.struct((-F.abs(z)).alias("__o"), F.col(tie).alias("__t"), *rest)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def rank_desc(rows: DataFrame, entity: str, value: str, tie: str) -> DataFrame:
    """Adds ``rank`` from 1 by descending value within each entity."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(entity).orderBy(F.col(value).desc(), tie)))


def rank_over_all(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row over the whole table, from 1; rows that ``order`` does not tell apart are in any order.

    Rows are dealt to ranges of the order and sorted there; a row's number in its range and the sizes of the ranges
    before it, one row a range, make its place, so no task sees all rows.
    """
    scratch = Scratch(rows.sparkSession, "places")
    fixed = scratch.keep(rows, "rows", tidy=False)  # the ranges are sampled from what is then dealt
    dealt = fixed.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = scratch.keep(dealt.withColumn("__at", F.monotonically_increasing_id()), "order", tidy=False)  # range in the high bits, number in the low 33
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(sizes), part == F.col("__part")).withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(2**33 - 1) + 1).drop("__at", "__part", "__before")


def combine_replicates(rows: DataFrame, keys: Sequence[str], value: str, mode: str = "signed_min_abs", tie: str | None = None) -> DataFrame:
    """One value per key: the median, or the value of smallest magnitude, damped by 1 - min/max where signs differ."""
    if mode == "median":
        return rows.groupBy(*keys).agg(F.median(value).alias(value))
    x = F.col(value)
    t = rows.where(x.isNotNull()).groupBy(*keys).agg(
        F.min(F.struct(F.abs(x).alias("a"), x.alias("x"))).alias("__least"), F.max(F.abs(x)).alias("__most"),
        (F.count_if(x > 0) > 0).alias("__up"), (F.count_if(x < 0) > 0).alias("__down"))
    damped = F.col("__least.x") * (1 - F.try_divide(F.col("__least.a"), F.col("__most")))
    return t.select(*keys, F.when(F.col("__up") & F.col("__down"), damped).otherwise(F.col("__least.x")).alias(value))


def bh_adjust(rows: DataFrame, p: str, by: Sequence[str] = (), name: str = "padj") -> DataFrame:
    """Benjamini-Hochberg within each group; null p values get null and do not count.

    With no group the whole table is one; its p values are counted once per distinct value in parallel, and only the
    distinct values are ordered, by range partitions whose running minima are carried from the largest down.
    """
    counts = rows.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__k"))
    if by:
        w = Window.partitionBy(*by)
        rank = F.sum("__k").over(w.orderBy(p))
        raw = counts.withColumn("__raw", F.col(p) * F.sum("__k").over(w) / rank)
        done = raw.withColumn(name, F.least(F.lit(1.0), F.min("__raw").over(w.orderBy(F.col(p).desc()))))
        return rows.join(done.select(*by, p, name), [*by, p], "left")
    spark = rows.sparkSession
    scratch = Scratch(spark, "bh")
    part = scratch.keep(counts.repartitionByRange(p).withColumn("__part", F.spark_partition_id()), "counts")
    per = part.groupBy("__part").agg(F.sum("__k").alias("__n"))  # one row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__all"))
    within = Window.partitionBy("__part")
    raw = part.join(F.broadcast(per), "__part").withColumn("__raw", F.col(p) * F.col("__all") / (F.col("__before") + F.sum("__k").over(within.orderBy(p))))
    raw = scratch.keep(raw.withColumn("__min", F.min("__raw").over(within.orderBy(F.col(p).desc()))), "raw")
    after = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    carried = raw.groupBy("__part").agg(F.min("__min").alias("__m")).select("__part", F.min("__m").over(after).alias("__carry"))
    done = raw.join(F.broadcast(carried), "__part").select(p, F.least(F.lit(1.0), "__min", "__carry").alias(name))
    return rows.join(done, p, "left")


def seeded_order(seed: int, *cols: str) -> Column:
    """A reproducible random order: md5 of the seed and the columns, joined by ``|``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def equal_frequency_bins(rows: DataFrame, key: str, value: str, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``bin`` 1..n of equal size, ties broken by a seeded hash, and ``percentile`` by average ranks.

    With no group the rows are placed by ranges over the whole table; groups are gene-sized windows of their own.
    """
    if by:
        w = Window.partitionBy(*by)
        place = F.row_number().over(w.orderBy(value, seeded_order(seed, key), key)) - 1
        total = F.count("*").over(w)
        average = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2
        return rows.withColumn("bin", (F.floor(place * n / total) + 1).cast("int")).withColumn("percentile", average / total)
    names = [c for c in rows.columns if c not in ("bin", "percentile")]
    placed = rank_over_all(rows.select(*names), [F.col(value), seeded_order(seed, key), F.col(key)], "__place")
    ties = placed.groupBy(F.col(value).alias("__v")).agg(F.min("__place").alias("__low"), F.count("*").alias("__k"))
    total = placed.count()
    both = placed.join(ties, F.col(value).eqNullSafe(F.col("__v")))
    average = F.col("__low") + (F.col("__k") - 1) / 2
    return both.select(*names, (F.floor((F.col("__place") - 1) * n / total) + 1).cast("int").alias("bin"), (average / total).alias("percentile"))


def order_statistics(rows: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Exact type-7 quantiles of a column over the whole table, as numbers; null and NaN do not count.

    Equal values are counted first, then the distinct ones are dealt to ranges. The sizes of the ranges, one number
    each, tell in which of them the wanted places lie, and only those are ordered, each on its own.
    """
    x = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    scratch = Scratch(rows.sparkSession, "statistics")
    counts = scratch.keep(rows.select(x.alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n")), "counts", tidy=False)
    dealt = scratch.keep(counts.repartitionByRange(shuffle_partitions(rows.sparkSession), "x").withColumn("part", F.spark_partition_id()), "ranges", tidy=False)
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a range
    total = sum(n for _, n in sizes)
    if not total:
        return [None] * len(shares)
    at = [(total - 1) * q for q in shares]
    wanted = sorted({int(k) for h in at for k in (h, min(h + 1, total - 1))})  # places from 0
    inside, below = {}, 0
    for part, n in sizes:
        for k in wanted:
            if below <= k < below + n:
                inside.setdefault(part, []).append((k, k - below))
        below += n
    pairs = rows.sparkSession.createDataFrame([(p, k, place) for p, found in inside.items() for k, place in found], "part int, k long, place long")
    some = dealt.where(F.col("part").isin(*inside)).withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("x")))
    found = some.join(F.broadcast(pairs), "part").where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))  # two numbers a share
    of = {r["k"]: r["x"] for r in found.select("k", "x").collect()}
    return [of[int(h)] + (h - int(h)) * (of[min(int(h) + 1, total - 1)] - of[int(h)]) for h in at]


def running_totals(rows: DataFrame, by: Sequence[str], order: str, value: str, name: str, total: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group down to this one, and over the whole group.

    Rows must differ in group and order. They are dealt to ranges of both; sums of a group's earlier ranges are
    carried, from one row a range and group, so no group is one task.
    """
    scratch = Scratch(rows.sparkSession, "totals")
    fixed = scratch.keep(rows, "rows", tidy=False)
    dealt = scratch.keep(fixed.repartitionByRange(shuffle_partitions(rows.sparkSession), *by, order).withColumn("__part", F.spark_partition_id()), "ranges", tidy=False)
    sums = dealt.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__sum").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__part").alias("__of"), before.alias("__before"), F.sum("__sum").over(group).alias(total))
    own = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(order))
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by] + [F.col("__part") == F.col("__of")]
    return dealt.withColumn(name, own).join(sums, on).withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name, total)


def quantile_breaks(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """One row with ``breaks``: type-7 quantiles at equal shares, repeated ones removed."""
    found = order_statistics(rows, F.col(value), [k / bins for k in range(bins + 1)])
    return rows.sparkSession.createDataFrame([(list(dict.fromkeys(x for x in found if x is not None)),)], "breaks array<double>")


def quantile_strata(rows: DataFrame, breaks: DataFrame, value: str) -> DataFrame:
    """Adds ``stratum``: the interval (low, high] of the breaks, the first closed; values outside go to the end bins."""
    out = rows.join(F.broadcast(breaks), how="cross")
    below = F.size(F.filter(F.slice("breaks", 2, F.greatest(F.size("breaks") - 2, F.lit(0))), lambda b: b < F.col(value)))
    return out.withColumn("stratum", below + 1).drop("breaks")


def donor_specificity(rows: DataFrame, pathway: str, donor: str, score: str, index) -> DataFrame:
    """Per pathway, for the index donor: oriented score, gap to the most extreme other, z in SDs of others, rank, n as extreme."""
    own = rows.where(F.col(donor) == index).select(pathway, F.col(score).alias("own"), F.when(F.col(score) < 0, -1).otherwise(1).alias("sign"))
    t = rows.join(own, pathway).where(F.col(donor) != index).withColumn("x", F.col(score) * F.col("sign")).withColumn("own", F.col("own") * F.col("sign"))
    out = t.groupBy(pathway).agg(F.first("own").alias("own"), F.max("x").alias("top"), F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.count_if(F.col("x") >= F.col("own")).alias("n_as_extreme"))
    return out.select(pathway, "own", (F.col("own") - F.col("top")).alias("gap"), F.when(F.col("sd") > 0, (F.col("own") - F.col("m")) / F.col("sd")).alias("z"), (F.col("n_as_extreme") + 1).alias("rank"), "n_as_extreme")


def specificity_counts(rows: DataFrame, pathway: str, donor: str, padj: str, score: str, index, most: float = 0.05) -> DataFrame:
    """Per pathway: other donors with padj at or below the limit, at or below the index's, and the signed gap of scores."""
    own = rows.where(F.col(donor) == index).select(pathway, F.col(padj).alias("own_p"), F.col(score).alias("own"))
    t = rows.where(F.col(donor) != index).join(own, pathway)
    sign = F.when(F.col("own") < 0, -1).otherwise(1)
    return t.groupBy(pathway).agg(F.count_if(F.col(padj) <= most).alias("n_significant"), F.count_if(F.col(padj) <= F.col("own_p")).alias("n_better"), F.min((F.col("own") - F.col(score)) * sign).alias("gap"))


def group_order(rows: DataFrame, group: str, value: str, first: Sequence[str] = ()) -> DataFrame:
    """(group, place): the groups in ``first`` in that order, then the others by their best value, then by name."""
    best = rows.groupBy(group).agg(F.max(value).alias("__best"))
    listed = F.array_position(F.array(*map(F.lit, first)), F.col(group)) if first else F.lit(0).cast("long")
    rank = F.row_number().over(Window.orderBy(F.when(listed > 0, listed).otherwise(len(first) + 1), F.col("__best").desc(), group))  # one row a group
    return best.select(group, rank.alias("place"))


def top_n_per_group(rows: DataFrame, group: str, value: str, tie: str, n: DataFrame | int | Sequence[int], first: Sequence[str] = ()) -> DataFrame:
    """The best n rows of each group, with their ``place``.

    n is a number, a table (group, n), or a list that goes to the groups by their order (:func:`group_order`); groups
    without one are dropped.
    """
    if isinstance(n, int):
        rows = rows.withColumn("n", F.lit(n))
    else:
        if not isinstance(n, DataFrame):
            n = group_order(rows, group, value, first).select(group, F.get(F.array(*map(F.lit, n)), F.col("place") - 1).alias("n")).where("n is not null")
        rows = rows.join(n.select(group, "n"), group)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(value).desc(), tie))
    return rows.withColumn("place", place).where("place <= n").drop("n")


def top_up_down(rows: DataFrame, group: str, es: str, padj: str, tie: str, k: int) -> DataFrame:
    """Per group the k smallest padj with positive and with negative score; ``place`` runs up, then down reversed."""
    w = Window.partitionBy(group).orderBy(F.col(padj).asc_nulls_last(), tie)
    up = rows.where(F.col(es) > 0).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("direction", F.lit("up"))
    down = rows.where(F.col(es) < 0).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return up.unionByName(down.withColumn("place", -F.col("place")).withColumn("direction", F.lit("down")))


def top_with_candidate(rows: DataFrame, group: str, es: str, padj: str, tie: str, leading: str, candidates: Sequence, k: int = 12, most: float = 0.05) -> DataFrame:
    """The same over the sets that are significant and have a candidate in their leading edge."""
    hit = F.arrays_overlap(F.col(leading), F.array(*map(F.lit, candidates)))
    return top_up_down(rows.where((F.col(padj) < most) & hit), group, es, padj, tie, k)


def duplicate_columns(rows: DataFrame, donor: str, key: str, value: str, within: float = 1e-10) -> DataFrame:
    """Pairs of donors whose values agree on all keys. Donors are a cohort's, so the pairs of one key are few."""
    a = rows.select(F.col(donor).alias("donor_a"), key, F.col(value).alias("__a"))
    b = rows.select(F.col(donor).alias("donor_b"), key, F.col(value).alias("__b"))
    total = rows.groupBy(donor).agg(F.count("*").alias("__n"))
    t = a.join(b, key).where("donor_a < donor_b").groupBy("donor_a", "donor_b").agg(F.max(F.abs(F.col("__a") - F.col("__b"))).alias("__d"), F.count("*").alias("__k"))
    both = t.join(total.select(F.col(donor).alias("donor_a"), F.col("__n").alias("__x")), "donor_a").join(total.select(F.col(donor).alias("donor_b"), F.col("__n").alias("__y")), "donor_b")
    return both.where((F.col("__d") <= within) & (F.col("__k") == F.col("__x")) & (F.col("__k") == F.col("__y"))).select("donor_a", "donor_b")


def tick_table(ranked: DataFrame, sets: DataFrame, gene: str, stat: str, rank: str, power: float, leading: Column, highlight: Column) -> DataFrame:
    """Per set member: signed power of the statistic, rank, and category highlight, leading or regular."""
    x = F.col(stat)
    out = sets.join(ranked, gene).withColumn("value", F.signum(x) * F.pow(F.abs(x), F.lit(power)))
    return out.withColumn("category", F.when(highlight, "highlight").when(leading, "leading").otherwise("regular"))


def goi_listing(ticks: DataFrame, set_col: str, gene: str, rank: str, leading: Column, most: int = 8) -> DataFrame:
    """Genes of interest per set by rank, ``*`` behind leading ones, ``...`` after the first ``most``."""
    item = F.struct(F.col(rank).alias("r"), F.concat(F.col(gene).cast("string"), F.when(leading, "*").otherwise("")).alias("g"))
    t = ticks.groupBy(set_col).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["g"]).alias("g"))
    return t.select(set_col, F.concat(F.array_join(F.slice("g", 1, most), ", "), F.when(F.size("g") > most, ", ...").otherwise("")).alias("genes"))


def stratified_cap(rows: DataFrame, group: str, key: str, cap: int, seed: int, floor: int = 0) -> DataFrame:
    """At most ``cap`` rows of each group, in the seeded order. A sampling operator. Warns of groups with fewer rows than ``floor``."""
    if floor:
        few = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < floor)
        if names := sorted(f"{r[group]} ({r['n']})" for r in few.collect()):  # at most a row a group
            warnings.warn(f"groups with fewer than {floor} rows: {', '.join(names)}", stacklevel=2)
    w = Window.partitionBy(group).orderBy(seeded_order(seed, key), key)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")
