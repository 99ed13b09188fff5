"""Aggregations: panels, allele counts, count matrices, expression, contamination and quality summaries."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from cohortlens.operators.ranking import order_statistics


def first_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; ties go by all other columns."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("__o"), *rest)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def preferred_per_key(rows: DataFrame, key: str, flags: Sequence[str], order: str) -> DataFrame:
    """Rows of the first flag that any row of the table has (all rows if none), then the first per key."""
    seen = rows.agg(*[F.max(F.coalesce(f, F.lit(False))).alias(f) for f in flags]).first()
    flag = next((f for f in flags if seen[f]), None)
    return first_per_key(rows.where(F.col(flag)) if flag else rows, [key], order)


def concat_unique(rows: DataFrame, key: str, cols: Sequence[str], order: str, sep: str = "; ") -> DataFrame:
    """Distinct non-empty values of each column per key, in order of first appearance, joined."""

    def joined(c: str) -> Column:
        kept = F.when(F.trim(F.col(c)) != "", F.struct(F.col(order).alias("o"), F.trim(F.col(c).cast("string")).alias("v")))
        return F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["v"])), sep).alias(c)

    return rows.groupBy(key).agg(*map(joined, cols))


def gene_set(rows: DataFrame, symbol: str, *tests: Column) -> DataFrame:
    """Distinct trimmed non-empty symbols of the rows that pass all tests."""
    for test in tests:
        rows = rows.where(test)
    return rows.select(F.trim(symbol).alias(symbol)).where(F.col(symbol) != "").distinct()


def constrained_set(rows: DataFrame | None, symbol: str, loeuf: str, most: float = 0.6, panel: DataFrame | None = None) -> DataFrame:
    """Symbols with any row below the limit; without a constraint table, or with an empty one, those of the panel."""
    if panel is not None and (rows is None or rows.isEmpty()):
        return gene_set(panel, symbol)
    if rows is None:
        raise ValueError("neither a constraint table nor a panel is given")
    return gene_set(rows, symbol, F.col(loeuf).try_cast("double") < most)


def allele_counts(calls: DataFrame, samples: DataFrame, site: str, sample: str, dosage: str) -> DataFrame:
    """AC and AN per site over the listed samples."""
    kept = calls.join(samples.select(sample).distinct(), sample, "left_semi").where(F.col(dosage).isNotNull())
    return kept.groupBy(site).agg(F.sum(dosage).cast("long").alias("ac"), (2 * F.count("*")).alias("an"))


def recurrent_artifacts(counts: DataFrame, freq: DataFrame, site: str, af: str, ac_min: int = 2, af_max: float = 0.001) -> DataFrame:
    """Sites with at least ``ac_min`` alleles that are absent or rare in the reference frequencies."""
    return counts.where(F.col("ac") >= ac_min).join(freq.select(site, af), site, "left").where(F.col(af).isNull() | (F.col(af) < af_max)).select(site, "ac", "an")


def tier_counts(rows: DataFrame, tier: str, site: str) -> DataFrame:
    """Rows and distinct sites of each tier."""
    return rows.groupBy(tier).agg(F.count("*").alias("n"), F.count_distinct(site).alias("n_sites"))


class StageCounts:
    """Row counts of the stages of a job, taken while it runs (one pass, no extra job)."""

    def __init__(self) -> None:
        self.stages: dict[str, Observation] = {}

    def seen(self, rows: DataFrame, stage: str) -> DataFrame:
        """The same rows, counted as they pass."""
        self.stages[stage] = Observation()
        return rows.observe(self.stages[stage], F.count("*").alias("n"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, n) after the job has run; one row a stage."""
        return spark.createDataFrame([(stage, int(o.get["n"])) for stage, o in self.stages.items()], "stage string, n long")


def sum_duplicates(counts: DataFrame, sample: str, symbol: str, count: str) -> DataFrame:
    """Counts per sample and symbol; rows without a symbol go before any library size."""
    return counts.where(F.col(symbol).isNotNull()).groupBy(sample, symbol).agg(F.sum(count).alias(count))


def cpm(counts: DataFrame, sample: str, count: str, empty_library: float | None = 1.0) -> DataFrame:
    """Adds ``cpm`` and ``log2cpm``; a library of 0 counts as ``empty_library``, or gives null if that is None."""
    library = counts.groupBy(sample).agg(F.sum(count).alias("__lib"))
    size = F.when(F.col("__lib") > 0, F.col("__lib").cast("double")).otherwise(F.lit(empty_library).cast("double"))
    out = counts.join(library, sample).withColumn("cpm", F.col(count) * 1e6 / size)
    return out.withColumn("log2cpm", F.log2(F.col("cpm") + 1)).drop("__lib")


def pseudobulk(cells: DataFrame, gene: str, subject: str, cls: str, count: str, least_subjects: int = 2) -> DataFrame:
    """Sum per gene, subject and class, with CPM within subject and class.

    Warns of classes with fewer than ``least_subjects`` subjects; 0 asks for no such job.
    """
    if least_subjects:
        few = cells.groupBy(cls).agg(F.count_distinct(subject).alias("n")).where(F.col("n") < least_subjects)
        if names := sorted(str(r[cls]) for r in few.collect()):  # at most a row a class
            warnings.warn(f"classes with fewer than {least_subjects} subjects: {', '.join(names)}", stacklevel=2)
    summed = cells.groupBy(gene, subject, cls).agg(F.sum(count).alias(count))
    library = summed.groupBy(subject, cls).agg(F.sum(count).alias("__lib"))
    return summed.join(library, [subject, cls]).withColumn("cpm", F.try_divide(F.col(count) * 1e6, F.col("__lib"))).drop("__lib")


def specificity(expression: DataFrame, gene: str, cls: str, value: str, classes: Sequence[str]) -> DataFrame:
    """Two classes: ``log2_ratio`` (first over second in alphabetical order) and ``higher_in`` (the first if equal); more: ``tau`` and ``dominant``.

    A class without a row counts as 0; a gene that no class expresses has null tau.
    """
    classes = sorted(classes)
    wide = expression.groupBy(gene).pivot(cls, classes).agg(F.sum(value)).na.fill(0.0, classes)
    x = [F.col(f"`{c}`").cast("double") for c in classes]
    if len(classes) == 2:
        ratio = F.log2((x[0] + 1) / (x[1] + 1))
        return wide.select(gene, ratio.alias("log2_ratio"), F.when(ratio >= 0, classes[0]).otherwise(classes[1]).alias("higher_in"))
    top = F.greatest(*x)
    total = sum(x[1:], x[0])
    dominant = F.coalesce(*[F.when(v == top, F.lit(c)) for v, c in zip(x, classes)])
    return wide.select(gene, F.when(top > 0, (len(classes) - total / top) / (len(classes) - 1)).alias("tau"), F.when(top > 0, dominant).alias("dominant"))


def group_expression(cells: DataFrame, counts: DataFrame, cell: str, group: Sequence[str], count: str, min_cells: int = 1) -> DataFrame:
    """n, mean, percent above 0 and number above 0 per group; cells without a count are zeros."""
    value = F.coalesce(count, F.lit(0))
    joined = cells.join(counts.select(cell, count), cell, "left")
    out = joined.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.count_if(value > 0).alias("n_pos"))
    return out.where(F.col("n") >= min_cells).withColumn("pct_pos", 100.0 * F.col("n_pos") / F.col("n"))


def attribute_alignments(hits: DataFrame, sample: str, primary: str, alternates: str, sep: str = ";") -> DataFrame:
    """Count per sample and contig: 1 for the primary, 1 for each alternate entry on another contig than the primary."""
    others = F.filter(F.split(F.coalesce(alternates, F.lit("")), sep), lambda a: (a != "") & (a != F.col(primary)))
    every = F.concat(F.array(F.col(primary)), others)
    return hits.select(sample, F.explode(every).alias("contig")).groupBy(sample, "contig").agg(F.count("*").alias("n"))


def wide_summary(counts: DataFrame, samples: DataFrame, sample: str, key: str, value: str, order: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """One row per sample and one column per key: those in the catalogue's order, then others sorted, then ``unknown``
    if any of its values is above 0; a sample without rows stays, with nulls."""
    found = counts.groupBy(key).agg(F.max(value).alias("most")).where(F.col(key).isNotNull()).collect()  # a catalogue's keys
    extras = sorted({r[key] for r in found} - {*order, unknown})
    columns = [*order, *extras, *[r[key] for r in found if r[key] == unknown and (r["most"] or 0) > 0]]
    wide = counts.groupBy(sample).pivot(key, columns).agg(F.sum(value))
    return samples.select(sample).distinct().join(wide, sample, "left").select(sample, *[F.col(f"`{c}`") for c in columns])


def fractions(counts: DataFrame, totals: DataFrame, sample: str, value: str, total: str, places: int = 6) -> DataFrame:
    """Adds ``fraction``, rounded; null where the total is missing or 0 or less."""
    return counts.join(totals.select(sample, total), sample, "left").withColumn("fraction", F.when(F.col(total) > 0, F.round(F.col(value) / F.col(total), places)))


def uniformity(coverage: DataFrame, keys: Sequence[str], reads: str, covered: str, length: str, read_len: int = 150) -> DataFrame:
    """Covered bases over those expected of random reads, per key; null if reads, length or expectation are 0 or less."""
    t = coverage.groupBy(*keys).agg(F.sum(reads).alias("n"), F.sum(covered).alias("c"), F.sum(length).alias("l"))
    expected = F.col("l") * (1 - F.exp(-F.col("n") * float(read_len) / F.col("l")))
    return t.select(*keys, F.when((F.col("n") > 0) & (F.col("l") > 0), F.try_divide(F.col("c"), expected)).alias("uniformity"))


def gene_callability(regions: DataFrame, gene: str, covered: str, length: str, least: float = 0.90, override: Mapping[str, bool] = {}) -> DataFrame:  # noqa: B006
    """Covered share per gene and whether it is callable; ``override`` sets genes by hand."""
    t = regions.groupBy(gene).agg(F.sum(covered).cast("double").alias("c"), F.sum(length).cast("double").alias("l"))
    share = F.try_divide(F.col("c"), F.col("l"))
    ok = F.coalesce(share >= least, F.lit(False))
    for name, says in override.items():
        ok = F.when(F.col(gene) == name, F.lit(says)).otherwise(ok)
    return t.select(gene, share.alias("fraction"), ok.alias("callable"))


def sex_from_depth(auto, x, y) -> Column:
    """XX, XY or ambiguous from depths of autosomes, X and Y; NA without autosomal depth."""
    auto, x, y = (F.col(c) if isinstance(c, str) else c for c in (auto, x, y))
    rx, ry = F.try_divide(x, auto), F.try_divide(y, auto)
    call = F.when((rx >= 0.80) & (ry < 0.15), "XX").when((rx < 0.65) & (ry >= 0.15), "XY").otherwise("ambiguous")
    return F.when(auto > 0, call).otherwise("NA")


def sex_from_markers(xist, y_panel, xist_min: float = 10.0, y_min: float = 20.0) -> Column:
    """XX, XY, ambiguous_possible_XXY or ambiguous_low_signal from marker CPM; low signal where one is missing."""
    xist, y_panel = (F.col(c) if isinstance(c, str) else c for c in (xist, y_panel))
    a, b = F.coalesce(xist >= xist_min, F.lit(False)), F.coalesce(y_panel >= y_min, F.lit(False))
    return F.when(a & ~b, "XX").when(b & ~a, "XY").when(a & b, "ambiguous_possible_XXY").otherwise("ambiguous_low_signal")


def sex_concordance(called, reported) -> Column:
    """Whether a sex from markers agrees with the reported one (female, male or unknown)."""
    called, reported = (F.col(c) if isinstance(c, str) else c for c in (called, reported))
    expected = F.when(called == "XX", "female").when(called == "XY", "male")
    told = F.coalesce(reported, F.lit("unknown"))
    return F.when(told == "unknown", "no_reported_sex").when(expected.isNull(), "check_aneuploidy").when(told == expected, "concordant").otherwise("DISCORDANT")


def marker_expression(counts: DataFrame, panel: DataFrame, sample: str, gene: str, count: str, order: str) -> DataFrame:
    """Count, CPM and log2 CPM of every sample x marker of the panel, in panel order; 0 where a marker has no count."""
    library = counts.groupBy(sample).agg(F.sum(count).alias("__lib"))
    own = counts.join(panel.select(gene).distinct(), gene, "left_semi").groupBy(sample, gene).agg(F.sum(count).alias(count))
    grid = library.join(panel.agg(F.collect_list(F.struct(order, gene)).alias("__p")), how="cross").select(sample, "__lib", F.inline("__p"))
    out = grid.join(own, [sample, gene], "left").withColumn(count, F.coalesce(count, F.lit(0)))
    per = F.try_divide(F.col(count) * 1e6, F.col("__lib"))
    return out.select(sample, order, gene, count, per.alias("cpm"), F.log2(per + 1).alias("log2cpm"))


def panel_scores(values: DataFrame, panel: DataFrame, gene: str, region: str, donor: str, value: str, name: str) -> DataFrame:
    """Mean z per donor, region and panel; z of a gene within a region with at least 3 values and some spread."""
    by = Window.partitionBy(region, gene)
    z = (F.col(value) - F.avg(value).over(by)) / F.stddev_samp(value).over(by)
    ok = (F.count(value).over(by) >= 3) & (F.stddev_samp(value).over(by) > 0)
    scored = values.withColumn("z", F.when(ok, z)).where("z is not null")
    return scored.join(panel, gene).groupBy(donor, region, name).agg(F.avg("z").alias("score"))


def panel_contrast(scores: DataFrame, donor: str, region: str, name: str, score: str, neuron: str, glia: Sequence[str]) -> DataFrame:
    """Panel scores side by side, the mean of the ``glia`` panels that a donor and region has, and neuron minus glia."""
    wide = scores.groupBy(donor, region).pivot(name, [neuron, *glia]).agg(F.first(score))
    there = [F.col(f"`{c}`") for c in glia]
    n = sum((c.isNotNull().cast("int") for c in there), F.lit(0))
    mean = F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in there), F.lit(0.0)), n)
    return wide.withColumn("glia", mean).withColumn("neuron_minus_glia", F.col(f"`{neuron}`") - F.col("glia"))


#: Flag, metric, comparison, limit.
QC_LIMITS = (("high_rrna", "rrna", ">", 0.10), ("low_mrna", "mrna", "<", 0.60), ("low_unique_reads", "unique_reads", "<", 10e6), ("high_contamination", "contamination_pct", ">", 0.01), ("high_species", "species_pct", ">", 0.001))


def threshold_flags(rows: DataFrame, limits: Sequence[tuple[str, str, str, float]] = QC_LIMITS) -> DataFrame:
    """Adds a flag for each limit whose metric is a column: true, false, or null where the value is no number."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    return rows.withColumns({flag: number(c) > x if op == ">" else number(c) < x for flag, c, op, x in limits if c in rows.columns})


def cross_table(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): counts of the pairs of two columns' values."""
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def qc_flags(rows: DataFrame, value: str, k: float = 3.0) -> DataFrame:
    """Adds ``high``: above the median plus k unscaled median absolute deviations over all rows; null where not a number."""
    x = F.nanvl(F.col(value).try_cast("double"), F.lit(None).cast("double"))
    (middle,) = order_statistics(rows, x, [0.5])
    if middle is None:
        return rows.withColumn("high", F.lit(None).cast("boolean"))
    (spread,) = order_statistics(rows, F.abs(x - middle), [0.5])
    return rows.withColumn("high", x > middle + k * spread)


def fraction_summary(rows: DataFrame, keys: Sequence[str], cls: str, value: str, classes: Sequence[str]) -> DataFrame:
    """Mean fraction per key and class, one column per class, 0 where absent."""
    return rows.groupBy(*keys).pivot(cls, list(classes)).agg(F.avg(value)).na.fill(0.0)


def set_mean(sets: DataFrame, scores: DataFrame, set_col: str, gene: str, score: str, leading: str) -> DataFrame:
    """Mean score over the whole set and over its leading edge; genes without a score are skipped."""
    t = sets.join(scores.select(gene, score), gene, "left")
    return t.groupBy(set_col).agg(F.avg(score).alias("mean_all"), F.avg(F.when(F.col(leading), F.col(score))).alias("mean_leading"))


def column_profile(rows: DataFrame, columns: Sequence[str], least: int = 2, most: int = 60) -> DataFrame:
    """Value counts of the columns whose number of distinct values lies between the limits."""
    n = rows.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    chosen = [c for c in columns if least <= n[c] <= most]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in chosen]))
    return rows.select(pairs.alias("p")).select("p.*").groupBy("column", "value").agg(F.count("*").alias("n"))
