"""Sites with several alternate alleles: one row an allele, with the fields that go with it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions.scalar import trim_alleles


def allele_values(value: Column, number: str, allele: Column, n_alleles: Column) -> Column:
    """The part of a comma-separated field that is about the reference and one alternate allele (1, 2...).

    ``number`` is the field's count in the header: A (a value an alternate), R (a value an allele) or G (a value a
    genotype, that of alleles j <= k at k(k+1)/2 + j; a value an allele where the call is haploid). A field with
    another number of values, a missing one included, stays as it is.
    """
    parts = F.split(value, ",")
    of = lambda *at: F.array_join(F.array(*[F.get(parts, i.cast("int") if isinstance(i, Column) else F.lit(i)) for i in at]), ",")
    size = F.size(parts)
    if number == "A":
        return F.when(size == n_alleles - 1, of(allele - 1)).otherwise(value)
    if number == "R":
        return F.when(size == n_alleles, of(0, allele)).otherwise(value)
    het = F.floor(allele * (allele + 1) / 2)
    return F.when(size == n_alleles * (n_alleles + 1) / 2, of(0, het, het + allele)).when(size == n_alleles, of(0, allele)).otherwise(value)


def allele_genotype(gt: Column, allele: Column) -> Column:
    """A genotype seen from one alternate allele: that allele is 1, every other allele 0; missing calls and phase stay."""
    tokens = F.regexp_extract_all(gt, F.lit(r"\d+|[^\d]"), F.lit(0))
    one = lambda t: F.when(t == allele.cast("string"), "1").when(t.rlike(r"^\d+$"), "0").otherwise(t)
    return F.array_join(F.transform(tokens, one), "")


def split_multiallelic(rows: DataFrame, pos: str = "pos", ref: str = "ref", alt: str = "alt", info: str | None = None, calls: Sequence[str] = (), info_numbers: Mapping[str, str] = {}, call_numbers: Mapping[str, str] = {}, genotype: str = "GT", name: str = "allele") -> DataFrame:  # noqa: B006
    """One row for each alternate allele of a site (comma-separated in ``alt``), with its number from 1 in ``name``.

    ``info`` and ``calls`` name map columns (field to text); their fields with number A, R or G keep the values of the
    reference and this allele, and the genotype field is renumbered. Then the alleles are trimmed: the shared suffix,
    then the shared prefix, one base kept and the position moved; ``*`` stays. A site with one alternate is only
    trimmed; a missing ALT counts as ``.`` and keeps its row.
    """
    alts = F.split(F.coalesce(F.col(alt), F.lit(".")), ",")
    rest = [c for c in rows.columns if c != name]
    out = rows.select(*rest, (F.size(alts) + 1).alias("__n"), F.posexplode(alts).alias("__i", "__alt")).withColumn(name, F.col("__i") + 1)

    def fields(column: str, numbers: Mapping[str, str], gt: str | None) -> Column:
        def one(key: Column, value: Column) -> Column:
            done = value
            for number in "ARG":
                if named := [k for k, v in numbers.items() if v == number]:
                    done = F.when(key.isin(*named), allele_values(value, number, F.col(name), F.col("__n"))).otherwise(done)
            return done if gt is None else F.when(key == gt, allele_genotype(value, F.col(name))).otherwise(done)

        return F.transform_values(column, one)

    if info is not None:
        out = out.withColumn(info, fields(info, info_numbers, None))
    for column in calls:
        out = out.withColumn(column, fields(column, call_numbers, genotype))
    out = out.withColumn("__t", trim_alleles(pos, ref, "__alt"))
    return out.withColumns({pos: F.col("__t.pos"), ref: F.col("__t.ref"), alt: F.col("__t.alt")}).select(*rest, name)
