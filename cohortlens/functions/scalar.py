"""Column functions over annotations, genotypes, alleles and identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

#: Fixed values of the source's rules.
LOF_TERMS = ("stop_gained", "frameshift_variant", "splice_donor_variant", "splice_acceptor_variant", "start_lost", "stop_lost", "transcript_ablation")
MISSENSE_TERMS = ("missense_variant",)
PROTEIN_ALTERING_TERMS = ("missense_variant", "inframe_insertion", "inframe_deletion", "splice_region_variant", "protein_altering_variant", *LOF_TERMS)
CARRIER_GENOTYPES = ("0/1", "1/0", "1/1", "0|1", "1|0", "1|1")
REFERENCE_GENOTYPES = ("0/0", "./.", "0|0", ".|.")
SPLICE_MIN, AM_MIN, REVEL_MIN, AF_MAX = 0.20, 0.564, 0.773, 0.001
SNP_FILTERS = (("QD2", "QD", "<", 2.0), ("FS60", "FS", ">", 60.0), ("MQ40", "MQ", "<", 40.0), ("MQRankSum-12.5", "MQRankSum", "<", -12.5), ("ReadPosRankSum-8", "ReadPosRankSum", "<", -8.0), ("SOR3", "SOR", ">", 3.0))
INDEL_FILTERS = (("QD2", "QD", "<", 2.0), ("FS200", "FS", ">", 200.0), ("ReadPosRankSum-20", "ReadPosRankSum", "<", -20.0), ("SOR10", "SOR", ">", 10.0))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_variant_key(c) -> Column:
    """``CHROM_POS_REF/ALT`` or ``chr:pos[-end]`` as struct(chrom, pos, ref, alt); fields that do not parse are null."""
    c = _c(c)
    part = lambda p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    long, short = r"^(.+)_(\d+)_([^_/]*)/(.*)$", r"^([^:]+):(\d+)(?:-\d+)?$"
    pick = lambda k: F.when(c.rlike(long), part(long, k)).otherwise(part(short, k) if k < 3 else F.lit(None))
    return F.struct(pick(1).alias("chrom"), pick(2).try_cast("int").alias("pos"), pick(3).alias("ref"), pick(4).alias("alt"))


def row_max_ignore_null(*cols) -> Column:
    """Largest of the columns that are numbers; NaN, text that is no number and null count as missing."""
    numbers = [F.nanvl(_c(c).try_cast("double"), F.lit(None).cast("double")) for c in cols]
    return F.greatest(*numbers) if len(numbers) > 1 else numbers[0]


def allele_fraction(ad, dp) -> Column:
    """Second allele depth over depth; null with fewer than two depths or a depth of 0 or less."""
    parts = F.split(_c(ad), ",")
    depth = _c(dp).try_cast("double")
    return F.when((F.size(parts) >= 2) & (depth > 0), F.get(parts, F.lit(1)).try_cast("double") / depth)


def carries_alt(gt) -> Column:
    """Whether a genotype is one of the six biallelic carrier strings."""
    return F.coalesce(_c(gt).isin(*CARRIER_GENOTYPES), F.lit(False))


def not_reference(gt) -> Column:
    """Whether a genotype is neither homozygous reference nor missing; half-missing calls stay."""
    return F.coalesce(~_c(gt).isin(*REFERENCE_GENOTYPES), F.lit(False))


def rare_or_absent(af, most: float = AF_MAX) -> Column:
    """Whether a frequency is missing or below ``most``."""
    return _c(af).isNull() | (_c(af) < most)


def variant_class(ref, alts) -> Column:
    """SNP, INDEL or MIXED from the lengths of the reference and of comma-separated alternates; ``*`` does not count."""
    ref = _c(ref)
    real = F.filter(F.split(_c(alts), ","), lambda a: a != "*")
    snp = F.exists(real, lambda a: F.length(a) == F.length(ref))
    indel = F.exists(real, lambda a: F.length(a) != F.length(ref))
    return F.when(snp & indel, "MIXED").when(indel, "INDEL").when(snp, "SNP")


def hard_filter(kind, rules: Mapping[str, Sequence[tuple]] = {"SNP": SNP_FILTERS, "INDEL": INDEL_FILTERS}) -> Column:  # noqa: B006
    """Names of the filters that fire, joined by ``;``, else PASS; a missing value does not fire."""

    def fired(named: Sequence[tuple]) -> Column:
        tests = [F.when(F.col(c) < x if op == "<" else F.col(c) > x, F.lit(name)) for name, c, op, x in named]
        found = F.array_compact(F.array(*tests))
        return F.when(F.size(found) == 0, "PASS").otherwise(F.array_join(found, ";"))

    out = F.lit("PASS")
    for k, named in rules.items():
        out = F.when(_c(kind) == k, fired(named)).otherwise(out)
    return out


def trim_alleles(pos, ref, alt) -> Column:
    """struct(pos, ref, alt) with the shared suffix, then the shared prefix gone, one base kept; ``*`` stays as it is."""
    pos, ref, alt = _c(pos), _c(ref), _c(alt)
    shorter = F.least(F.length(ref), F.length(alt))
    steps = F.when(shorter > 1, F.sequence(F.lit(1), shorter - 1)).otherwise(F.array().cast("array<int>"))
    same_end = lambda k: F.substr(ref, F.length(ref) - k + 1, F.lit(1)) == F.substr(alt, F.length(alt) - k + 1, F.lit(1))
    back = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n == k - 1) & same_end(k), k).otherwise(n))
    r, a = F.substr(ref, F.lit(1), F.length(ref) - back), F.substr(alt, F.lit(1), F.length(alt) - back)
    left = F.least(F.length(r), F.length(a))
    steps = F.when(left > 1, F.sequence(F.lit(1), left - 1)).otherwise(F.array().cast("array<int>"))
    front = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substr(r, k, F.lit(1)) == F.substr(a, k, F.lit(1))), k).otherwise(n))
    done = F.struct((pos + front).alias("pos"), F.substr(r, front + 1, F.length(r)).alias("ref"), F.substr(a, front + 1, F.length(a)).alias("alt"))
    return F.when(alt == "*", F.struct(pos.alias("pos"), ref.alias("ref"), alt.alias("alt"))).otherwise(done)


def any_term(terms, wanted: Sequence[str]) -> Column:
    """Whether any of the comma-separated terms is wanted; false for null."""
    return F.coalesce(F.arrays_overlap(F.split(_c(terms), ","), F.array(*map(F.lit, wanted))), F.lit(False))


def flag_lof(consequence, lof=None) -> Column:
    """Loss-of-function term, and high confidence where that column exists."""
    hit = any_term(consequence, LOF_TERMS)
    return hit if lof is None else hit & F.coalesce(F.trim(_c(lof)) == "HC", F.lit(False))


def flag_splice(score, least: float = SPLICE_MIN) -> Column:
    """Splice score at or above the limit."""
    return F.coalesce(_c(score) >= least, F.lit(False))


def flag_damaging(consequence, constrained, am_class=None, am_score=None, revel=None) -> Column:
    """Missense in a constrained gene with any predictor at its limit; a score that is no number counts as missing."""
    number = lambda c: F.nanvl(_c(c).try_cast("double"), F.lit(None).cast("double"))
    tests = [F.lit(False)]
    if am_class is not None:
        tests.append(F.lower(F.trim(_c(am_class))) == "likely_pathogenic")
    if am_score is not None:
        tests.append(number(am_score) >= AM_MIN)
    if revel is not None:
        tests.append(number(revel) >= REVEL_MIN)
    any_hit = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    return any_term(consequence, MISSENSE_TERMS) & _c(constrained) & any_hit


def assign_tier(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first tier whose condition holds, else the empty string."""
    out = F.lit("")
    for name, test in reversed(list(rules)):
        out = F.when(test, name).otherwise(out)
    return out


def resolve_column(columns: Sequence[str], candidates: Sequence[str], hint: str | None = None) -> str | None:
    """The hint if it exists, else the first candidate that exists, else the first that does so in any case."""
    if hint in columns:
        return hint
    lower = {c.lower(): c for c in reversed(columns)}
    return next((c for c in candidates if c in columns), None) or next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def ordered_columns(columns: Sequence[str], renames: Mapping[str, str], groups: Sequence[Sequence[str]], last: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(old, new) names in output order: the groups' columns that exist, then the rest sorted, then ``last``."""
    named = {renames.get(c, c): c for c in columns}
    first = [c for group in groups for c in group if c in named and c not in last]
    rest = sorted(c for c in named if c not in first and c not in last)
    return [(named[c], c) for c in [*first, *rest, *(c for c in last if c in named)]]


def strip_version(c) -> Column:
    """An identifier up to its first full stop."""
    return F.regexp_replace(_c(c), r"\..*$", "")


def passes_read_filter(flag, mapq=None, min_mapq: int = 0, exclude_bits: int = 0, require_bits: int = 0) -> Column:
    """Whether a read has the required flag bits, none of the excluded, and the mapping quality."""
    flag = _c(flag)
    ok = (flag.bitwiseAND(exclude_bits) == 0) & (flag.bitwiseAND(require_bits) == require_bits)
    return ok if mapq is None else ok & (_c(mapq) >= min_mapq)


def two_field_pair(alleles) -> Column:
    """Two alleles cut to two fields and sorted; a single call counts twice, none gives null."""
    cut = F.sort_array(F.transform(_c(alleles), lambda a: F.array_join(F.slice(F.split(a, ":"), 1, 2), ":")))
    return F.when(F.size(cut) > 0, F.array(F.get(cut, F.lit(0)), F.coalesce(F.get(cut, F.lit(1)), F.get(cut, F.lit(0)))))


def classify_by_pattern(c, rules: Sequence[tuple[str, str]], other: str | None = None) -> Column:
    """Label of the first pattern that is found."""
    out = F.lit(other).cast("string")
    for pattern, label in reversed(list(rules)):
        out = F.when(_c(c).rlike(pattern), label).otherwise(out)
    return out


def normalise_sex(c) -> Column:
    """male, female or unknown."""
    low = F.lower(F.trim(_c(c)))
    return F.when(low.isin("m", "male"), "male").when(low.isin("f", "female"), "female").otherwise("unknown")


def last_bracket(c) -> Column:
    """Text in the last pair of square brackets, else unknown."""
    found = F.regexp_extract_all(_c(c), F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    return F.coalesce(F.when(F.size(found) > 0, F.element_at(found, -1)), F.lit("unknown"))


def overlap_coefficient(common, a, b) -> Column:
    return _c(common) / F.least(_c(a), _c(b))
