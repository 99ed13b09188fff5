"""Readers of the cohort's file formats. Each returns a lazily read DataFrame; lines stay distributed."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

def _file() -> Column:
    return F.col("_metadata.file_name")



def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path)


def _numbered(spark: SparkSession, path) -> DataFrame:
    """(file, block, n, value): lines that are not empty with their number in their file, from 0.

    A task reads a file block from end to end, so a line's number is its number in the task, less that of the block's first
    line, plus the lines of the blocks before: one row a block, and lines are neither shuffled nor sorted.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", "\r$", "").alias("value"))
    blocks = lines.groupBy("file", "block").agg(F.min("__id").alias("__first"), F.count("*").alias("__size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = blocks.select("file", "block", (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    t = lines.join(F.broadcast(offset), ["file", "block"]).withColumn("n", F.col("__id") + F.col("__offset"))
    return t.where("value <> ''").select("file", "block", "n", "value")


def _carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the last non-null value at or before each line of its file: within blocks, then across them."""
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("n"))
    ends = lines.groupBy("file", "block").agg(F.max_by(value, F.when(value.isNotNull(), F.col("n"))).alias("__end"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.last("__end", ignorenulls=True).over(before).alias("__before"))
    return lines.withColumn(name, own).join(ends, ["file", "block"]).withColumn(name, F.coalesce(name, "__before")).drop("__before")


def _first_line(lines: DataFrame, test: Column) -> str | None:
    found = lines.where(test).limit(1).collect()
    return found[0]["value"] if found else None


def _table(lines: DataFrame, header: Sequence[str], sep: str = "\t") -> DataFrame:
    parts = F.split("value", sep, -1)
    return lines.select(*[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(header)])


def read_vep_tab(spark: SparkSession, path) -> DataFrame:
    """Annotated variants: ``##`` lines skipped, names from the ``#Uploaded_variation`` line, ``-`` and ``.`` to null; all strings."""
    lines = _lines(spark, path)
    head = _first_line(lines, F.col("value").startswith("#Uploaded_variation"))
    if head is None:
        raise ValueError(f"{path}: no #Uploaded_variation line")
    names = head[1:].split("\t")
    t = _table(lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")), names)
    return t.select(*[F.when(~F.col(f"`{c}`").isin("-", "."), F.col(f"`{c}`")).alias(c) for c in names])


def _first_of_each(entries: Column) -> Column:
    """Map of an array of (k, v) entries; a repeated key keeps its first value."""
    return F.map_from_entries(F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda y: y["k"] == x["k"])))


def read_vcf_numbers(spark: SparkSession, path) -> tuple[dict[str, str], dict[str, str]]:
    """The Number of each INFO and of each FORMAT field, as the header lines declare them."""
    lines = _lines(spark, path).where(F.col("value").rlike("^##(INFO|FORMAT)=<"))
    part = lambda k: F.regexp_extract("value", rf"[<,]{k}=([^,>]*)", 1)
    found = lines.select(F.regexp_extract("value", "^##([A-Z]+)", 1).alias("kind"), part("ID").alias("id"), part("Number").alias("number")).distinct().collect()  # a row a field
    return tuple({r["id"]: r["number"] for r in found if r["kind"] == kind} for kind in ("INFO", "FORMAT"))


def read_vcf(spark: SparkSession, path, all_fields: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sites (chrom, pos, id, ref, alt, qual, filter, info map) and long calls (chrom, pos, ref, alt, sample, gt, dp, ad, gq).

    A repeated INFO key keeps its first value. With ``all_fields`` the calls also have all their fields as a map.
    """
    lines = _lines(spark, path)
    head = _first_line(lines, F.col("value").startswith("#CHROM"))
    if head is None:
        raise ValueError(f"{path}: no #CHROM line")
    samples = head.split("\t")[9:]
    parts = F.split("value", "\t")
    names = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(names)], F.slice(parts, 10, max(len(samples), 1)).alias("__v"))
    rows = rows.withColumn("pos", F.col("pos").try_cast("int"))
    pairs = F.transform(F.split("info", ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    sites = rows.select("chrom", "pos", F.nullif("id", F.lit(".")).alias("id"), "ref", "alt", F.col("qual").try_cast("double").alias("qual"), "filter", _first_of_each(pairs).alias("info"))
    long = rows.select("chrom", "pos", "ref", "alt", "format", F.posexplode("__v").alias("__k", "__c"))
    keys, given = F.split("format", ":"), F.split("__c", ":")
    fields = F.map_from_arrays(F.slice(keys, F.lit(1), F.size(given)), given)
    long = long.withColumn("__m", fields).withColumn("sample", F.element_at(F.array(*map(F.lit, samples or [""])), F.col("__k") + 1))
    get = lambda k: F.nullif(F.try_element_at("__m", F.lit(k)), F.lit("."))
    calls = long.select("chrom", "pos", "ref", "alt", "sample", F.try_element_at("__m", F.lit("GT")).alias("gt"), get("DP").try_cast("int").alias("dp"), F.transform(F.split(get("AD"), ","), lambda x: x.try_cast("int")).alias("ad"), get("GQ").try_cast("int").alias("gq"), *([F.col("__m").alias("fields")] if all_fields else []))
    return sites, calls


def read_gtf(spark: SparkSession, path, feature: str | None = None, first_per: str | None = None) -> DataFrame:
    """Gene model as half-open intervals with an attribute map; the first line of each value of ``first_per`` wins."""
    parts = F.split("value", "\t")
    rows = _numbered(spark, path).where(~F.col("value").startswith("#") & (F.size(parts) >= 9))
    pairs = F.regexp_extract_all(F.get(parts, F.lit(8)), F.lit(r'(\w+) "([^"]*)"'), F.lit(0))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("k"), F.regexp_extract(x, r'"([^"]*)"', 1).alias("v")))
    t = rows.select("file", "n", F.get(parts, F.lit(0)).alias("contig"), F.get(parts, F.lit(2)).alias("feature"), (F.get(parts, F.lit(3)).try_cast("long") - 1).alias("s"), F.get(parts, F.lit(4)).try_cast("long").alias("e"), F.get(parts, F.lit(6)).alias("strand"), _first_of_each(entries).alias("attrs"))
    if feature:
        t = t.where(F.col("feature") == feature)
    if first_per:
        key = F.try_element_at("attrs", F.lit(first_per))
        t = t.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("file", "n"))).where("__r = 1").drop("__r")
    return t.drop("file")


def read_gct(spark: SparkSession, path) -> DataFrame:
    """(id, sample, value) of a matrix with a two-line preamble; the samples are the last columns, as many as line 2 says."""
    lines = _numbered(spark, path)
    head = {r["n"]: r["value"] for r in lines.where("n in (1, 2)").collect()}
    n_cols, names = int(head[1].split("\t")[1]), head[2].split("\t")
    parts = F.split("value", "\t")
    values = F.slice(parts, len(names) - n_cols + 1, n_cols)
    t = lines.where("n > 2").select("n", F.get(parts, F.lit(0)).alias("id"), F.explode(F.arrays_zip(F.array(*map(F.lit, names[-n_cols:])).alias("sample"), values.alias("value"))).alias("z"))
    return t.select("n", "id", F.col("z.sample").alias("sample"), F.col("z.value").try_cast("double").alias("value"))


def read_star_counts(spark: SparkSession, paths, strand: str = "unstranded") -> DataFrame:
    """(sample, gene, count) of one strand column; ``N_`` rows go, the sample is the file name up to its first full stop or ReadsPerGene."""
    column = {"unstranded": 1, "forward": 2, "reverse": 3}[strand]
    parts = F.split("value", "\t")
    t = spark.read.text(paths).select(_file().alias("f"), F.get(parts, F.lit(0)).alias("gene"), F.get(parts, F.lit(column)).try_cast("long").alias("count"))
    return t.where(~F.col("gene").startswith("N_")).select(F.regexp_replace("f", r"(ReadsPerGene.*|\..*)$", "").alias("sample"), "gene", "count")


def read_kinship(spark: SparkSession, path) -> DataFrame:
    """(a, b, kinship): columns found by name (ends in kinship; IID1 or ID1; IID2 or ID2), else the last, first and third; self pairs go."""
    lines = _numbered(spark, path)
    schema = "a string, b string, kinship double"
    head = _first_line(lines, F.col("n") == 0)
    if head is None:
        return spark.createDataFrame([], schema)
    names = [x.lstrip("#").lower() for x in head.split()]
    find = lambda wanted, other: next((k for k, x in enumerate(names) if x in wanted), other)
    a, b = find(("iid1", "id1"), 0), find(("iid2", "id2"), 2)
    k = next((j for j, x in enumerate(names) if x.endswith("kinship")), len(names) - 1)
    parts = F.split(F.trim("value"), r"\s+")
    t = lines.where("n > 0").select(F.get(parts, F.lit(a)).alias("a"), F.get(parts, F.lit(b)).alias("b"), F.get(parts, F.lit(k)).try_cast("double").alias("kinship"))
    return t.where("a <> b and kinship is not null")


def read_fam(spark: SparkSession, path) -> DataFrame:
    """(family, sample) from the first two white-space columns."""
    parts = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("family"), F.get(parts, F.lit(1)).alias("sample")).where("sample is not null")


def read_intervals(spark: SparkSession, path, kind: str) -> DataFrame:
    """(contig, s, e, name) half-open, from ``bed`` (as it is) or ``interval_list`` (1-based inclusive, ``@`` lines skipped)."""
    parts = F.split("value", "\t")
    shift, name = (0, 3) if kind == "bed" else (1, 4)
    t = _lines(spark, path).where(~F.col("value").rlike(r"^(@|#|track|browser)") & (F.size(parts) >= 3))
    return t.select(F.get(parts, F.lit(0)).alias("contig"), (F.get(parts, F.lit(1)).try_cast("long") - shift).alias("s"), F.get(parts, F.lit(2)).try_cast("long").alias("e"), F.get(parts, F.lit(name)).alias("name"))


def read_kv_metrics(spark: SparkSession, paths) -> DataFrame:
    """(sample, metric, value) of key-tab-value files that name their sample in a ``sample`` row."""
    parts = F.split("value", "\t")
    t = spark.read.text(paths).select(F.col("_metadata.file_path").alias("f"), F.get(parts, F.lit(0)).alias("metric"), F.get(parts, F.lit(1)).alias("value")).where("value is not null")
    names = t.where("metric = 'sample'").groupBy("f").agg(F.max("value").alias("sample"))
    return t.where("metric <> 'sample'").join(names, "f").select("sample", "metric", "value")


def read_aligner_log(spark: SparkSession, paths, labels: dict[str, str]) -> DataFrame:
    """One row per file: the values behind ``label | value`` lines whose label contains each text; sample from the file name."""
    parts = F.split("value", r"\|")
    t = spark.read.text(paths).select(F.col("_metadata.file_path").alias("f"), F.regexp_replace(_file(), r"(Log\.final.*|\..*)$", "").alias("sample"), F.trim(F.get(parts, F.lit(0))).alias("label"), F.trim(F.regexp_replace(F.get(parts, F.lit(1)), "[%\t]", "")).alias("v"))
    return t.groupBy("f", "sample").agg(*[F.max(F.when(F.col("label").contains(text), F.col("v").try_cast("double"))).alias(name) for name, text in labels.items()]).drop("f")


def read_sectioned_metrics(spark: SparkSession, paths, start: str = "PF_BASES") -> DataFrame:
    """(sample, metrics map): names from the line that starts with ``start``, values from the line after it."""
    lines = _numbered(spark, paths)
    w = Window.partitionBy("file").orderBy("n")
    t = lines.withColumn("__next", F.lead("value").over(w)).where(F.col("value").startswith(start))
    values = F.split("__next", "\t", -1)
    keys = F.split("value", "\t", -1)
    padded = F.transform(keys, lambda k, i: F.get(values, i))
    return t.select(F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\..*$", "").alias("sample"), F.map_from_arrays(keys, padded).alias("metrics"))


def read_contig_coverage(spark: SparkSession, paths) -> DataFrame:
    """(sample, contig, s, e, reads, covered) of per-contig coverage tables; malformed lines go."""
    p = F.split("value", "\t")
    t = spark.read.text(paths).select(F.regexp_replace(_file(), r"\..*$", "").alias("sample"), F.get(p, F.lit(0)).alias("contig"), *[F.get(p, F.lit(k)).try_cast("long").alias(c) for k, c in enumerate(("s", "e", "reads", "covered"), 1)])
    return t.where("s is not null and e is not null and reads is not null and covered is not null").withColumn("s", F.col("s") - 1)


def read_hla_json(spark: SparkSession, paths) -> DataFrame:
    """(sample, gene, alleles) of genotype files."""
    t = spark.read.text(paths, wholetext=True).select(F.regexp_replace(_file(), r"\..*$", "").alias("sample"), F.from_json("value", "map<string,array<string>>").alias("m"))
    return t.select("sample", F.explode("m").alias("gene", "alleles"))


def read_panel_json(spark: SparkSession, path) -> DataFrame:
    """(symbol, confidence, moi, phenotypes) of a nested gene panel; entries without a symbol go."""
    schema = "genes array<struct<gene_data: struct<gene_symbol: string>, confidence_level: string, mode_of_inheritance: string, phenotypes: array<string>>>"
    t = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("genes").alias("g"))
    t = t.select(F.trim("g.gene_data.gene_symbol").alias("symbol"), F.col("g.confidence_level").alias("confidence"), F.col("g.mode_of_inheritance").alias("moi"), F.array_join("g.phenotypes", "; ").alias("phenotypes"))
    return t.where("symbol <> ''")


def read_catalogue(spark: SparkSession, path, heading: str | None = None) -> DataFrame:
    """(n, section, id, name, accession): tab lines under the last ``#`` heading; id is the sanitised name and accession, the first wins.

    A heading holds within its file; of several files the first by name counts first. ``heading`` is a pattern that the section must match, in any case.
    """
    title = F.when(F.col("value").rlike(r"^#+\s*\S"), F.trim(F.regexp_replace("value", r"^#+", "")))
    t = _carried(_numbered(spark, path), title, "section").where(~F.col("value").startswith("#") & F.col("value").contains("\t"))
    p = F.split("value", "\t")
    t = t.select("file", "n", "section", F.trim(F.get(p, F.lit(0))).alias("name"), F.trim(F.get(p, F.lit(1))).alias("accession"))
    t = t.withColumn("id", F.concat(F.regexp_replace("name", r"[^A-Za-z0-9]+", "_"), F.lit("_"), "accession"))
    t = t.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy("file", "n"))).where("__r = 1").drop("__r", "file")
    return t.where(F.col("section").rlike(f"(?i){heading}")) if heading else t


def read_sample_sheet(spark: SparkSession, path, present: DataFrame, sample: str = "sample", include: str = "include_in_analysis") -> tuple[DataFrame, DataFrame]:
    """Included samples that are present, and those that are not."""
    t = spark.read.csv(path, header=True, sep="\t" if str(path).endswith((".tsv", ".txt")) else ",").where(F.trim(include) == "1")
    names = present.select(sample).distinct()
    return t.join(names, sample, "left_semi"), t.join(names, sample, "left_anti")


def _along(spark: SparkSession, path) -> DataFrame:
    """(n, value): lines numbered from 0 through all files of a path in the order of their names."""
    lines = _numbered(spark, path)
    sizes = lines.groupBy("file").agg(F.max("n").alias("__last"))  # one row a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("file", F.coalesce(F.sum(F.col("__last") + 1).over(before), F.lit(0)).alias("__base"))
    return lines.join(offset, "file").select((F.col("n") + F.col("__base")).alias("n"), "value")


def read_mtx(spark: SparkSession, folder: str) -> DataFrame:
    """(gene, cell, count) of a MatrixMarket triple with features and cells; stays sparse.

    Each of the three is a file, or a folder of part files in the order of their names. The first line that is no
    comment holds the dimensions.
    """
    body = _along(spark, f"{folder}/matrix.mtx").where(~F.col("value").startswith("%"))
    first = body.agg(F.min("n")).first()[0]
    p = F.split(F.trim("value"), r"\s+")
    t = body.where(F.col("n") > first).select(*[F.get(p, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(("i", "j", "count"))])
    genes = _along(spark, f"{folder}/features.tsv").select((F.col("n") + 1).cast("double").alias("i"), F.split("value", "\t")[0].alias("gene"))
    cells = _along(spark, f"{folder}/cells.tsv").select((F.col("n") + 1).cast("double").alias("j"), F.split("value", "\t")[0].alias("cell"))
    return t.join(genes, "i").join(cells, "j").select("gene", "cell", F.col("count").cast("long").alias("count"))


def read_gene_table(spark: SparkSession, path, candidates: Sequence[str], hint: str | None = None, optional: bool = True) -> DataFrame:
    """A comma (.csv) or tab table with its symbol column renamed to ``symbol``; missing or empty and optional gives no rows."""
    from cohortlens.functions.scalar import resolve_column

    try:
        t = spark.read.csv(path, header=True, sep="," if str(path).endswith(".csv") else "\t")
    except Exception:
        if not optional:
            raise
        t = spark.createDataFrame([], "symbol string")
    found = resolve_column(t.columns, candidates, hint) or ("symbol" if "symbol" in t.columns else None)
    if found is None:
        if t.columns and not optional:
            raise ValueError(f"{path}: none of {list(candidates)} among {t.columns}")
        return spark.createDataFrame([], "symbol string")
    return t.withColumnRenamed(found, "symbol")


#: Prefix of a set's name, collection.
COLLECTIONS = (("WP_", "WikiPathways"), ("REACTOME_", "Reactome"), ("KEGG_", "KEGG"), ("HP_", "HPO"), ("HALLMARK_", "Hallmark"), ("GOCC_", "GO CC"), ("GOMF_", "GO MF"), ("GOBP_", "GO BP"))


def read_gene_sets(spark: SparkSession, path, set_col: str = "gs_name", gene_col: str = "gene_symbol") -> DataFrame:
    """Distinct (set, gene, collection); the collection goes by the name's prefix, else OTHER."""
    t = spark.read.csv(path, header=True, sep="\t").select(F.col(set_col).alias("set"), F.col(gene_col).alias("gene")).distinct()
    return t.withColumn("collection", collection_of(F.col("set")))


def collection_of(name: Column) -> Column:
    out = F.lit("OTHER")
    for prefix, label in reversed(COLLECTIONS):
        out = F.when(name.startswith(prefix), label).otherwise(out)
    return out


def read_fasta_lengths(spark: SparkSession, path) -> DataFrame:
    """(contig, length): id is the first word of a header, length the letters of its lines."""
    name = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1))
    t = _carried(_numbered(spark, path), name, "contig").where(~F.col("value").startswith(">"))
    return t.groupBy("contig").agg(F.sum(F.length(F.trim("value"))).alias("length"))


def whole_contig_features(lengths: DataFrame) -> DataFrame:
    """gene, transcript and exon rows over each whole contig."""
    kinds = F.explode(F.array(F.lit("gene"), F.lit("transcript"), F.lit("exon"))).alias("feature")
    return lengths.select("contig", kinds, F.lit(0).cast("long").alias("s"), F.col("length").cast("long").alias("e"))


def read_sam_text(spark: SparkSession, path) -> DataFrame:
    """(qname, flag, contig, pos, mapq, cigar, seq, tags map) of SAM lines; a repeated tag keeps its first value."""
    p = F.split("value", "\t")
    t = _lines(spark, path).where(~F.col("value").startswith("@") & (F.size(p) >= 11))
    tags = _first_of_each(F.transform(F.slice(p, F.lit(12), F.size(p)), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substr(x, F.lit(6), F.length(x)).alias("v"))))
    return t.select(F.get(p, F.lit(0)).alias("qname"), F.get(p, F.lit(1)).try_cast("int").alias("flag"), F.get(p, F.lit(2)).alias("contig"), F.get(p, F.lit(3)).try_cast("long").alias("pos"), F.get(p, F.lit(4)).try_cast("int").alias("mapq"), F.get(p, F.lit(5)).alias("cigar"), F.get(p, F.lit(9)).alias("seq"), tags.alias("tags"))


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """(name, seq, qual) of four-line records.

    Records whose lines come together in a batch are made there; only lines of others are brought together by a shuffle.
    """
    t = _numbered(spark, path).select("file", "n", "value")
    whole = "whole boolean, file string, r long, k int, name string, seq string, qual string"
    names = [c.split()[0] for c in whole.split(", ")]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy(zero_copy_only=False)
            file = batch["file"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(n[: len(n) - 3] % 4 == 0) if len(n) > 3 else np.zeros(0, np.int64)
            at = at[(n[at + 1] == n[at] + 1) & (n[at + 2] == n[at] + 2) & (n[at + 3] == n[at] + 3) & (file[at] == file[at + 3])]
            rest = np.ones(len(n), dtype=bool)
            for k in range(4):
                rest[at + k] = False
            rest = np.flatnonzero(rest)
            nulls = [pa.nulls(len(at), kind) for kind in (pa.string(), pa.int64(), pa.int32())]
            lines = [batch["value"].take(pa.array(at + k)).cast(pa.string()) for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), dtype=bool)), *nulls, *lines], names=names)
            of, line = (batch[c].take(pa.array(rest)).cast(pa.string()) for c in ("file", "value"))
            none = pa.nulls(len(rest), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rest), dtype=bool)), of, pa.array(n[rest] // 4), pa.array((n[rest] % 4).astype(np.int32)), line, none, none], names=names)

    t = t.mapInArrow(records, whole)
    apart = t.where("not whole").groupBy("file", "r").agg(*[F.max(F.when(F.col("k") == k, F.col("name"))).alias(c) for k, c in ((0, "name"), (1, "seq"), (3, "qual"))])
    g = t.where("whole").select("name", "seq", "qual").unionByName(apart.select("name", "seq", "qual"))
    return g.select(F.regexp_extract("name", r"^@(\S+)", 1).alias("name"), "seq", "qual")


def file_manifest(spark: SparkSession, path, hash_content: bool = True, largest_hashed: int = (1 << 31) - (1 << 20)) -> DataFrame:
    """(path, size, modified, sha256, status) of the files under a path.

    A file is hashed as one value, which Spark bounds at 2 GiB; longer ones than ``largest_hashed`` are listed without
    being read, with a null hash and the status ``unhashed``. Spark's reader leaves out empty files; they come from its
    listing (names only), with the status ``empty``, no time and, where content is hashed, the hash of nothing.
    """
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")
    names = spark.createDataFrame([(unquote(f),) for f in t.inputFiles()], "path string").select(plain("path").alias("__path")).distinct()
    listed = t.select("path", plain("path").alias("__path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    listed = names.join(listed, "__path", "left").select(F.coalesce("path", "__path").alias("path"), F.coalesce("size", F.lit(0)).alias("size"), "modified")
    status = F.when(F.col("size") == 0, "empty").otherwise("ok")
    if not hash_content:
        return listed.select("*", F.lit(None).cast("string").alias("sha256"), status.alias("status"))
    digests = t.where(F.col("length") <= largest_hashed).select("path", F.sha2("content", 256).alias("sha256"))
    digest = F.when(F.col("size") == 0, F.sha2(F.lit(""), 256)).otherwise(F.col("sha256"))
    status = F.when(F.col("size") > largest_hashed, "unhashed").otherwise(status)
    return listed.join(digests, "path", "left").select("path", "size", "modified", digest.alias("sha256"), status.alias("status"))


def missing_files(expected: DataFrame, manifest: DataFrame, name: str = "name", index: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """Expected file names that are missing, empty or unindexed, with the reason.

    ``index`` maps an ending to what the name of its index has behind it, such as ``.bam`` to ``.bai``.
    """
    have = manifest.select(F.regexp_extract("path", r"([^/]+)$", 1).alias(name), "status")
    needed = F.lit(None).cast("string")
    for ending, more in index.items():
        needed = F.when(F.col(name).endswith(ending), F.concat(name, F.lit(more))).otherwise(needed)
    there = have.where("status = 'ok'").select(F.col(name).alias("__needed"), F.lit(True).alias("__there"))
    t = expected.withColumn("__needed", needed).join(have, name, "left").join(there, "__needed", "left")
    reason = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "ok", F.col("status")).when(F.col("__needed").isNotNull() & F.col("__there").isNull(), "unindexed")
    return t.select(name, reason.alias("reason")).where("reason is not null")
