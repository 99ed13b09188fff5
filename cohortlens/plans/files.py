"""Queries over file formats: text that Spark writes from the tables, read again by the readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.plans.roles import Catalogue, role, using
from cohortlens.runtime import Scratch, shuffle_partitions
from cohortlens.sources import readers as R, writers as W
from cohortlens.streaming.ingest import incremental_samples

Q = Catalogue()


def _written(lines: DataFrame, order: str, name: str, head: str | None = None, together: int = 1) -> str:
    """Writes the column ``line`` in sorted text files, one a range of the order, each below an optional head; returns the folder.

    Rows whose order divided by ``together`` is the same stay in one file.
    """
    spark = lines.sparkSession
    path = f"{Scratch(spark, 'text').base}/{name}"
    top = [] if head is None else head.splitlines()

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            if schema is None:
                schema = batch.schema
                yield pa.RecordBatch.from_arrays([pa.array(top, schema.field(0).type)], schema=schema)
            yield batch

    rows = lines.select(F.col(order).cast("long").alias("o"), "line").repartitionByRange(shuffle_partitions(spark), F.floor(F.col("o") / together)).sortWithinPartitions("o").select("line")
    (rows.mapInArrow(headed, "line string") if top else rows).write.text(path)
    return path


@Q.add("src1_read_vep_tab", "select 'v' || p_partkey as id, p_brand as symbol, case when p_size % 2 = 0 then 'HC' end as lof from part")
def src1(spark, d):
    lines = role(spark, d, "part").select("p_partkey", F.concat_ws("\t", F.concat(F.lit("v"), F.col("p_partkey").cast("string")), "p_brand", F.when(F.col("p_size") % 2 == 0, "HC").otherwise("-")).alias("line"))
    t = R.read_vep_tab(spark, _written(lines, "p_partkey", "vep", "## made up\n#Uploaded_variation\tSYMBOL\tLoF"))
    return t.select(F.col("Uploaded_variation").alias("id"), F.col("SYMBOL").alias("symbol"), F.col("LoF").alias("lof"))


@Q.add("src2_read_vcf", "select cast(p_partkey as int) as pos, s as sample, case s when 's1' then '0/1' else './.' end as gt, case s when 's1' then p_size end as dp, 'AF' as field from part, (values ('s1'), ('s2')) v(s)")
def src2(spark, d):
    line = F.concat_ws("\t", F.lit("chr1"), F.col("p_partkey").cast("string"), F.lit("."), F.lit("A"), F.lit("G"), F.lit("."), F.lit("PASS"), F.lit("AF=0.1;DB"), F.lit("GT:DP"), F.concat(F.lit("0/1:"), F.col("p_size").cast("string")), F.lit("./."))
    path = _written(role(spark, d, "part").select("p_partkey", line.alias("line")), "p_partkey", "vcf", "##v\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2")
    sites, calls = R.read_vcf(spark, path)
    return calls.join(sites.select("pos", F.map_keys("info")[0].alias("field")), "pos").select("pos", "sample", "gt", "dp", "field")


@Q.add("src3_read_gtf", "select p_brand as gene, arg_min(p_partkey * 10 - 1, p_partkey) as s, arg_min(p_partkey * 10 + p_size, p_partkey) as e from part where p_size % 2 = 0 group by 1")
def src3(spark, d):
    attrs = F.concat(F.lit('gene_id "g'), F.col("p_partkey").cast("string"), F.lit('"; gene_name "'), F.col("p_brand"), F.lit('";'))
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("x"), F.when(F.col("p_size") % 2 == 0, "gene").otherwise("exon"), (F.col("p_partkey") * 10).cast("string"), (F.col("p_partkey") * 10 + F.col("p_size")).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs)
    t = R.read_gtf(spark, _written(role(spark, d, "part").select("p_partkey", line.alias("line")), "p_partkey", "gtf", "#c"), "gene", "gene_name")
    return t.select(F.col("attrs")["gene_name"].alias("gene"), "s", "e")


@Q.add("src4_read_gct", "select 'g' || p_partkey as id, s as sample, cast(case s when 's1' then p_size else p_size * 2 end as double) as value from part, (values ('s1'), ('s2')) v(s)")
def src4(spark, d):
    line = F.concat_ws("\t", F.concat(F.lit("g"), F.col("p_partkey").cast("string")), F.col("p_brand"), F.lit("meta"), F.col("p_size").cast("string"), (F.col("p_size") * 2).cast("string"))
    return R.read_gct(spark, _written(role(spark, d, "part").select("p_partkey", line.alias("line")), "p_partkey", "gct", "#1.3\n9\t2\t1\nName\tDescription\tm\ts1\ts2")).select("id", "sample", "value")


@Q.add("src5_read_star_counts", "select 'g' || p_partkey as gene, cast(p_size * 3 as bigint) as count from part")
def src5(spark, d):
    line = F.concat_ws("\t", F.concat(F.lit("g"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string"), (F.col("p_size") * 2).cast("string"), (F.col("p_size") * 3).cast("string"))
    head = "\n".join(f"N_{x}\t1\t1\t1" for x in ("unmapped", "multimapping", "noFeature", "ambiguous"))
    return R.read_star_counts(spark, _written(role(spark, d, "part").select("p_partkey", line.alias("line")), "p_partkey", "star", head), "reverse").select("gene", "count")


@Q.add("src6_read_fam", "select 'f' || c_nationkey as family, 's' || c_custkey as sample from customer")
def src6b(spark, d):
    line = F.concat_ws("  ", F.concat(F.lit("f"), F.col("c_nationkey").cast("string")), F.concat(F.lit("s"), F.col("c_custkey").cast("string")), F.lit("0 0 1 -9"))
    return R.read_fam(spark, _written(role(spark, d, "customer").select("c_custkey", line.alias("line")), "c_custkey", "fam"))


@Q.add("src7_read_intervals", using("r_regions") + " select contig, s, e, name from r_regions")
def src7(spark, d):
    rows = role(spark, d, "r_regions")
    line = F.concat_ws("\t", "contig", (F.col("s") + 1).cast("string"), F.col("e").cast("string"), F.lit("+"), "name")
    return R.read_intervals(spark, _written(rows.select("region_id", line.alias("line")), "region_id", "il", "@HD"), "interval_list")


@Q.add("src14_read_catalogue", "select 'section ' || (p_partkey // 100) as section, p_type || '_A' || p_partkey as id from part where p_partkey % 100 <> 0")
def src14(spark, d):
    line = F.when(F.col("p_partkey") % 100 == 0, F.concat(F.lit("## section "), F.floor(F.col("p_partkey") / 100).cast("string"))).otherwise(F.concat("p_type", F.lit("\tA"), F.col("p_partkey").cast("string")))
    first = role(spark, d, "part").select("p_partkey", line.alias("line"))
    return R.read_catalogue(spark, _written(first, "p_partkey", "cat", "# all\n# section 0", together=100)).select("section", "id")


@Q.add("src16_snk5_mtx", using("r_counts") + " select 'g' || gene as gene, 's' || sample as cell, cnt as count from r_counts")
def src16(spark, d):
    rows = role(spark, d, "r_counts").select(F.concat(F.lit("g"), F.col("gene").cast("string")).alias("gene"), F.concat(F.lit("s"), F.col("sample").cast("string")).alias("cell"), F.col("cnt").alias("count"))
    folder = f"{Scratch(spark, 'mtx').base}/m"
    W.write_mtx(rows, folder, "gene", "cell", "count")
    return R.read_mtx(spark, folder)


@Q.add("src18_read_gene_sets", "select p_brand as gene, case when p_size % 3 = 0 then 'WikiPathways' when p_size % 3 = 1 then 'GO BP' else 'OTHER' end as collection, count(distinct p_type) as n from part group by 1, 2")
def src18(spark, d):
    prefix = F.element_at(F.array(F.lit("WP_"), F.lit("GOBP_"), F.lit("X_")), F.col("p_size") % 3 + 1)
    line = F.concat(prefix, F.col("p_type"), F.lit("\t"), F.col("p_brand"))
    t = R.read_gene_sets(spark, _written(role(spark, d, "part").select("p_partkey", line.alias("line")), "p_partkey", "gs", "gs_name\tgene_symbol"))
    return t.groupBy("gene", "collection").agg(F.count("*").alias("n"))


@Q.add("src19_read_fasta_lengths", "select 'c' || item_id as contig, length(replace(replace(text, chr(10), ''), ' ', '')) as length from benchmark")
def src19(spark, d):
    body = F.regexp_replace("text", "[\n ]", "")
    rows = role(spark, d, "benchmark").select(F.col("item_id"), F.concat(F.lit(">c"), F.col("item_id").cast("string"), F.lit(" x\n"), F.regexp_replace(body, "(.{60})", "$1\n")).alias("line"))
    return R.read_fasta_lengths(spark, _written(rows, "item_id", "fa"))


@Q.add("src20_read_sam_fastq", "select 'q' || event_id as name, cast(event_id % 61 as int) as mapq, 'c' || (event_id % 3) as xa from events")
def src20(spark, d):
    e = role(spark, d, "events")
    name = F.concat(F.lit("q"), F.col("event_id").cast("string"))
    fastq = R.read_fastq(spark, _written(e.select("event_id", F.concat(F.lit("@"), name, F.lit("\nACGT\n+\n@III")).alias("line")), "event_id", "fq"))
    sam = F.concat_ws("\t", name, F.lit("16"), F.lit("c"), F.lit("5"), (F.col("event_id") % 61).cast("string"), F.lit("4M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"), F.concat(F.lit("XA:Z:c"), (F.col("event_id") % 3).cast("string")))
    t = R.read_sam_text(spark, _written(e.select("event_id", sam.alias("line")), "event_id", "sam", "@HD"))
    return fastq.where("qual = '@III'").join(t, F.col("name") == F.col("qname")).select("name", "mapq", F.col("tags")["XA"].alias("xa"))


@Q.add("snk1_write_tiers", "with t as (select p_partkey as k, case when p_size < 5 then 'A' when p_size < 10 then 'B' when p_size < 12 then 'C' else '' end as tier from part) select tier, count(*) as n from t where tier <> '' group by tier")
def snk1(spark, d):
    rows = role(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") < 5, "A").when(F.col("p_size") < 10, "B").when(F.col("p_size") < 12, "C").otherwise("").alias("tier"))
    path = f"{Scratch(spark, 'tiers').base}/t"
    W.write_tiers(rows, path)
    return spark.read.csv(f"{path}/tiers", sep="\t", header=True).groupBy("tier").agg(F.count("*").alias("n"))


@Q.add("snk3_write_per_sample", using("r_calls") + " select sample, count(*) as n from r_calls where dosage > 1 group by sample")
def snk3(spark, d):
    calls = role(spark, d, "r_calls").withColumn("gt", F.when(F.col("dosage") > 1, "1/1").otherwise("./."))
    path = f"{Scratch(spark, 'samples').base}/s"
    W.write_per_sample(calls, path, "sample", "gt", ["site"])
    return spark.read.csv(path, sep="\t", header=True).groupBy(F.col("sample").cast("int").alias("sample")).agg(F.count("*").alias("n"))


@Q.add("snk4_to_wide", using("r_counts") + " select gene, coalesce(max(cnt) filter (sample = 2), 0) as s2, coalesce(max(cnt) filter (sample = 1), 0) as s1 from r_counts group by gene")
def snk4(spark, d):
    rows = role(spark, d, "r_counts").withColumn("name", F.concat(F.lit("s"), F.col("sample").cast("string")))
    return W.to_wide(rows, ["gene"], "name", "cnt", ["s2", "s1"])


@Q.add("snk6_flatten_lists", "select p_brand as b, string_agg(distinct p_type, ', ' order by p_type) as types from part group by 1")
def snk6(spark, d):
    return W.flatten_lists(role(spark, d, "part").groupBy(F.col("p_brand").alias("b")).agg(F.array_sort(F.collect_set("p_type")).alias("types")))


@Q.add("ag28_file_manifest", """select cast(n_regionkey as varchar) as region, sum(length(n_name) + 1) as size, sha256(string_agg(n_name, chr(10) order by n_nationkey) || chr(10)) as sha256, 'ok' as status from nation group by n_regionkey""")
def ag28(spark, d):
    """Manifest of one written file a region, with hashes of their contents."""
    rows = role(spark, d, "nation").select(F.col("n_regionkey").alias("sample"), F.col("n_nationkey").alias("o"), F.col("n_name").alias("line"))
    t = R.file_manifest(spark, f"{_per_sample_files(rows, 'manifest')}/*")
    return t.select(F.regexp_extract("path", "sample=([^/]+)", 1).alias("region"), "size", "sha256", "status")


@Q.add("ag28_missing_files", """select name, reason from (select 's' || (c_custkey % 50) || x as name, case when c_custkey % 50 % 7 = 0 then 'missing' when c_custkey % 50 % 7 = 1 then 'empty' when x = '.bam' and c_custkey % 50 % 3 = 0 then 'unindexed' end as reason
 from customer, (values ('.bam'), ('.txt')) v(x)) t where reason is not null group by 1, 2""")
def ag28b(spark, d):
    """Expected files that a manifest lacks, has empty, or has without their index."""
    k = F.col("c_custkey") % 50
    each = role(spark, d, "customer").select(k.alias("k"), F.explode(F.array(F.lit(".bam"), F.lit(".txt"))).alias("x")).distinct()
    name = F.concat(F.lit("s"), F.col("k").cast("string"), F.col("x")).alias("name")
    have = each.where("k % 7 <> 0").select(F.concat(F.lit("/data/"), name).alias("path"), F.when(F.col("k") % 7 == 1, "empty").otherwise("ok").alias("status"))
    index = each.where("x = '.bam' and k % 3 <> 0").select(F.concat(F.lit("/data/"), name, F.lit(".bai")).alias("path"), F.lit("ok").alias("status"))
    return R.missing_files(each.select(name), have.unionByName(index), index={".bam": ".bai"})


@Q.add("ing1_marker_rows", using("r_counts") + " select cast(sample as varchar) as sample, cast(gene as varchar) as gene, cnt from r_counts join part on gene = p_partkey where p_size % 10 = 0 and cnt > 0")
def ing1(spark, d):
    """Count files, one a sample, taken by the file stream; the marker rows that it has appended."""
    panel = role(spark, d, "part").where("p_size % 10 = 0").select(F.col("p_partkey").cast("string").alias("gene"), F.col("p_partkey").alias("ord"))
    lines = role(spark, d, "r_counts").select("sample", F.col("gene").alias("o"), F.concat_ws("\t", F.col("gene").cast("string"), F.col("cnt").cast("string")).alias("line"))
    base = Scratch(spark, "stream").base
    incremental_samples(spark, f"{_per_sample_files(lines, 'counts')}/*", f"{base}/out", f"{base}/checkpoint", panel, F.regexp_extract("path", "sample=([^/]+)", 1))
    return spark.read.parquet(f"{base}/out/markers").where("count > 0").select("sample", "gene", F.col("count").alias("cnt"))


@Q.add("src6_read_kinship", using("r_edges") + " select 'n' || src as a, 'n' || dst as b, (src % 10) / 40.0e0 as kinship from r_edges")
def src6(spark, d):
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    line = F.concat_ws("  ", F.lit("f"), name("src"), F.lit("f"), name("dst"), F.lit("9"), ((F.col("src") % 10) / 40.0).cast("string"))
    own = F.concat_ws("  ", F.lit("f"), name("src"), F.lit("f"), name("src"), F.lit("9"), F.lit("0.5"))
    rows = role(spark, d, "r_edges").select("src", F.explode(F.array(line, own)).alias("line"))
    return R.read_kinship(spark, _written(rows, "src", "kin", "#FID1 IID1 FID2 IID2 NSNP KINSHIP"))


def _per_sample_files(lines: DataFrame, name: str) -> str:
    """One text file per sample; columns sample, o and line."""
    path = f"{Scratch(lines.sparkSession, 'text').base}/{name}"
    parts = shuffle_partitions(lines.sparkSession)  # given, since many small files are few bytes but much work
    lines.repartition(parts, "sample").sortWithinPartitions("sample", "o").select("sample", "line").write.partitionBy("sample").text(path)
    return path


def _file_each(texts: DataFrame, name: str) -> str:
    """One text file for each row of the column ``line``, all in one folder: files in folders of their own are slow to make and to list."""
    spark = texts.sparkSession
    path = f"{Scratch(spark, 'text').base}/{name}"
    texts.select("line").repartition(shuffle_partitions(spark)).write.option("maxRecordsPerFile", 1).text(path)
    return path


@Q.add("src8_read_kv_metrics", "select cast(c_custkey // 100 as varchar) as sample, m || '_' || c_custkey as metric, case m when 'reads' then cast(c_nationkey as varchar) else cast(c_nationkey * 2 as varchar) end as value from customer, (values ('reads'), ('bases')) v(m)")
def src8(spark, d):
    c = role(spark, d, "customer").withColumn("sample", F.floor(F.col("c_custkey") / 100))
    pair = lambda k, v: F.concat(F.lit(f"{k}_"), F.col("c_custkey").cast("string"), F.lit("\t"), v.cast("string"))
    rows = c.select("sample", F.col("c_custkey").alias("o"), F.explode(F.array(pair("reads", F.col("c_nationkey")), pair("bases", F.col("c_nationkey") * 2))).alias("line"))
    names = c.select("sample", F.lit(-1).cast("long").alias("o"), F.concat(F.lit("sample\t"), F.col("sample").cast("string")).alias("line")).distinct()
    lines = rows.withColumn("o", F.col("o").cast("long")).unionByName(names).groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("l"))  # of at most 100 customers
    return R.read_kv_metrics(spark, _file_each(lines.select(F.array_join(F.col("l")["line"], "\n").alias("line")), "kv"))


_LABELS = {"reads": "input reads", "unique": "Uniquely mapped reads number", "unique_pct": "Uniquely mapped reads %", "multi_pct": "mapped to multiple loci", "many_pct": "mapped to too many loci", "short_pct": "unmapped: too short", "splices": "splices: Total"}


@Q.add("src9_read_aligner_log", """select cast(count(*) as double) as reads, cast(min(c_custkey) as double) as unique, sum(c_nationkey) / 4.0e0 as unique_pct, 1.5e0 as multi_pct, cast(max(c_nationkey) as double) as many_pct, cast(min(c_nationkey) as double) as short_pct,
 cast(max(c_custkey) as double) as splices from customer group by c_custkey // 100""")
def src9(spark, d):
    c = role(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("sample")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b"), F.sum("c_nationkey").alias("s"), F.min("c_nationkey").alias("lo"), F.max("c_nationkey").alias("hi"))
    line = lambda label, v, end="": F.concat(F.lit(f"  {label} |\t"), v.cast("string"), F.lit(end))
    lines = F.array(F.lit("Started job on |\tnow"), line("Number of input reads", F.col("n")), line("Uniquely mapped reads number", F.col("a")), line("Uniquely mapped reads %", F.col("s") / 4.0, "%"), line("% of reads mapped to multiple loci", F.lit(1.5), "%"),
                    line("% of reads mapped to too many loci", F.col("hi"), "%"), line("% of reads unmapped: too short", F.col("lo"), "%"), line("Number of splices: Total", F.col("b")))
    t = R.read_aligner_log(spark, _file_each(c.select(F.array_join(lines, "\n").alias("line")), "log"), _LABELS)
    return t.select(*_LABELS)


@Q.add("src10_read_sectioned_metrics", "select cast(sum(c_nationkey) as varchar) as bases, cast(count(*) as varchar) as reads from customer group by c_custkey // 100")
def src10(spark, d):
    c = role(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("sample")).agg(F.sum("c_nationkey").alias("s"), F.count("*").alias("n"))
    lines = F.array(F.lit("## METRICS"), F.lit("PF_BASES\tPF_READS\tX"), F.concat_ws("\t", F.col("s").cast("string"), F.col("n").cast("string"), F.lit("?")), F.lit("tail"))
    t = R.read_sectioned_metrics(spark, _file_each(c.select(F.array_join(lines, "\n").alias("line")), "sec"))
    return t.select(F.col("metrics")["PF_BASES"].alias("bases"), F.col("metrics")["PF_READS"].alias("reads"))


@Q.add("src11_read_contig_coverage", "select p_brand as contig, cast(0 as bigint) as s, sum(p_size) as covered, count(*) as n from part where p_size % 4 <> 0 group by 1")
def src11(spark, d):
    line = F.concat_ws("\t", "p_brand", F.lit("1"), F.lit("100"), F.lit("5"), F.when(F.col("p_size") % 4 == 0, "bad").otherwise(F.col("p_size").cast("string")))
    t = R.read_contig_coverage(spark, _written(role(spark, d, "part").select("p_partkey", line.alias("line")), "p_partkey", "cov", "#rname\tstartpos\tendpos\tnumreads\tcovbases"))
    return t.groupBy("contig", "s").agg(F.sum("covered").alias("covered"), F.count("*").alias("n"))


@Q.add("src12_read_hla_json", "select 'A' as gene, 'A*' || c_custkey as allele, 1 as n from customer union all select 'B', 'B*' || (c_custkey // 20), 1 from customer group by c_custkey // 20")
def src12(spark, d):
    """Files of the alleles of at most 20 customers each."""
    c = role(spark, d, "customer").withColumn("sample", F.floor(F.col("c_custkey") / 20))
    c = c.groupBy("sample").agg(F.sort_array(F.collect_list(F.concat(F.lit("A*"), F.col("c_custkey").cast("string")))).alias("A"))
    made = F.to_json(F.struct("A", F.array(F.concat(F.lit("B*"), F.col("sample").cast("string"))).alias("B")))
    t = R.read_hla_json(spark, _file_each(c.select(made.alias("line")), "hla"))
    return t.select("gene", F.explode("alleles").alias("allele")).groupBy("gene", "allele").agg(F.count("*").alias("n"))


@Q.add("src13_read_panel_json", "select p_brand as symbol, cast(p_size % 4 as varchar) as confidence, 'AD' as moi, p_type || '; ' || p_name as phenotypes from part where p_partkey % 5 > 0")
def src13(spark, d):
    """Panel files of at most 100 genes each."""
    symbol = F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).otherwise(" ")
    gene = F.struct(F.struct(symbol.alias("gene_symbol")).alias("gene_data"), (F.col("p_size") % 4).cast("string").alias("confidence_level"), F.lit("AD").alias("mode_of_inheritance"), F.array("p_type", "p_name").alias("phenotypes"))
    panels = role(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("sample")).agg(F.to_json(F.struct(F.collect_list(gene).alias("genes"))).alias("line"))
    return R.read_panel_json(spark, _file_each(panels, "panel"))


@Q.add("src15_read_sample_sheet", "select 'kept' as side, count(*) as n from customer where c_custkey % 2 = 1 and c_custkey % 3 = 0 union all select 'gone', count(*) from customer where c_custkey % 2 = 1 and c_custkey % 3 <> 0")
def src15(spark, d):
    c = role(spark, d, "customer")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), (F.col("c_custkey") % 2).cast("string"))
    present = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("sample"))
    kept, gone = R.read_sample_sheet(spark, _written(c.select("c_custkey", line.alias("line")), "c_custkey", "sheet", "sample,include_in_analysis"), present)
    return kept.agg(F.lit("kept").alias("side"), F.count("*").alias("n")).unionByName(gone.agg(F.lit("gone").alias("side"), F.count("*").alias("n")))


@Q.add("src17_read_gene_table", "select p_brand as symbol, count(*) as n from part group by 1")
def src17(spark, d):
    line = F.concat("p_type", F.lit("\t"), "p_brand")
    t = R.read_gene_table(spark, _written(role(spark, d, "part").select("p_partkey", line.alias("line")), "p_partkey", "genes", "kind\tGene_Symbol"), ["gene_symbol", "symbol"])
    missing = R.read_gene_table(spark, f"{Scratch(spark, 'none').base}/none.csv", ["symbol"])
    return t.select("symbol").unionByName(missing.select("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


@Q.add("snk7_signature_inputs", using("r_counts") + ", k as (select sample, row_number() over (partition by 's' || (sample % 2) order by md5('4|' || sample), sample) as n from (select distinct sample from r_counts) t) select gene % 40 as gene, sum(cnt) as total from r_counts where sample in (select sample from k where n <= 3) group by 1")
def snk7(spark, d):
    counts = role(spark, d, "r_counts").withColumn("gene", F.col("gene") % 40)
    cells = counts.select("sample").distinct().withColumn("cls", F.concat(F.lit("s"), (F.col("sample") % 2).cast("string")))
    wide = W.signature_inputs(counts, cells, "gene", "sample", "cls", "cnt", 3, 4)
    names = [c for c in wide.columns if c != "gene"]
    return wide.select("gene", sum((F.col(f"`{c}`") for c in names[1:]), F.col(f"`{names[0]}`")).alias("total"))
