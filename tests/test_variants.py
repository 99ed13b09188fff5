"""Splitting of multi-allelic sites, and files whose fields repeat."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import joins as J, variants as V
from cohortlens.sources import readers as R

VCF = """##fileformat=VCFv4.2
##INFO=<ID=AC,Number=A,Type=Integer,Description="x">
##INFO=<ID=DP,Number=1,Type=Integer,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
1\t100\t.\tCAG\tC,CAT,*\t9\tPASS\tAC=1,2,3;DP=7;DP=8;DB\tGT:AD:PL\t1/2:4,5,6,7:0,1,2,3,4,5,6,7,8,9\t.|3:1,2,3:.
1\t200\t.\tG\t.\t9\tPASS\tDP=1\tGT\t0/0\t./.
1\t300\t.\tG\tT\t9\tPASS\tAC=4\tGT:AD\t1|0:3,4\t1:5,6
"""


def test_vcf_is_split_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    info, form = R.read_vcf_numbers(spark, str(tmp_path / "a.vcf"))
    assert (info, form) == ({"AC": "A", "DP": "1"}, {"AD": "R", "PL": "G"})
    sites, calls = R.read_vcf(spark, str(tmp_path / "a.vcf"), all_fields=True)
    got = V.split_multiallelic(sites, info="info", info_numbers=info).orderBy("pos", "allele").collect()
    assert [(r["allele"], r["pos"], r["ref"], r["alt"]) for r in got] == [(1, 100, "CAG", "C"), (3, 100, "CAG", "*"), (2, 102, "G", "T"), (1, 200, "G", "."), (1, 300, "G", "T")]
    assert [r["info"] for r in got[:3]] == [{"AC": a, "DP": "7", "DB": None} for a in ("1", "3", "2")]  # the first DP wins
    got = V.split_multiallelic(calls, calls=["fields"], call_numbers=form).orderBy("sample", "pos", "allele").collect()
    cells = {(r["sample"], r["pos"], r["allele"]): r["fields"] for r in got}
    assert cells["S1", 100, 1] == {"GT": "1/0", "AD": "4,5", "PL": "0,1,2"}
    assert cells["S1", 102, 2] == {"GT": "0/1", "AD": "4,6", "PL": "0,3,5"}
    assert cells["S1", 100, 3] == {"GT": "0/0", "AD": "4,7", "PL": "0,6,9"}
    assert cells["S2", 100, 3] == {"GT": ".|1", "AD": "1,2,3", "PL": "."}  # a wrong number of values stays
    assert cells["S2", 300, 1] == {"GT": "1", "AD": "5,6"} and cells["S2", 200, 1] == {"GT": "./."}


def test_null_and_empty_fields(spark):
    rows = spark.createDataFrame([(1, 5, "A", None, None), (2, None, "A", "C,G", {}), (3, 7, None, "C", {"GT": None})], "k int, pos int, ref string, alt string, f map<string,string>")
    got = V.split_multiallelic(rows, calls=["f"], call_numbers={"AD": "R"}).orderBy("k", "allele").collect()
    assert [(r["k"], r["allele"], r["pos"], r["alt"], r["f"]) for r in got[:3]] == [(1, 1, 5, ".", None), (2, 1, None, "C", {}), (2, 2, None, "G", {})]
    assert got[3]["f"] == {"GT": None}
    assert V.split_multiallelic(rows.limit(0)).count() == 0


def test_repeated_tags_and_keys_keep_the_first(spark, tmp_path):
    line = "\t".join(["q", "0", "c", "5", "60", "4M", "*", "0", "0", "ACGT", "IIII", "XA:Z:one", "NM:i:1", "XA:Z:two"])
    (tmp_path / "a.sam").write_text(line + "\n")
    assert R.read_sam_text(spark, str(tmp_path / "a.sam")).first()["tags"] == {"XA": "one", "NM": "1"}
    mapping = spark.createDataFrame([("a", "mouse", 2), ("a", "rat", 1), ("b", "cat", 3)], "key string, species string, ord int").coalesce(1)
    rows = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "key string")
    named = lambda **how: sorted(str(r["species"]) for r in J.lookup_default(rows, mapping, "key", "species", **how).collect())
    assert named() == ["mouse", "mouse", "unknown", "unknown"] and named(order="ord") == ["rat", "rat", "unknown", "unknown"]
    got = J.annotate_by_symbol(rows, {"t": mapping}, "key").orderBy("key").collect()
    assert [(r["key"], r["t_species"], r["in_t"]) for r in got] == [(None, None, False), ("a", "mouse", True), ("a", "mouse", True), ("z", None, False)]


def test_first_row_of_equal_ids_counts(spark):
    counts = spark.createDataFrame([("E1.9", 5), ("E1.10", 7), ("E2.1", 1)], "id string, n int").coalesce(1)
    reference = spark.createDataFrame([("E1.4", 1), ("E3.1", 2)], "id string, o int")
    assert [tuple(r) for r in J.align_to_order(counts, reference, "id", "n", "o").orderBy("o").collect()] == [(1, "E1.4", 5), (2, "E3.1", 0)]


def test_long_files_are_listed_without_a_hash(spark, tmp_path):
    (tmp_path / "long").write_text("x" * 100)
    (tmp_path / "short").write_text("x")
    (tmp_path / "none").write_text("")
    got = {r["path"].rpartition("/")[2]: (r["status"], r["sha256"] is None) for r in R.file_manifest(spark, str(tmp_path), largest_hashed=50).collect()}
    assert got == {"long": ("unhashed", True), "short": ("ok", False), "none": ("empty", False)}
    assert R.file_manifest(spark, str(tmp_path), hash_content=False).where(F.col("sha256").isNotNull()).count() == 0


@pytest.mark.parametrize("gt, allele, want", [("1/2", 2, "0/1"), ("10|1", 1, "0|1"), ("10|1", 10, "1|0"), (".", 1, "."), ("2", 1, "0")])
def test_genotypes_are_renumbered(spark, gt, allele, want):
    assert spark.range(1).select(V.allele_genotype(F.lit(gt), F.lit(allele)).alias("g")).first()["g"] == want
