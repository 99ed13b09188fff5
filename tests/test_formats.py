"""Readers and sinks on small hand-written files."""

import json

import pytest

from cohortlens.sources import readers as R, writers as W


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_vep_tab(spark, tmp_path):
    path = put(tmp_path, "a.vep", "## x\n#Uploaded_variation\tSYMBOL\tLoF\nchr1_5_A/G\tTP53\tHC\nchr1_6_A/G\t-\t.\n")
    assert rows(R.read_vep_tab(spark, path), "Uploaded_variation", "SYMBOL", "LoF") == [("chr1_5_A/G", "TP53", "HC"), ("chr1_6_A/G", None, None)]
    with pytest.raises(ValueError):
        R.read_vep_tab(spark, put(tmp_path, "b.vep", "## x\n"))


def test_vcf(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t7\t.\tA\tG\t50\tPASS\tAF=0.1;DB\tGT:DP:AD\t0/1:10:6,4\t./.\n"
    sites, calls = R.read_vcf(spark, put(tmp_path, "a.vcf", text))
    assert sites.collect()[0]["info"]["AF"] == "0.1"
    assert [tuple(r) for r in calls.orderBy("sample").select("sample", "gt", "dp", "ad").collect()] == [("s1", "0/1", 10, [6, 4]), ("s2", "./.", None, None)]


def test_gtf_first_line_of_a_gene_wins(spark, tmp_path):
    line = 'chr1\tx\tgene\t{}\t{}\t.\t+\t.\tgene_id "{}"; gene_name "{}";\n'
    path = put(tmp_path, "a.gtf", "# c\n" + line.format(11, 20, "g1", "A") + line.format(31, 40, "g2", "A") + line.format(1, 5, "g3", "B"))
    assert rows(R.read_gtf(spark, path, "gene", "gene_name"), "s", "e") == [(0, 5), (10, 20)]


def test_gct_takes_the_last_columns(spark, tmp_path):
    path = put(tmp_path, "a.gct", "#1.2\n2\t2\nName\tDescription\ts1\ts2\ng1\tx\t1\t2\ng2\ty\t3\t4\n")
    assert rows(R.read_gct(spark, path), "id", "sample", "value") == [("g1", "s1", 1.0), ("g1", "s2", 2.0), ("g2", "s1", 3.0), ("g2", "s2", 4.0)]


def test_counts_metrics_and_logs(spark, tmp_path):
    star = put(tmp_path, "d1.ReadsPerGene.out.tab", "N_unmapped\t1\t1\t1\ng1\t5\t2\t3\n")
    assert rows(R.read_star_counts(spark, star, "reverse"), "sample", "gene", "count") == [("d1", "g1", 3)]
    kv = put(tmp_path, "k.txt", "sample\tA\ntotal\t5\n")
    assert rows(R.read_kv_metrics(spark, kv), "sample", "metric", "value") == [("A", "total", "5")]
    log = put(tmp_path, "d2.Log.final.out", " Number of input reads |\t100\n Uniquely mapped reads % |\t90.5%\n")
    assert rows(R.read_aligner_log(spark, log, {"n": "input reads", "u": "Uniquely mapped reads %"}), "sample", "n", "u") == [("d2", 100.0, 90.5)]
    sec = put(tmp_path, "d3.txt", "## m\nPF_BASES\tX\tY\n10\t?\t\n")
    assert R.read_sectioned_metrics(spark, sec).collect()[0]["metrics"]["PF_BASES"] == "10"
    cov = put(tmp_path, "d4.cov", "#rname\tstartpos\tendpos\tnumreads\tcovbases\nc1\t1\t100\t5\t50\n")
    assert rows(R.read_contig_coverage(spark, cov), "sample", "contig", "s", "e", "reads", "covered") == [("d4", "c1", 0, 100, 5, 50)]


def test_kinship_and_intervals(spark, tmp_path):
    path = put(tmp_path, "k.kin0", "#FID1 IID1 FID2 IID2 NSNP KINSHIP\nf a f b 9 0.25\nf a f a 9 0.5\n")
    assert rows(R.read_kinship(spark, path), "a", "b", "kinship") == [("a", "b", 0.25)]
    assert R.read_kinship(spark, put(tmp_path, "e.kin0", "")).count() == 0
    assert rows(R.read_fam(spark, put(tmp_path, "x.fam", "f a 0 0 1 -9\n")), "family", "sample") == [("f", "a")]
    assert rows(R.read_intervals(spark, put(tmp_path, "a.bed", "c\t5\t9\tn\n"), "bed"), "s", "e", "name") == [(5, 9, "n")]
    assert rows(R.read_intervals(spark, put(tmp_path, "a.il", "@HD\nc\t5\t9\t+\tn\n"), "interval_list"), "s", "e", "name") == [(4, 9, "n")]


def test_json_catalogue_and_sheets(spark, tmp_path):
    hla = put(tmp_path, "d1.genotype.json", json.dumps({"A": ["A*01:01"]}))
    assert rows(R.read_hla_json(spark, hla), "sample", "gene") == [("d1", "A")]
    panel = put(tmp_path, "p.json", json.dumps({"genes": [{"gene_data": {"gene_symbol": "X"}, "confidence_level": "3", "mode_of_inheritance": "m", "phenotypes": ["a", "b"]}, {"gene_data": {"gene_symbol": " "}}]}))
    assert rows(R.read_panel_json(spark, panel), "symbol", "phenotypes") == [("X", "a; b")]
    cat = put(tmp_path, "s.txt", "# Bacteria\n## note\nE. coli\tGCF_1\nE. coli\tGCF_1\n# Fungi\nYeast x\tGCF_2\n")
    assert rows(R.read_catalogue(spark, cat), "section", "id") == [("Fungi", "Yeast_x_GCF_2"), ("note", "E_coli_GCF_1")]
    sheet = put(tmp_path, "s.csv", "sample,include_in_analysis\na,1\nb,1\nc,0\n")
    kept, gone = R.read_sample_sheet(spark, sheet, spark.createDataFrame([("a",)], "sample string"))
    assert (rows(kept, "sample"), rows(gone, "sample")) == ([("a",)], [("b",)])
    assert R.read_gene_table(spark, str(tmp_path / "none.csv"), ["gene"]).count() == 0
    assert rows(R.read_gene_table(spark, put(tmp_path, "g.csv", "Gene,x\nA,1\n"), ["gene"]), "symbol") == [("A",)]
    sets = put(tmp_path, "gs.tsv", "gs_name\tgene_symbol\nWP_A\tX\nWP_A\tX\nZ\tY\n")
    assert rows(R.read_gene_sets(spark, sets), "set", "collection") == [("WP_A", "WikiPathways"), ("Z", "OTHER")]


def test_sequences_and_matrices(spark, tmp_path):
    lengths = R.read_fasta_lengths(spark, put(tmp_path, "a.fa", ">c1 x\nACGT\nAC\n>c2\nA\n"))
    assert rows(lengths, "contig", "length") == [("c1", 6), ("c2", 1)]
    assert R.whole_contig_features(lengths).count() == 6
    sam = put(tmp_path, "a.sam", "@HD\nq\t16\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tXA:Z:c2,+1\n")
    assert R.read_sam_text(spark, sam).select("flag", "tags").collect()[0]["tags"]["XA"] == "c2,+1"
    assert rows(R.read_fastq(spark, put(tmp_path, "a.fq", "@r1 x\nACGT\n+\nIIII\n")), "name", "seq") == [("r1", "ACGT")]
    m = tmp_path / "m"
    m.mkdir()
    put(m, "matrix.mtx", "%%MatrixMarket\n2 2 2\n1 1 5\n2 2 7\n"), put(m, "features.tsv", "g1\ng2\n"), put(m, "cells.tsv", "c1\nc2\n")
    assert rows(R.read_mtx(spark, str(m)), "gene", "cell", "count") == [("g1", "c1", 5), ("g2", "c2", 7)]
    manifest = R.file_manifest(spark, str(m))
    assert rows(R.missing_files(spark.createDataFrame([("matrix.mtx",), ("no",)], "name string"), manifest), "name", "reason") == [("no", "missing")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, "0/1", "A"), ("s1", 2, "0/0", ""), ("s2", 1, "1/1", "B")], "sample string, pos int, gt string, tier string")
    W.write_tiers(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t/tiers"), sep="\t", header=True).count() == 2
    W.write_per_sample(df, str(tmp_path / "p"), "sample", "gt", ["pos"])
    assert spark.read.csv(str(tmp_path / "p"), sep="\t", header=True).count() == 2
    wide = W.to_wide(df, ["pos"], "sample", "pos", ["s2", "s1"])
    assert wide.columns == ["pos", "s2", "s1"]
    W.write_wide(df, str(tmp_path / "w"), ["pos"], "sample", "pos", ["s1"])
    W.write_mtx(spark.createDataFrame([("g1", "c1", 3)], "g string, c string, n long"), str(tmp_path / "m"), "g", "c", "n", {"seed": 1})
    assert rows(R.read_mtx(spark, str(tmp_path / "m")), "gene", "cell", "count") == [("g1", "c1", 3)]
    assert W.flatten_lists(spark.createDataFrame([([1, 2],)], "x array<int>")).collect()[0][0] == "1, 2"
    cells = spark.createDataFrame([("c1", "n"), ("c2", "n"), ("c3", "g")], "cell string, cls string")
    counts = spark.createDataFrame([("A", "c1", 1), ("A", "c1", 2), ("A", "c3", 4)], "gene string, cell string, n long")
    made = W.signature_inputs(counts, cells, "gene", "cell", "cls", "n", 1, 1)
    assert len(made.columns) in (2, 3)


def test_stream(spark, tmp_path):
    from cohortlens.streaming.ingest import incremental_samples

    src = tmp_path / "in"
    src.mkdir()
    panel = spark.createDataFrame([(1, "g1"), (2, "g9")], "ord int, gene string")
    for name in ("a", "b"):
        put(src, f"{name}.ReadsPerGene.out.tab", "N_x\t1\ng1\t5\ng2\t5\n")
        incremental_samples(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), panel)
    got = spark.read.parquet(str(tmp_path / "out/markers"))
    assert rows(got, "sample", "gene", "count") == [("a", "g1", 5), ("a", "g9", 0), ("b", "g1", 5), ("b", "g9", 0)]
