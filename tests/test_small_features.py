"""Site filters, warnings, fallbacks, marker purity, and files that are read as several parts."""

import math
import warnings

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import aggregate as A, enrich as E, graph as G, ranking as R
from cohortlens.sources import readers


def test_only_autosomal_biallelic_sites_are_kept(spark):
    sites = [("1", "A", "T"), ("chr22", "A", "T"), ("chrX", "A", "T"), ("23", "A", "T"), ("2", "A", "T,G"), ("3", "A", "*"), ("4", ".", "T"), (None, "A", "T"), ("5", "A", None), ("6", "A", ".")]
    rows = [(k, s, d, *site) for k, site in enumerate(sites) for s, d in enumerate((0, 1, 1, 2))]
    calls = spark.createDataFrame(rows, "site int, s int, d int, contig string, ref string, alt string")
    kept = lambda **how: sorted(r["site"] for r in G.prune_sites(calls, "site", "d", 4, **how).collect())
    assert kept() == list(range(10))
    assert kept(contig="contig", ref="ref", alt="alt") == [0, 1]
    assert kept(contig="contig") == [0, 1, 4, 5, 6, 8, 9]


def test_few_subjects_and_few_rows_are_told(spark):
    cells = spark.createDataFrame([("g", "s1", "a", 1), ("g", "s2", "a", 2), ("g", "s1", "b", 3)], "g string, s string, c string, n int")
    with pytest.warns(UserWarning, match="fewer than 2 subjects: b"):
        A.pseudobulk(cells, "g", "s", "c", "n").count()
    with pytest.warns(UserWarning, match=r"fewer than 2 rows: b \(1\)"):
        assert R.stratified_cap(cells, "c", "s", 1, 1, floor=2).count() == 2
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        A.pseudobulk(cells.where("c = 'a'"), "g", "s", "c", "n").count()
        R.stratified_cap(cells, "c", "s", 1, 1, floor=1).count()
        A.pseudobulk(cells, "g", "s", "c", "n", least_subjects=0).count()


def test_the_panel_stands_in_for_a_missing_constraint_table(spark):
    table = spark.createDataFrame([("A", "0.3"), ("B", "0.9"), ("C", "n/a")], "s string, l string")
    panel = spark.createDataFrame([(" P ",), ("",), (None,)], "s string")
    names = lambda t: sorted(r["s"] for r in t.collect())
    assert names(A.constrained_set(table, "s", "l", panel=panel)) == ["A"]
    assert names(A.constrained_set(table.limit(0), "s", "l", panel=panel)) == names(A.constrained_set(None, "s", "l", panel=panel)) == ["P"]
    assert names(A.constrained_set(table.limit(0), "s", "l")) == []
    with pytest.raises(ValueError):
        A.constrained_set(None, "s", "l")


def test_share_of_markers_that_are_highest(spark):
    values = spark.createDataFrame([("g1", "a", 9), ("g1", "b", 1), ("g2", "a", 1), ("g2", "b", 5), ("g3", "a", 4), ("g3", "b", 4)], "g string, c string, n int")
    markers = spark.createDataFrame([("g1", "a"), ("g2", "a"), ("g3", "a"), ("none", "a"), ("g2", "b"), ("g2", "b")], "g string, c string")
    got = {r["c"]: (r["n_markers"], r["highest"]) for r in E.marker_purity(markers, values, "g", "c", "n").collect()}
    assert got["a"][0] == 4 and math.isclose(got["a"][1], 0.25) and got["b"] == (1, 1.0)


def test_the_first_of_several_files_counts_first(spark, tmp_path):
    for name, start in (("a", 10), ("b", 1)):
        (tmp_path / f"{name}.gtf").write_text(f'chr1\tx\tgene\t{start}\t20\t.\t+\t.\tgene_name "G";\n')
        (tmp_path / f"{name}.cat").write_text(f"# section {name}\none two\tA1\n")
    gene = readers.read_gtf(spark, [str(tmp_path / "b.gtf"), str(tmp_path / "a.gtf")], "gene", "gene_name").collect()
    assert [(g["s"], g["e"]) for g in gene] == [(9, 20)]
    got = readers.read_catalogue(spark, [str(tmp_path / "b.cat"), str(tmp_path / "a.cat")]).collect()
    assert [(r["id"], r["section"]) for r in got] == [("one_two_A1", "section a")]
    (tmp_path / "x.fam").write_text("f1 s1 0 0 1 -9\n\nf2\ts2\nlonely\n")
    fam = readers.read_fam(spark, str(tmp_path / "x.fam")).orderBy(F.col("sample"))
    assert [tuple(r) for r in fam.collect()] == [("f1", "s1"), ("f2", "s2")]
