"""Queries over enrichment, matched nulls and expression statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import enrich as E, ranking as R
from cohortlens.plans.roles import Catalogue, role, using

Q = Catalogue()
_RANK = ", k as (select donor, gene, stat, row_number() over (partition by donor order by stat desc, gene) as rank from {src}), nn as (select donor, count(*) as n_ranked from k group by donor)"
_ES = """, h as (select k.donor, set_id, gene, stat, rank, n_ranked, count(*) over (partition by k.donor, set_id) as size from k join r_sets using (gene) join nn on nn.donor = k.donor),
 f as (select *, row_number() over w as i, sum(abs(stat)) over w as up, sum(abs(stat)) over (partition by donor, set_id) as tot from h where size between 20 and 200 window w as (partition by donor, set_id order by rank)),
 x as (select donor, set_id, size, max(up / tot - (rank - i) / cast(n_ranked - size as double)) as mx, min((up - abs(stat)) / tot - (rank - i) / cast(n_ranked - size as double)) as mn from f group by 1, 2, 3),
 es as (select donor, set_id, size, case when mx > -mn then mx when mx < -mn then mn else 0 end as es from x)"""
_EN = using("r_z", "r_sets") + _RANK.format(src="(select donor, gene, z as stat from r_z)") + _ES


def _ranked(spark, d):
    return R.rank_desc(role(spark, d, "r_z").withColumnRenamed("z", "stat"), "donor", "stat", "gene")


def _scores(spark, d):
    return E.enrichment_score(_ranked(spark, d), role(spark, d, "r_sets"), ["donor"], "set_id", "gene")


_EDGE = """, tb as (select *, up / tot - (rank - i) / cast(n_ranked - size as double) as top, (up - abs(stat)) / tot - (rank - i) / cast(n_ranked - size as double) as bot from f),
 ends as (select donor, set_id, arg_max(rank, struct_pack(a := top, b := -rank)) as at_max, arg_min(rank, struct_pack(a := bot, b := rank)) as at_min from tb group by 1, 2),
 lead as (select f.donor, f.set_id, string_agg(cast(gene as varchar), ',' order by rank) as genes from f join es on es.donor = f.donor and es.set_id = f.set_id join ends on ends.donor = f.donor and ends.set_id = f.set_id where (es > 0 and rank <= at_max) or (es < 0 and rank >= at_min) group by 1, 2)"""


@Q.add("en1_enrichment_score", _EN + _EDGE + " select es.donor, es.set_id, size, round(es, 6) as es, coalesce(genes, '') as leading_edge from es left join lead on lead.donor = es.donor and lead.set_id = es.set_id")
def en1(spark, d):
    return _scores(spark, d).select("donor", "set_id", "size", F.round("es", 6).alias("es"), F.array_join(F.col("leading_edge").cast("array<string>"), ",").alias("leading_edge"))


@Q.add("en2_enrichment_test")
def en2(spark, d):
    out = E.enrichment_test(_ranked(spark, d), role(spark, d, "r_sets"), ["donor"], "set_id", "gene", n_perm=200)
    return out.select("donor", "set_id", "size", "es", "pval", "nes", "padj")


def _ranked_over_all(spark, d):
    """One ranking of the genes, by their statistic over all donors."""
    z = role(spark, d, "r_z").groupBy("gene").agg(F.sum("z").alias("stat"))
    return R.rank_over_all(z, [F.col("stat").desc(), F.col("gene")])


@Q.add("en4_leave_one_out")
def en4(spark, d):
    """Each of the three top genes left out in turn."""
    ranked = _ranked_over_all(spark, d)
    return E.leave_one_out(ranked, role(spark, d, "r_sets"), ranked.where("rank <= 3"), "set_id", "gene", n_perm=100).select("left_out", "set_id", "size", "es", "pval", "nes", "padj")


@Q.add("en3_collapse_sets")
def en3(spark, d):
    """The sets with p of 0.1 at most among all sets."""
    ranked, sets = _ranked_over_all(spark, d), role(spark, d, "r_sets")
    tested = E.enrichment_test(ranked, sets, [], "set_id", "gene", n_perm=100)
    return E.collapse_sets(tested, ranked, sets, "set_id", "gene", n_perm=100, significant=F.col("pval") <= 0.1)


_P = ", tp as (select set_id, (set_id * 37 % 101) / 101.0e0 as pval, count(*) as size from r_sets group by set_id)"


def _tested(spark, d):
    return role(spark, d, "r_sets").groupBy("set_id").agg(F.count("*").alias("size")).withColumn("pval", (F.col("set_id") * 37 % 101) / 101.0)


@Q.add("en5_min_p_per_gene", using("r_sets") + _P + """ select gene, min(pval) as min_p, arg_min(set_id, struct_pack(a := pval, b := set_id)) as best_set, arg_min(size, struct_pack(a := pval, b := set_id)) as best_size, count(*) as n_sets,
 count(*) filter (size >= 20 and size < 35) as n_20_35, count(*) filter (size >= 35 and size < 200) as n_35_200 from r_sets join tp using (set_id) group by gene""")
def en5(spark, d):
    return E.min_p_per_gene(_tested(spark, d), role(spark, d, "r_sets"), "set_id", "gene", [20, 35, 200])


@Q.add("en6_overlay_p", using("r_sets") + _P + " select set_id, case when set_id % 4 = 0 then 0.5 else pval end as pval from tp")
def en6(spark, d):
    t = _tested(spark, d)
    return E.overlay_p(t, t.where("set_id % 4 = 0").withColumn("pval", F.lit(0.5)), ["set_id"]).select("set_id", "pval")


@Q.add("en7_matched_null_test", using("r_sets") + _P + """, m as (select gene, min(pval) as min_p, least(count(*), 3) as stratum from r_sets join tp using (set_id) group by gene),
 c as (select gene, min_p, a.stratum, (select count(*) from m b where b.stratum = a.stratum and b.gene % 50 <> 0 and b.min_p <= a.min_p) as n_le, (select count(*) from m b where b.stratum = a.stratum and b.gene % 50 <> 0) as pool from m a where gene % 50 = 0)
 select gene, stratum, n_le, pool, round((1 + n_le) / cast(1 + pool as double), 9) as p_matched, pool < 20 as small_pool from c""")
def en7(spark, d):
    rows = en5(spark, d).select("gene", "min_p", F.least("n_sets", F.lit(3)).alias("stratum"), (F.col("gene") % 50 == 0).alias("candidate"))
    out = E.matched_null_test(rows, "gene", "stratum", "min_p", "candidate")
    return out.select("gene", "stratum", "n_le", "pool", F.round("p_matched", 9).alias("p_matched"), "small_pool")


_FR = ", fr as (select c_custkey % 8 as donor, avg(c_acctbal) as frac from customer group by 1), pr as (select gene, donor, z, frac from r_z join fr using (donor))"


def _pairs(spark, d):
    fraction = role(spark, d, "customer").groupBy((F.col("c_custkey") % 8).cast("int").alias("donor")).agg(F.avg("c_acctbal").alias("frac"))
    return role(spark, d, "r_z").join(fraction, "donor")


@Q.add("en8_group_correlation", using("r_z") + _FR + " select gene, count(*) as n, case when count(*) >= 4 and stddev_samp(z) > 0 then round(corr(z, frac), 6) end as r from pr group by gene")
def en8(spark, d):
    return E.group_correlation(_pairs(spark, d), ["gene"], "z", "frac").select("gene", "n", F.round("r", 6).alias("r"))


@Q.add("en8_spearman", using("r_z") + _FR + """, k as (select gene, rank() over (partition by gene order by z) + (count(*) over (partition by gene, z) - 1) / 2.0 as a, rank() over (partition by gene order by frac) + (count(*) over (partition by gene, frac) - 1) / 2.0 as b from pr)
 select gene, count(*) as n, case when count(*) >= 4 and stddev_samp(a) > 0 then round(corr(a, b), 6) end as r from k group by gene""")
def en8b(spark, d):
    return E.group_correlation(_pairs(spark, d), ["gene"], "z", "frac", "spearman").select("gene", "n", F.round("r", 6).alias("r"))


@Q.add("en9_residual_z", using("r_z") + _FR + """, f as (select gene, regr_slope(z, frac) as sl, regr_intercept(z, frac) as ic from pr where donor <> 2 group by gene having count(*) >= 3), s as (select gene, stddev_samp(z - sl * frac - ic) as sd from pr join f using (gene) where donor <> 2 group by gene)
 select gene, round(z - sl * frac - ic, 4) as residual, case when sd > 0 then round((z - sl * frac - ic) / sd, 6) end as z from pr join f using (gene) join s using (gene) where donor = 2""")
def en9(spark, d):
    """Genes with three other donors or more: two lie on their line, and their spread is rounding alone."""
    pairs = _pairs(spark, d)
    enough = pairs.where("donor <> 2").groupBy("gene").agg(F.count("*").alias("n")).where("n >= 3").select("gene")
    return E.residual_z(pairs.join(enough, "gene", "left_semi"), "gene", "donor", "frac", "z", 2).select("gene", F.round("residual", 4).alias("residual"), F.round("z", 6).alias("z"))


@Q.add("en10_permutation_null", """with n as (select p_brand, sum(case when md5('3|' || p_partkey) < '8' then 1 else 0 end) as c from part group by 1), s as (select list(c order by c) as v, count(*) as k from n)
 select 40 as observed, round(len(list_filter(v, lambda x: x >= 40)) / cast(k as double), 9) as p, round(list_sum(v) / cast(k as double), 9) as mean, (v[13] + v[13]) / 2.0e0 as median, v[cast(floor(k * 0.95) as int)] as p95 from s""")
def en10(spark, d):
    null = role(spark, d, "part").groupBy("p_brand").agg(F.sum(F.when(R.seeded_order(3, "p_partkey") < "8", 1).otherwise(0)).alias("c"))
    return E.permutation_null(40, null, "c").select("observed", F.round("p", 9).alias("p"), F.round("mean", 9).alias("mean"), F.col("median").cast("double").alias("median"), "p95")


@Q.add("en10_shuffles", """select item_id as k, s as shuffle, string_agg(c, '' order by o) as seq from (select item_id, s, substr(text, i, 1) as c, md5('9|' || item_id || '|' || s || '|' || i) as o
 from benchmark, range(1, 4) t(s), range(1, 20000) u(i) where i <= length(text)) x group by 1, 2""")
def en10b(spark, d):
    return E.shuffled_sequences(role(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("seq")), "k", "seq", 3, 9)


@Q.add("en10_scored_shuffles", """with s as (select p_partkey as k, 0 as shuffle, p_brand as seq from part), c as (select p_partkey, sh, substr(p_brand, i, 1) as c, md5('5|' || p_partkey || '|' || sh || '|' || i) as o from part, range(1, 21) t(sh), range(1, 20) u(i) where i <= length(p_brand)),
 a as (select * from s union all select p_partkey, sh, string_agg(c, '' order by o) from c group by 1, 2), n as (select shuffle, count(*) filter (substr(seq, 1, 1) < 'B') as n from a group by 1), v as (select list(n order by n) as v from n where shuffle > 0)
 select o.n as observed, round((select count(*) from n x, n y where x.shuffle > 0 and y.shuffle = 0 and x.n >= y.n) / 20.0e0, 9) as p, list_sum(v) / 20.0e0 as mean, (v[10] + v[11]) / 2.0e0 as median, v[19] as p95 from v, n o where o.shuffle = 0""")
def en10c(spark, d):
    """Brands that begin before B, and in twenty shuffles of each."""
    rows = role(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("seq"))
    out = E.shuffle_test(rows, "k", "seq", lambda s: (F.substr(s, F.lit(1), F.lit(1)) < "B").cast("int"), 20, 5)
    return out.select("observed", F.round("p", 9).alias("p"), "mean", "median", "p95")


@Q.add("en11_composition_null", """with f as (select substr(p_type, 1, 1) as l, count(*) as n from part group by 1), c as (select l, sum(n) over (order by l) / cast(sum(n) over () as double) as c from f),
 u as (select k, i, cast('0x' || substr(md5('4|' || k || '|' || i), 1, 12) as bigint) / 281474976710656.0e0 as u from range((select count(*) from part)) t(k), range(1, 10) r(i)),
 g as (select k, i, arg_min(l, c) filter (c > u) as l from u, c group by 1, 2) select k, string_agg(l, '' order by i) as seq from g group by k""")
def en11(spark, d):
    f = role(spark, d, "part").groupBy(F.substring("p_type", 1, 1).alias("letter")).agg(F.count("*").alias("n"))
    return E.composition_null(f, "letter", "n", role(spark, d, "part").count(), 9, 4)


@Q.add("en12_taxa_recurrence", "select p_brand as organism, count(distinct p_size) as n_shuffles from part group by 1 order by 2 desc, 1 limit 12")
def en12(spark, d):
    return E.taxa_recurrence(role(spark, d, "part").withColumnRenamed("p_brand", "organism"), "organism", "p_size")


_MK = """, v as (select gene, sample % 3 as cls, avg(log2(cnt + 1)) as m from r_counts group by 1, 2), t as (select gene, list(struct_pack(m := m, cls := cls) order by m desc, cls desc)[1:2] as t from v group by gene),
 o as (select gene, t[1].cls as cls, t[1].m - coalesce(t[2].m, 0) as lead from t), mk as (select gene, cls, lead, row_number() over (partition by cls order by lead desc, gene) as place from o qualify place <= 10)"""


@Q.add("en13_marker_select", using("r_counts") + _MK + " select cls, place, round(lead, 6) as lead from mk")
def en13(spark, d):
    rows = role(spark, d, "r_counts").withColumn("cls", F.col("sample") % 3)
    return E.marker_select(rows, "gene", "cls", "cnt").select("cls", "place", F.round("lead", 6).alias("lead"))


@Q.add("en13_marker_purity", using("r_counts") + """, v as (select gene, sample % 3 as cls, avg(log2(cnt + 1)) as m from r_counts group by 1, 2), b as (select gene, max(m) as top from v group by gene),
 o as (select gene, list(cls) as cls from v join b using (gene) where m = top group by gene)
 select gene % 3 as cls, count(*) as n_markers, round(avg(case when len(o.cls) = 1 and list_contains(o.cls, gene % 3) then 1.0 else 0.0 end), 9) as highest from o group by 1""")
def en13b(spark, d):
    """Every gene as a marker of the class that its number names."""
    rows = role(spark, d, "r_counts").withColumn("cls", F.col("sample") % 3)
    markers = rows.select("gene", (F.col("gene") % 3).cast("int").alias("cls")).distinct()
    return E.marker_purity(markers, rows, "gene", "cls", "cnt").withColumn("highest", F.round("highest", 9))


@Q.add("en14_proportions", using("r_counts") + """, v as (select gene, sample % 3 as cls, avg(log2(cnt + 1)) as r from r_counts group by 1, 2),
 d as (select sample, cls, pow(2.0, avg(log2(cnt + 1) - r)) as e from r_counts join v using (gene) where gene % 3 = cls group by 1, 2) select sample, cls, round(e / sum(e) over (partition by sample), 6) as proportion from d""")
def en14(spark, d):
    rows = role(spark, d, "r_counts")
    markers = rows.select("gene", (F.col("gene") % 3).cast("int").alias("cls")).distinct()
    return E.proportions_closed_form(rows, rows.withColumn("cls", F.col("sample") % 3), markers, "sample", "gene", "cls", "cnt").withColumn("proportion", F.round("proportion", 6))
