"""Queries over ranks, windows and donor tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import ranking as R
from cohortlens.plans.roles import Catalogue, role, using

Q = Catalogue()


@Q.add("wn1_best_per_symbol", using("r_z") + ", t as (select donor, gene % 200 as symbol, gene, z, row_number() over (partition by donor, gene % 200 order by abs(z) desc, gene) as n from r_z) select donor, symbol, gene, z from t where n = 1")
def wn1(spark, d):
    return R.best_per_symbol(role(spark, d, "r_z").withColumn("symbol", F.col("gene") % 200).select("donor", "symbol", "gene", "z"), ["donor", "symbol"], "z", "gene")


@Q.add("wn2_rank_desc", using("r_stat") + " select donor, gene, cast(row_number() over (partition by donor order by stat desc, gene) as int) as rank from r_stat")
def wn2(spark, d):
    return R.rank_desc(role(spark, d, "r_stat"), "donor", "stat", "gene").select("donor", "gene", "rank")


@Q.add("wn3_combine_replicates", using("r_z") + """, t as (select donor % 4 as donor, gene, arg_min(z, struct_pack(a := abs(z), b := z)) as v, min(abs(z)) as lo, max(abs(z)) as hi, bool_or(z > 0) and bool_or(z < 0) as mixed from r_z group by 1, 2)
 select donor, gene, round(case when mixed then v * (1 - lo / hi) else v end, 6) as z from t""")
def wn3(spark, d):
    out = R.combine_replicates(role(spark, d, "r_z").withColumn("donor", F.col("donor") % 4), ["donor", "gene"], "z")
    return out.withColumn("z", F.round("z", 6))


@Q.add("wn3_median", using("r_z") + " select gene, round(median(z), 6) as z from r_z group by gene")
def wn3b(spark, d):
    return R.combine_replicates(role(spark, d, "r_z"), ["gene"], "z", "median").withColumn("z", F.round("z", 6))


_P = "select p_partkey as k, p_size % 7 as g, case when p_partkey % 17 <> 0 then (p_partkey * 7919 % 1000 + 1) / 1001.0e0 end as p from part"
_BH = "select k, {g}p, case when p is not null then round(least(1, min(raw) over ({w} order by p desc range between unbounded preceding and current row)), 9) end as padj from (select k, g, p, p * count(p) over ({w}) / count(p) over ({w} order by p range between unbounded preceding and current row) as raw from x) t"


@Q.add("wn4_bh_adjust", f"with x as ({_P}) " + _BH.format(g="", w=""))
def wn4(spark, d):
    role(spark, d, "part").createOrReplaceTempView("part")
    return R.bh_adjust(spark.sql(_P).drop("g"), "p").select("k", "p", F.round("padj", 9).alias("padj"))


@Q.add("wn4_bh_by_group", f"with x as ({_P}) " + _BH.format(g="g, ", w="partition by g"))
def wn4b(spark, d):
    role(spark, d, "part").createOrReplaceTempView("part")
    return R.bh_adjust(spark.sql(_P), "p", ["g"]).select("k", "g", "p", F.round("padj", 9).alias("padj"))


@Q.add("wn5_equal_frequency_bins", """select p_partkey as k, cast(floor((row_number() over (order by p_size, md5('7|' || p_partkey), p_partkey) - 1) * 10 / count(*) over ()) + 1 as int) as bin,
 round((rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0) / count(*) over (), 9) as percentile from part""")
def wn5(spark, d):
    out = R.equal_frequency_bins(role(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size"), "k", "p_size", 10, 7)
    return out.select("k", "bin", F.round("percentile", 9).alias("percentile"))


@Q.add("wn6_quantile_strata", """with b as (select list_distinct([quantile_cont(p_size, 0.0), quantile_cont(p_size, 0.25), quantile_cont(p_size, 0.5), quantile_cont(p_size, 0.75), quantile_cont(p_size, 1.0)]) as br from part),
 s as (select list_sort(br) as br from b) select p_partkey as k, cast(len(list_filter(br[2:len(br) - 1], lambda x: x < p_size * 1.1)) + 1 as int) as stratum from part, s""")
def wn6(spark, d):
    part = role(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("k"), (F.col("p_size") * 1.1).alias("v"))
    return R.quantile_strata(rows, R.quantile_breaks(part, "p_size", 4), "v").select("k", "stratum")


@Q.add("wn7_donor_specificity", using("r_z") + """, o as (select gene, z as own, case when z < 0 then -1 else 1 end as sg from r_z where donor = 2), t as (select r_z.gene, own * sg as own, z * sg as x from r_z join o using (gene) where donor <> 2)
 select gene, round(any_value(own), 6) as own, round(any_value(own) - max(x), 6) as gap, case when stddev_samp(x) > 0 then round((any_value(own) - avg(x)) / stddev_samp(x), 6) end as z, count(*) filter (x >= own) + 1 as rank, count(*) filter (x >= own) as n_as_extreme from t group by gene""")
def wn7(spark, d):
    out = R.donor_specificity(role(spark, d, "r_z"), "gene", "donor", "z", 2)
    return out.select("gene", *[F.round(c, 6).alias(c) for c in ("own", "gap", "z")], "rank", "n_as_extreme")


_DP = "select donor, gene, z, (gene * 31 + donor * 17) % 100 / 100.0e0 as padj from r_z"


@Q.add("wn8_specificity_counts", using("r_z") + f""", x as ({_DP}), o as (select gene, z as own, padj as own_p from x where donor = 2)
 select gene, count(*) filter (padj <= 0.05) as n_significant, count(*) filter (padj <= own_p) as n_better, round(min((own - z) * case when own < 0 then -1 else 1 end), 6) as gap from x join o using (gene) where donor <> 2 group by gene""")
def wn8(spark, d):
    rows = role(spark, d, "r_z").withColumn("padj", (F.col("gene") * 31 + F.col("donor") * 17) % 100 / 100.0)
    return R.specificity_counts(rows, "gene", "donor", "padj", "z", 2).withColumn("gap", F.round("gap", 6))


@Q.add("wn9_top_n_per_group", """with t as (select p_type as g, p_partkey as k, p_retailprice as v, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as place from part) select g, k, v, cast(place as int) as place from t where place <= case g when 'PROMO' then 5 when 'LARGE' then 3 end""")
def wn9(spark, d):
    rows = role(spark, d, "part").select(F.col("p_type").alias("g"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    n = rows.select("g").distinct().where("g in ('PROMO', 'LARGE')").withColumn("n", F.when(F.col("g") == "PROMO", 5).otherwise(3))
    return R.top_n_per_group(rows, "g", "v", "k", n)


@Q.add("wn9_positional", """with o as (select p_type as g, max(p_retailprice) as best from part group by 1), q as (select g, row_number() over (order by case g when 'SMALL' then 1 when 'PROMO' then 2 else 3 end, best desc, g) as m from o),
 t as (select p_type as g, p_partkey as k, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as place from part) select t.g, k, cast(place as int) as place from t join q on q.g = t.g where place <= case m when 1 then 4 when 2 then 2 when 3 then 7 end""")
def wn9b(spark, d):
    rows = role(spark, d, "part").select(F.col("p_type").alias("g"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    return R.top_n_per_group(rows, "g", "v", "k", [4, 2, 7], first=["SMALL", "PROMO"]).select("g", "k", "place")


@Q.add("wn10_top_up_down", using("r_z") + f""", x as ({_DP}), u as (select *, row_number() over (partition by donor, z > 0 order by padj, gene) as n from x where z <> 0)
 select donor, gene, cast(case when z > 0 then n else -n end as int) as place, case when z > 0 then 'up' else 'down' end as direction from u where n <= 12""")
def wn10(spark, d):
    rows = role(spark, d, "r_z").withColumn("padj", (F.col("gene") * 31 + F.col("donor") * 17) % 100 / 100.0)
    return R.top_up_down(rows, "donor", "z", "padj", "gene", 12).select("donor", "gene", "place", "direction")


@Q.add("wn10_with_candidate", using("r_z") + f""", x as ({_DP}), u as (select *, row_number() over (partition by donor, z > 0 order by padj, gene) as n from x where z <> 0 and padj < 0.05 and (gene % 4 = 1 or gene % 3 = 1))
 select donor, gene, cast(case when z > 0 then n else -n end as int) as place, case when z > 0 then 'up' else 'down' end as direction from u where n <= 12""")
def wn10b(spark, d):
    rows = role(spark, d, "r_z").withColumn("padj", (F.col("gene") * 31 + F.col("donor") * 17) % 100 / 100.0).withColumn("edge", F.array(F.col("gene") % 4, F.col("gene") % 3 + 10))
    return R.top_with_candidate(rows, "donor", "z", "padj", "gene", "edge", [1, 11]).select("donor", "gene", "place", "direction")


@Q.add("wn11_duplicate_columns", using("r_z") + """, v as (select donor, gene, z from r_z union all select donor + 100, gene, z from r_z where donor % 2 = 1 union all select donor + 200, gene, z + (case when gene % 7 = 0 then 0.5 else 0 end) from r_z where donor < 4),
 n as (select donor, count(*) as n from v group by donor)
 select a.donor as donor_a, b.donor as donor_b from v a join v b on a.gene = b.gene and a.donor < b.donor join n x on x.donor = a.donor join n y on y.donor = b.donor group by a.donor, b.donor, x.n, y.n having max(abs(a.z - b.z)) <= 1e-10 and count(*) = x.n and count(*) = y.n""")
def wn11(spark, d):
    """Half of the donors come twice; half have a copy that differs in some genes."""
    z = role(spark, d, "r_z")
    copies = z.where("donor % 2 = 1").select(F.col("donor") + 100, "gene", "z")
    others = z.where("donor < 4").select(F.col("donor") + 200, "gene", F.col("z") + F.when(F.col("gene") % 7 == 0, 0.5).otherwise(0.0))
    return R.duplicate_columns(z.select("donor", "gene", "z").union(copies).union(others), "donor", "gene", "z")


_TICK = """, k as (select donor, gene, stat, cast(row_number() over (partition by donor order by stat desc, gene) as int) as rank from r_stat),
 t as (select set_id, donor, gene, stat, rank, case when gene % 11 = 0 then 'highlight' when rank <= 300 then 'leading' else 'regular' end as category from r_sets join k using (gene))"""


def _ticks(spark, d):
    ranked = R.rank_desc(role(spark, d, "r_stat"), "donor", "stat", "gene")
    return R.tick_table(ranked, role(spark, d, "r_sets"), "gene", "stat", "rank", 0.5, F.col("rank") <= 300, F.col("gene") % 11 == 0)


@Q.add("wn12_tick_table", using("r_stat", "r_sets") + _TICK + " select set_id, donor, gene, rank, category, round(sqrt(stat), 6) as value from t")
def wn12(spark, d):
    return _ticks(spark, d).select("set_id", "donor", "gene", "rank", "category", F.round("value", 6).alias("value"))


@Q.add("wn12_goi_listing", using("r_stat", "r_sets") + _TICK + """, l as (select set_id * 10 + donor as panel, list(gene || case when rank <= 300 then '*' else '' end order by rank) as g from t where gene % 2 = 0 group by 1)
 select panel, array_to_string(g[1:8], ', ') || case when len(g) > 8 then ', ...' else '' end as genes from l""")
def wn12b(spark, d):
    """A panel for each set and donor; every second gene is of interest."""
    ticks = _ticks(spark, d).withColumn("panel", F.col("set_id") * 10 + F.col("donor"))
    return R.goi_listing(ticks.where("gene % 2 = 0"), "panel", "gene", "rank", F.col("rank") <= 300)


@Q.add("wn13_stratified_cap", "select g, k from (select p_brand as g, p_partkey as k, row_number() over (partition by p_brand order by md5('5|' || p_partkey), p_partkey) as n from part) t where n <= 20")
def wn13(spark, d):
    return R.stratified_cap(role(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("k")), "g", "k", 20, 5)
