"""Queries over annotated sites, calls, panels and counts (scalar functions, joins, aggregations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import scalar as S
from cohortlens.operators import aggregate as A, joins as J, variants as V
from cohortlens.plans.roles import Catalogue, role, using

Q = Catalogue()
_MAX = "greatest(case when af_a is null then af_b else af_a end, case when af_b is null then af_a else af_b end)"


#: The oracle's own statement of the rules: loss-of-function terms, and terms that alter a protein besides.
_LOF = "['stop_gained', 'frameshift_variant', 'splice_donor_variant', 'splice_acceptor_variant', 'start_lost', 'stop_lost', 'transcript_ablation']"
_ALTERING = f"list_concat({_LOF}, ['missense_variant', 'inframe_insertion', 'inframe_deletion', 'splice_region_variant', 'protein_altering_variant'])"
_TERMS, _SPLICE = "string_split(consequence, ',')", "coalesce(greatest(coalesce(s1, s2), coalesce(s2, s1)) >= 0.2, false)"
_LOSS = f"(list_has_any({_TERMS}, {_LOF}) and coalesce(lof = 'HC', false))"
_DAMAGING = f"(list_contains({_TERMS}, 'missense_variant') and coalesce(lower(am_class) = 'likely_pathogenic', false) or list_contains({_TERMS}, 'missense_variant') and (coalesce(score >= 0.564, false) or coalesce(try_cast(revel as double) >= 0.773, false)))"


@Q.add("tier_candidates", using("r_annot", "r_calls", "r_freq", "r_panel", "r_constraint") + f""",
af as (select site, {_MAX} as af from r_freq),
art as (select c.site from r_calls c left join af using (site) where sample % 2 = 0 group by c.site, af having sum(dosage) >= 6 and (af is null or af < 0.001)),
pan as (select distinct symbol from r_panel where confidence >= 2),
con as (select distinct symbol from r_constraint where loeuf < 0.6),
pick as (select symbol, arg_min(loeuf, ord) as loeuf from r_constraint where mane group by symbol)
select c.sample, c.site, a.symbol, c.dosage, pick.loeuf, a.symbol in (select symbol from pan) as in_panel,
 case when {_LOSS} or {_SPLICE} then 'A' when {_DAMAGING} and a.symbol in (select symbol from con) then 'B'
      when a.symbol in (select symbol from pan) and list_has_any({_TERMS}, {_ALTERING}) then 'C' else '' end as tier
from r_calls c join r_annot a using (site) left join af using (site) left join pick on a.symbol = pick.symbol
where (af is null or af < 0.001) and c.site not in (select site from art)""")
def tier_candidates(spark, d):
    return _tiered(spark, d)


def _tiered(spark, d, seen=lambda rows, stage: rows):
    """Rare candidates with their tier; ``seen`` is told the rows of each stage.

    Common and recurrent sites leave the calls before anything is joined to them.
    """
    freq = role(spark, d, "r_freq").select("site", S.row_max_ignore_null("af_a", "af_b").alias("af"))
    calls = role(spark, d, "r_calls")
    reps = calls.where("sample % 2 = 0").select("sample").distinct()
    artifacts = A.recurrent_artifacts(A.allele_counts(calls, reps, "site", "sample", "dosage"), freq, "site", "af", ac_min=6)
    rare = seen(J.drop_listed(seen(calls, "calls"), freq.where(~S.rare_or_absent("af")), ["site"]), "rare")
    rare = seen(J.drop_listed(rare, artifacts, ["site"]), "not recurrent")
    constraint = role(spark, d, "r_constraint")
    panel = A.gene_set(role(spark, d, "r_panel"), "symbol", F.col("confidence") >= 2).withColumn("in_panel", F.lit(True))
    constrained = A.constrained_set(constraint, "symbol", "loeuf").withColumn("constrained", F.lit(True))
    best = A.preferred_per_key(constraint, "symbol", ["mane", "canonical"], "ord")
    rows = J.join_on_key(rare, role(spark, d, "r_annot"), ["site"]).join(panel, "symbol", "left").join(constrained, "symbol", "left")
    rows = J.join_constraint(rows, best, "symbol", ["loeuf"]).withColumn("in_panel", F.coalesce("in_panel", F.lit(False)))
    tier = S.assign_tier([
        ("A", S.flag_lof("consequence", "lof") | S.flag_splice(S.row_max_ignore_null("s1", "s2"))),
        ("B", S.flag_damaging("consequence", F.coalesce("constrained", F.lit(False)), "am_class", "score", "revel")),
        ("C", F.col("in_panel") & S.any_term("consequence", S.PROTEIN_ALTERING_TERMS)),
    ])
    return seen(rows.select("sample", "site", "symbol", "dosage", "loeuf", "in_panel", tier.alias("tier")), "annotated")


@Q.add("ag8_tier_counts", "with t as (" + Q.oracles["tier_candidates"] + ") select tier, count(*) as n, count(distinct site) as n_sites from t group by tier")
def tier_counts(spark, d):
    return A.tier_counts(tier_candidates(spark, d), "tier", "site")


@Q.add("ag8_stage_counts", using("r_calls", "r_freq", "r_annot") + f""", af as (select site, {_MAX} as af from r_freq),
 art as (select c.site from r_calls c left join af using (site) where sample % 2 = 0 group by c.site, af having sum(dosage) >= 6 and (af is null or af < 0.001)),
 rare as (select * from r_calls where site not in (select site from af where af >= 0.001)), recur as (select * from rare where site not in (select site from art))
 select 'calls' as stage, count(*) as n from r_calls union all select 'rare', count(*) from rare union all select 'not recurrent', count(*) from recur
 union all select 'annotated', count(*) from recur join r_annot using (site)""")
def stage_counts(spark, d):
    counter = A.StageCounts()
    _tiered(spark, d, counter.seen).write.format("noop").mode("overwrite").save()
    return counter.table(spark)


@Q.add("prj1_variant_key", """select p_partkey as k, 'chr' || (p_partkey % 22 + 1) as chrom, cast(p_partkey * 7 as int) as pos,
 case when p_partkey % 2 = 0 then 'A' end as ref, case when p_partkey % 2 = 0 then 'G' end as alt from part""")
def prj1(spark, d):
    chrom = F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string"))
    pos = (F.col("p_partkey") * 7).cast("string")
    key = F.when(F.col("p_partkey") % 2 == 0, F.concat(chrom, F.lit("_"), pos, F.lit("_A/G"))).otherwise(F.concat(chrom, F.lit(":"), pos, F.lit("-"), pos))
    return role(spark, d, "part").select(F.col("p_partkey").alias("k"), S.parse_variant_key(key).alias("v")).select("k", "v.*")


@Q.add("prj2_row_max", using("r_freq") + f" select site, {_MAX} as af from r_freq")
def prj2(spark, d):
    return role(spark, d, "r_freq").select("site", S.row_max_ignore_null("af_a", "af_b").alias("af"))


@Q.add("prj3_allele_fraction", """select l_orderkey as o, l_linenumber as n, case when l_linenumber % 3 <> 0 and l_quantity > 10 then round(l_tax * 100 / (l_quantity - 10), 6) end as af from lineitem""")
def prj3(spark, d):
    ad = F.when(F.col("l_linenumber") % 3 != 0, F.concat_ws(",", F.lit("7"), (F.col("l_tax") * 100).cast("string"))).otherwise(F.lit("7"))
    return role(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.round(S.allele_fraction(ad, F.col("l_quantity") - 10), 6).alias("af"))


_GT = "case l_linenumber when 1 then '0/1' when 2 then '1|1' when 3 then '0/0' when 4 then './.' when 5 then './1' when 6 then '0|0' else '1/0' end"


@Q.add("prj4_5_genotypes", f"select gt, gt in ('0/1','1/0','1/1','0|1','1|0','1|1') as carries, gt not in ('0/0','./.','0|0','.|.') as not_ref, n from (select {_GT} as gt, count(*) as n from lineitem group by 1) t")
def prj4(spark, d):
    return role(spark, d, "lineitem").select(F.expr(_GT).alias("gt")).groupBy("gt").agg(F.count("*").alias("n")).select("gt", S.carries_alt("gt").alias("carries"), S.not_reference("gt").alias("not_ref"), "n")


@Q.add("prj6_rare_or_absent", using("r_freq") + " select site, (af_a is null or af_a < 0.001) as rare from r_freq")
def prj6(spark, d):
    return role(spark, d, "r_freq").select("site", S.rare_or_absent("af_a").alias("rare"))


_REF, _ALT = "case when p_size % 3 = 0 then 'AT' else 'A' end", "case p_size % 4 when 0 then 'G' when 1 then 'GT' when 2 then 'G,*' else 'C,CTT' end"


@Q.add("prj7_variant_class", f"""select k, case when s and i then 'MIXED' when i then 'INDEL' when s then 'SNP' end as kind from (select p_partkey as k,
 (({_REF}) = 'A' and p_size % 4 in (0, 2, 3)) or (({_REF}) = 'AT' and p_size % 4 = 1) as s,
 (({_REF}) = 'A' and p_size % 4 in (1, 3)) or (({_REF}) = 'AT' and p_size % 4 in (0, 2, 3)) as i from part) t""")
def prj7(spark, d):
    return role(spark, d, "part").select(F.col("p_partkey").alias("k"), S.variant_class(F.expr(_REF), F.expr(_ALT)).alias("kind"))


@Q.add("prj8_hard_filter", """select p_partkey as k, case when f = '' then 'PASS' else f end as filter from (select p_partkey, concat_ws(';',
 case when p_size % 10 < 2 then 'QD2' end, case when p_partkey % 5 <> 0 and p_size * 2 > 60 and p_partkey % 2 = 0 then 'FS60' end, case when p_partkey % 5 <> 0 and p_size * 5 > 200 and p_partkey % 2 = 1 then 'FS200' end,
 case when p_partkey % 2 = 0 and p_retailprice / 20 < 40 then 'MQ40' end) as f from part) t""")
def prj8(spark, d):
    none = F.lit(None).cast("double")
    rows = role(spark, d, "part").select(
        F.col("p_partkey").alias("k"), (F.col("p_size") % 10).alias("QD"), (F.col("p_retailprice") / 20).alias("MQ"), none.alias("MQRankSum"), none.alias("ReadPosRankSum"), none.alias("SOR"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") * F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(5)).alias("FS"), F.when(F.col("p_partkey") % 2 == 0, "SNP").otherwise("INDEL").alias("kind"))
    return rows.select("k", S.hard_filter("kind").alias("filter"))


@Q.add("prj9_split_trim", """select p_partkey as k, i, case when i = 1 then p_partkey + p_size % 4 else p_partkey end as pos, case when i = 1 then 'G' else 'CATG' end as ref,
 case i when 1 then 'T' else '*' end as alt from (select p_partkey, p_size, unnest([1, 2]) as i from part where p_size % 4 = 3) t
 union all select p_partkey, 1, p_partkey + 1, 'AC', 'G' from part where p_size % 4 = 1
 union all select p_partkey, 1, p_partkey + 1, 'T', 'TA' from part where p_size % 2 = 0""")
def prj9(spark, d):
    kind = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("p_size") % 4 + 1).cast("int"))
    rows = role(spark, d, "part").select(F.col("p_partkey").alias("k"), kind("TTA", "CACT", "TTA", "CATG").alias("ref"), kind("TTAA", "CGT", "TTAA", "CATT,*").alias("alts"))
    one = rows.select("k", "ref", F.posexplode(F.split("alts", ",")).alias("i", "alt"))
    return one.select("k", (F.col("i") + 1).alias("i"), S.trim_alleles(F.col("k"), "ref", "alt").alias("t")).select("k", "i", "t.*")


_PL = "(select string_agg(cast(p_partkey + 10 * j + 100 * k as varchar), ',' order by k, j) from (values (0, 0), (0, i), (i, i)) g(j, k))"


@Q.add("prj9_split_multiallelic", f"""with t as (select p_partkey, p_size, unnest([1, 2, 3]) as i from part)
 select p_partkey as k, i as allele, p_partkey + (case i when 1 then 3 when 2 then 1 else 0 end) as pos, case i when 1 then 'G' when 2 then 'ATG' else 'CATG' end as ref, case i when 1 then 'T' when 2 then 'A' else '*' end as alt,
  cast(p_size + i as varchar) as ac, '1,' || (i + 1) as r, {_PL} as pl, '5,' || (5 + i) as haploid, '.' as missing, 'kept,whole' as other,
  case p_size % 4 when 0 then (case i when 1 then '1' else '0' end) || '/' || (case i when 2 then '1' else '0' end) when 1 then '0|' || (case i when 3 then '1' else '0' end) when 2 then './.' else (case i when 2 then '1' else '0' end) end as gt
 from t""")
def prj9_all(spark, d):
    """Every part as a site with three alternates: fields with a value an alternate, an allele and a genotype, and phased, missing and haploid calls."""
    text = lambda c: c.cast("string")
    k, size = F.col("p_partkey"), F.col("p_size")
    genotypes = [(j, i) for i in range(4) for j in range(i + 1)]
    info = {"AC": F.concat_ws(",", *[text(size + i) for i in (1, 2, 3)]), "NOTE": F.lit("kept,whole")}
    call = {"GT": F.element_at(F.array(*map(F.lit, ("1/2", "0|3", "./.", "2"))), (size % 4 + 1).cast("int")), "AD": F.lit("1,2,3,4"), "PL": F.concat_ws(",", *[text(k + 10 * j + 100 * i) for j, i in genotypes]), "HL": F.lit("5,6,7,8"), "GL": F.lit(".")}
    as_map = lambda m: F.create_map(*[x for key, v in m.items() for x in (F.lit(key), v)])
    sites = role(spark, d, "part").select(k.alias("k"), k.alias("pos"), F.lit("CATG").alias("ref"), F.lit("CATT,CA,*").alias("alt"), as_map(info).alias("info"), as_map(call).alias("call"))
    out = V.split_multiallelic(sites, info="info", calls=["call"], info_numbers={"AC": "A", "NOTE": "A"}, call_numbers={"AD": "R", "PL": "G", "HL": "G", "GL": "G"})
    field = lambda m, key, name: F.col(m)[key].alias(name)
    return out.select("k", "allele", "pos", "ref", "alt", field("info", "AC", "ac"), field("call", "AD", "r"), field("call", "PL", "pl"), field("call", "HL", "haploid"), field("call", "GL", "missing"), field("info", "NOTE", "other"), field("call", "GT", "gt"))


@Q.add("prj11_12_flags", using("r_annot") + f""" select site, {_LOSS} as is_lof, {_SPLICE} as is_splice, {_DAMAGING} as is_damaging,
 list_has_any({_TERMS}, {_ALTERING}) as is_altering from r_annot""")
def prj11(spark, d):
    splice = S.row_max_ignore_null("s1", "s2")
    return role(spark, d, "r_annot").select("site", S.flag_lof("consequence", "lof").alias("is_lof"), S.flag_splice(splice).alias("is_splice"), S.flag_damaging("consequence", F.lit(True), "am_class", "score", "revel").alias("is_damaging"), S.any_term("consequence", S.PROTEIN_ALTERING_TERMS).alias("is_altering"))


@Q.add("prj14_15_columns", using("r_annot") + " select symbol as gene, site, round(coalesce(s1, 0), 2) as ds_ag, lof, score, consequence from r_annot")
def prj14(spark, d):
    rows = role(spark, d, "r_annot").withColumn("s1", F.round(F.coalesce("s1", F.lit(0.0)), 2)).drop("s2", "am_class", "revel")
    found = S.resolve_column(rows.columns, ["SYMBOL", "gene_symbol"])
    order = S.ordered_columns(rows.columns, {found: "gene", "s1": "ds_ag"}, [["gene"], ["site"], ["ds_ag"]], last=["consequence"])
    return rows.select(*[F.col(old).alias(new) for old, new in order])


@Q.add("prj16_strip_version", "select p_partkey as k, 'ENSG' || p_partkey as id from part")
def prj16(spark, d):
    return role(spark, d, "part").select(F.col("p_partkey").alias("k"), S.strip_version(F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string"))).alias("id"))


@Q.add("prj17_filter_reads", using("r_reads") + " select sample, contig, count(*) as n from r_reads where mapq >= 30 and flag & 3332 = 0 group by sample, contig")
def prj17(spark, d):
    return role(spark, d, "r_reads").where(S.passes_read_filter("flag", "mapq", 30, 3332)).groupBy("sample", "contig").agg(F.count("*").alias("n"))


@Q.add("prj19_two_field_pair", """select c_custkey as k, case when c_custkey % 3 = 0 then ['A*01:01', 'A*01:01'] when c_custkey % 3 = 1 then ['A*02:05', 'A*24:02'] end as pair from customer""")
def prj19(spark, d):
    calls = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("A*01:01:02"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("A*24:02:01:01"), F.lit("A*02:05"))).otherwise(F.array().cast("array<string>"))
    return role(spark, d, "customer").select(F.col("c_custkey").alias("k"), S.two_field_pair(calls).alias("pair"))


@Q.add("prj21_22_classify", """select c_custkey as k, case when c_mktsegment like '%A%' and c_mktsegment like 'A%' then 'auto' when c_mktsegment like '%B%' then 'build' end as grp,
 case c_nationkey % 4 when 0 then 'male' when 1 then 'female' else 'unknown' end as sex from customer""")
def prj21(spark, d):
    sex = F.element_at(F.array(F.lit(" M "), F.lit("Female"), F.lit("?"), F.lit(None)), F.col("c_nationkey") % 4 + 1)
    return role(spark, d, "customer").select(F.col("c_custkey").alias("k"), S.classify_by_pattern("c_mktsegment", [("^A", "auto"), ("B", "build")]).alias("grp"), S.normalise_sex(sex).alias("sex"))


@Q.add("prj23_prefix_contigs", """select 'chr' || (p_size % 23) as contig, cast(p_partkey as int) as pos, count(*) as n from part where p_partkey % 7 <> 0 group by 1, 2""")
def prj23(spark, d):
    raw = role(spark, d, "part").select((F.col("p_size") % 23).cast("string").alias("contig"), F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.col("p_partkey").cast("string")).alias("pos"))
    return J.prefix_contigs(raw, "contig", "pos").groupBy("contig", "pos").agg(F.count("*").alias("n"))


@Q.add("prj24_project_info", """with t as (select p_partkey as k, 'AF' as field, cast(p_size / 100.0 as varchar) as value from part where p_size % 2 = 0 union all select p_partkey, 'AN', cast(p_size * 2 as varchar) from part)
 select k, field, value, cast(k % 2 as int) as contig_order from t""")
def prj24(spark, d):
    info = F.concat_ws(";", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("AF="), (F.col("p_size") / 100.0).cast("string"))), F.concat(F.lit("AN="), (F.col("p_size") * 2).cast("string")), F.lit("DB=1"))
    rows = role(spark, d, "part").select(F.col("p_partkey").alias("k"), F.str_to_map(info, F.lit(";"), F.lit("=")).alias("info"))
    contigs = [rows.where(F.col("k") % 2 == i) for i in range(2)]
    return J.project_info(contigs, "info", ["AF", "AN"]).select("k", F.explode("info").alias("field", "value"), "contig_order")


@Q.add("prj26_last_bracket", "select p_partkey as k, case when p_partkey % 3 = 0 then 'unknown' else p_type end as org from part")
def prj26(spark, d):
    title = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("x [a] "), F.lit("["), F.col("p_type"), F.lit("]")))
    return role(spark, d, "part").select(F.col("p_partkey").alias("k"), S.last_bracket(title).alias("org"))


@Q.add("jn1_join_on_key", using("r_annot", "r_calls") + " select site, symbol, sample, dosage from r_annot join r_calls using (site)")
def jn1(spark, d):
    return J.join_on_key(role(spark, d, "r_annot"), role(spark, d, "r_calls"), ["site"]).select("site", "symbol", "sample", "dosage")


@Q.add("jn2_drop_listed", using("r_annot", "r_calls") + " select sample, site from r_calls where site not in (select site from r_annot where lof = 'LC')")
def jn2(spark, d):
    return J.drop_listed(role(spark, d, "r_calls"), role(spark, d, "r_annot").where("lof = 'LC'"), ["site"]).select("sample", "site")


@Q.add("jn3_annotate_exact", using("r_calls", "r_freq") + " select sample, site, af_a as gn_af_a, af_b as gn_af_b from r_calls left join r_freq using (site)")
def jn3(spark, d):
    return J.annotate_exact(role(spark, d, "r_calls"), role(spark, d, "r_freq"), ["site"], ["af_a", "af_b"], "gn_").drop("dosage")


@Q.add("jn4_annotate_by_symbol", using("r_annot", "r_panel") + """, f as (select symbol, min(ord) as ord, max(confidence) as top from r_panel where confidence >= 3 group by symbol)
 select site, a.symbol, f.ord as ndd_ord, f.top as ndd_top, f.symbol is not null as in_ndd from r_annot a left join f on a.symbol = f.symbol""")
def jn4(spark, d):
    panel = role(spark, d, "r_panel").where("confidence >= 3").groupBy("symbol").agg(F.min("ord").alias("ord"), F.max("confidence").alias("top"))
    return J.annotate_by_symbol(role(spark, d, "r_annot").select("site", "symbol"), {"ndd": panel}, "symbol")


@Q.add("jn5_ag2_constraint", using("r_annot", "r_constraint") + ", m as (select symbol, arg_min(loeuf, ord) as loeuf from r_constraint where mane group by symbol) select site, symbol, m.loeuf from r_annot left join m using (symbol)")
def jn5(spark, d):
    best = A.preferred_per_key(role(spark, d, "r_constraint"), "symbol", ["mane", "canonical"], "ord")
    return J.join_constraint(role(spark, d, "r_annot").select("site", "symbol"), best, "symbol", ["loeuf"])


@Q.add("ag5_constrained_set", using("r_constraint") + " select distinct symbol from r_constraint where loeuf < 0.6")
def ag5(spark, d):
    return A.constrained_set(role(spark, d, "r_constraint"), "symbol", "loeuf")


@Q.add("ag5_panel_instead", using("r_panel") + " select distinct symbol from r_panel")
def ag5b(spark, d):
    """An empty constraint table: the panel's symbols count as constrained."""
    return A.constrained_set(role(spark, d, "r_constraint").where("false"), "symbol", "loeuf", panel=role(spark, d, "r_panel"))


@Q.add("jn6_ag1_ag3_annotations", using("r_panel") + """, f as (select symbol, arg_min(confidence, ord) as first_confidence from r_panel group by symbol),
 v as (select symbol, cast(confidence as varchar) as c, min(ord) as o from r_panel group by symbol, confidence),
 k as (select symbol, string_agg(c, '; ' order by o) as confidences from v group by symbol)
 select symbol, first_confidence, confidences from f full outer join k using (symbol)""")
def jn6(spark, d):
    panel = role(spark, d, "r_panel")
    first = A.first_per_key(panel, ["symbol"], "ord").select("symbol", F.col("confidence").alias("first_confidence"))
    rest = A.concat_unique(panel.withColumn("confidences", F.col("confidence").cast("string")), "symbol", ["confidences"], "ord")
    return J.full_outer_annotations(first, rest, "symbol")


@Q.add("jn7_map_ids", """with m as (select p_partkey % 50 as g, arg_min(p_brand, p_partkey) as symbol from part where p_partkey % 3 > 0 and p_partkey % 50 < 40 group by 1)
 select s_suppkey as k, coalesce(symbol, 'G' || (s_suppkey % 50) || '.' || s_nationkey) as symbol from supplier left join m on g = s_suppkey % 50""")
def jn7(spark, d):
    rows = role(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("G"), (F.col("s_suppkey") % 50).cast("string"), F.lit("."), F.col("s_nationkey").cast("string")).alias("gene_id"))
    names = role(spark, d, "part").where("p_partkey % 3 > 0 and p_partkey % 50 < 40").select(F.concat(F.lit("G"), (F.col("p_partkey") % 50).cast("string"), F.lit(".9")).alias("gene_id"), F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("ord"))
    return J.map_ids(rows, names, "gene_id", "symbol", "ord").select("k", "symbol")


@Q.add("jn8_align_to_order", using("r_counts") + """, own as (select gene, arg_min(cnt, ord) as cnt from (select gene, cnt, gene * 2 as ord from r_counts where sample = 3 union all select gene, cnt + 100, gene * 2 + (case when gene % 3 = 0 then -1 else 1 end) from r_counts where sample = 3 and gene % 2 = 0) t group by gene)
 select p_partkey as ord, p_partkey as gene, coalesce(cnt, 0) as cnt from part left join own on gene = p_partkey""")
def jn8(spark, d):
    """Half of the genes come in two versions, of which the one in the earlier row counts, not the one with the smaller id."""
    counts = role(spark, d, "r_counts").where("sample = 3")
    plain = counts.select(F.concat(F.col("gene").cast("string"), F.lit(".9")).alias("id"), "cnt", (F.col("gene") * 2).alias("row"))
    second = counts.where("gene % 2 = 0").select(F.concat(F.col("gene").cast("string"), F.lit(".10")).alias("id"), F.col("cnt") + 100, F.col("gene") * 2 + F.when(F.col("gene") % 3 == 0, -1).otherwise(1))
    reference = role(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.col("p_partkey").cast("string"), F.lit(".2")).alias("id"))
    out = J.align_to_order(plain.union(second), reference, "id", "cnt", "ord", first="row")
    return out.select("ord", F.split("id", r"\.")[0].cast("long").alias("gene"), "cnt")


@Q.add("jn8_overlap_counts", using("r_counts") + """ select count(*) filter (a is not null and b is not null) as both, count(*) filter (b is null) as only_left, count(*) filter (a is null) as only_right,
 count(*) filter (a is not null and b is not null) < 0.5 * count(*) filter (b is not null) as low from (select distinct gene as a from r_counts where sample = 3) x full outer join (select p_partkey as b from part where p_size < 30) y on a = b""")
def jn8b(spark, d):
    return J.overlap_counts(role(spark, d, "r_counts").where("sample = 3"), role(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("gene")), "gene")


@Q.add("jn11_lookup_default", using("r_hits") + " select sample, case prim when 'click' then 'mouse' when 'view' then 'rat' else 'unknown' end as species, count(*) as n from r_hits group by 1, 2")
def jn11(spark, d):
    """The mapping names each contig twice; the first name counts."""
    named = role(spark, d, "events").where("event_type in ('click', 'view')").select(F.col("event_type").alias("prim"), F.when(F.col("event_type") == "click", "mouse").otherwise("rat").alias("species")).distinct()
    mapping = named.withColumn("ord", F.lit(1)).unionByName(named.select("prim", F.lit("another").alias("species"), F.lit(2).alias("ord")))
    return J.lookup_default(role(spark, d, "r_hits"), mapping, "prim", "species", order="ord").groupBy("sample", "species").agg(F.count("*").alias("n"))


@Q.add("jn12_shared_keys", using("r_counts", "r_sets") + " select distinct gene from r_counts where gene in (select gene from r_sets)")
def jn12(spark, d):
    return J.shared_keys(role(spark, d, "r_counts"), role(spark, d, "r_sets"), "gene", least=1)


@Q.add("jn13_evidence_pairs", using("r_sets") + """, c as (select distinct gene from r_sets where gene % 10 = 0), l as (select set_id, gene from r_sets where set_id % 2 = 0)
 select gene, set_id, case when set_id % 2 = 0 then 'leading_edge' else 'pathway' end as evidence from r_sets where gene % 10 = 0""")
def jn13(spark, d):
    sets = role(spark, d, "r_sets")
    return J.evidence_pairs(sets.where("gene % 10 = 0").select("gene").distinct(), sets, sets.where("set_id % 2 = 0"), "gene", "set_id")


@Q.add("jn14_cohort_matrix", using("r_calls") + " select site, sample, coalesce(dosage, -1) as dosage from (select distinct site from r_calls) s cross join (select distinct sample from r_calls) p left join r_calls using (site, sample)")
def jn14(spark, d):
    calls = role(spark, d, "r_calls")
    return J.cohort_matrix(calls, calls, ["site"], "sample", "dosage", -1)


@Q.add("ag4_gene_set", using("r_panel") + " select distinct symbol from r_panel where confidence >= 3")
def ag4(spark, d):
    return A.gene_set(role(spark, d, "r_panel"), "symbol", F.col("confidence") >= 3)


@Q.add("ag6_allele_counts", using("r_calls") + " select site, sum(dosage) as ac, 2 * count(*) as an from r_calls where sample % 2 = 0 group by site")
def ag6(spark, d):
    calls = role(spark, d, "r_calls")
    return A.allele_counts(calls, calls.where("sample % 2 = 0"), "site", "sample", "dosage")


@Q.add("ag7_recurrent_artifacts", using("r_calls", "r_freq") + f""" select site, ac, an from (select site, sum(dosage) as ac, 2 * count(*) as an from r_calls where sample % 2 = 0 group by site) t
 left join (select site, {_MAX} as af from r_freq) f using (site) where ac >= 2 and (af is null or af < 0.001)""")
def ag7(spark, d):
    calls = role(spark, d, "r_calls")
    return A.recurrent_artifacts(A.allele_counts(calls, calls.where("sample % 2 = 0"), "site", "sample", "dosage"), prj2(spark, d), "site", "af")


_SYM = "select sample, p_brand as symbol, cast(sum(cnt) as bigint) as cnt from r_counts join part on gene = p_partkey where p_size > 5 group by sample, p_brand"


@Q.add("ag9_sum_duplicates", using("r_counts") + " " + _SYM)
def ag9(spark, d):
    names = role(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("symbol"))
    return A.sum_duplicates(role(spark, d, "r_counts").join(names, "gene"), "sample", "symbol", "cnt")


@Q.add("ag10_cpm", using("r_counts") + f", t as ({_SYM}) select sample, symbol, round(cnt * 1e6 / sum(cnt) over (partition by sample), 6) as cpm, round(log2(cnt * 1e6 / sum(cnt) over (partition by sample) + 1), 6) as log2cpm from t")
def ag10(spark, d):
    return A.cpm(ag9(spark, d), "sample", "cnt").select("sample", "symbol", F.round("cpm", 6).alias("cpm"), F.round("log2cpm", 6).alias("log2cpm"))


@Q.add("ag11_pseudobulk", using("r_counts") + """ select gene, sample % 6 as subject, sample % 2 as cls, sum(cnt) as cnt, round(sum(cnt) * 1e6 / sum(sum(cnt)) over (partition by sample % 6, sample % 2), 6) as cpm from r_counts group by 1, 2, 3""")
def ag11(spark, d):
    cells = role(spark, d, "r_counts").withColumn("subject", F.col("sample") % 6).withColumn("cls", F.col("sample") % 2)
    return A.pseudobulk(cells, "gene", "subject", "cls", "cnt").withColumn("cpm", F.round("cpm", 6))


@Q.add("ag12_specificity", using("r_counts") + """, w as (select gene, coalesce(sum(cnt) filter (sample % 3 = 0), 0) as a, coalesce(sum(cnt) filter (sample % 3 = 1), 0) as b, coalesce(sum(cnt) filter (sample % 3 = 2), 0) as c from r_counts group by gene)
 select gene, round((3 - (a + b + c) / cast(greatest(a, b, c) as double)) / 2, 6) as tau, case greatest(a, b, c) when a then 'c0' when b then 'c1' else 'c2' end as dominant from w""")
def ag12(spark, d):
    rows = role(spark, d, "r_counts").withColumn("cls", F.concat(F.lit("c"), (F.col("sample") % 3).cast("string")))
    return A.specificity(rows, "gene", "cls", "cnt", ["c0", "c1", "c2"]).withColumn("tau", F.round("tau", 6))


@Q.add("ag12_two_classes", """select p_partkey % 300 as gene, case when a >= b then 'a' else 'b' end as higher_in, round(log2((a + 1) / cast(b + 1 as double)), 6) as log2_ratio
 from (select p_partkey % 300 as p_partkey, cast(count(*) filter (p_size % 2 = 0) as bigint) as a, cast(count(*) filter (p_size % 2 = 1) as bigint) as b from part group by 1) t""")
def ag12b(spark, d):
    """Few parts a gene, so that classes are equal now and then."""
    rows = role(spark, d, "part").select((F.col("p_partkey") % 300).alias("gene"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("cls"), F.lit(1).alias("x"))
    return A.specificity(rows, "gene", "cls", "x", ["a", "b"]).select("gene", "higher_in", F.round("log2_ratio", 6).alias("log2_ratio"))


@Q.add("ag13_group_expression", using("r_counts") + """ select p_type as grp, count(*) as n, round(avg(coalesce(cnt, 0)), 6) as mean, count(*) filter (cnt > 0) as n_pos, round(100.0 * count(*) filter (cnt > 0) / count(*), 6) as pct_pos
 from part left join (select gene, cnt from r_counts where sample = 1) t on gene = p_partkey group by p_type""")
def ag13(spark, d):
    cells = role(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("grp"))
    out = A.group_expression(cells, role(spark, d, "r_counts").where("sample = 1"), "gene", ["grp"], "cnt")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("pct_pos", F.round("pct_pos", 6))


_ATT = """, x as (select sample, prim as contig from r_hits union all select sample, a as contig from (select sample, prim, unnest(string_split(alts, ';')) as a from r_hits) t where a <> '' and a <> prim),
 n as (select sample, contig, count(*) as n from x group by 1, 2)"""


@Q.add("ag14_attribute_alignments", using("r_hits") + _ATT + " select * from n")
def ag14(spark, d):
    return A.attribute_alignments(role(spark, d, "r_hits"), "sample", "prim", "alts")


@Q.add("ag15_wide_summary", using("r_hits") + _ATT + """ select s.sample, sum(n) filter (contig = 'view') as view, sum(n) filter (contig = 'none') as none, sum(n) filter (contig = 'click') as click, sum(n) filter (contig = 'other') as other,
 sum(n) filter (contig = 'purchase') as purchase, sum(n) filter (contig = 'signup') as signup, sum(n) filter (contig = 'error') as unknown from (select distinct o_custkey % 24 as sample from orders) s left join n on n.sample = s.sample group by s.sample""")
def ag15(spark, d):
    samples = role(spark, d, "orders").select((F.col("o_custkey") % 24).alias("sample"))
    counts = ag14(spark, d).withColumn("contig", F.when(F.col("contig") == "error", "unknown").otherwise(F.col("contig")))
    return A.wide_summary(counts, samples, "sample", "contig", "n", ["view", "none"])


@Q.add("ag16_fractions", using("r_hits") + _ATT + ", t as (select sample, case when sample % 5 = 0 then 0 else count(*) end as total from r_hits group by sample) select sample, contig, case when total > 0 then round(n / cast(total as double), 6) end as fraction from n left join t using (sample)")
def ag16(spark, d):
    totals = role(spark, d, "r_hits").groupBy("sample").agg(F.count("*").alias("t")).select("sample", F.when(F.col("sample") % 5 == 0, 0).otherwise(F.col("t")).alias("total"))
    return A.fractions(ag14(spark, d), totals, "sample", "n", "total").select("sample", "contig", "fraction")


@Q.add("ag21_sex_markers", using("r_counts") + """, m as (select sample, coalesce(sum(cnt) filter (gene % 97 = 1), 0) * 1e6 / sum(cnt) as x, coalesce(sum(cnt) filter (gene % 101 = 2), 0) * 1e6 / sum(cnt) as y from r_counts group by sample)
 select sample, case when x >= 10500 and not y >= 9800 then 'XX' when y >= 9800 and not x >= 10500 then 'XY' when x >= 10500 and y >= 9800 then 'ambiguous_possible_XXY' else 'ambiguous_low_signal' end as sex from m""")
def ag21(spark, d):
    m = role(spark, d, "r_counts").groupBy("sample").agg((F.sum(F.when(F.col("gene") % 97 == 1, F.col("cnt"))) * 1e6 / F.sum("cnt")).alias("x"), (F.sum(F.when(F.col("gene") % 101 == 2, F.col("cnt"))) * 1e6 / F.sum("cnt")).alias("y"))
    return m.select("sample", A.sex_from_markers("x", "y", 10500, 9800).alias("sex"))


@Q.add("ag21_sex_concordance", "with t as (" + Q.oracles["ag21_sex_markers"] + """), r as (select sample, sex, case sample % 4 when 0 then 'male' when 1 then 'female' when 2 then 'unknown' end as reported from t) select sample, sex, reported,
 case when coalesce(reported, 'unknown') = 'unknown' then 'no_reported_sex' when sex not in ('XX', 'XY') then 'check_aneuploidy' when (sex = 'XX') = (reported = 'female') then 'concordant' else 'DISCORDANT' end as concordance from r""")
def ag21b(spark, d):
    reported = F.element_at(F.array(F.lit("male"), F.lit("female"), F.lit("unknown"), F.lit(None)), (F.col("sample") % 4 + 1).cast("int"))
    return ag21(spark, d).withColumn("reported", reported).withColumn("concordance", A.sex_concordance("sex", "reported"))


@Q.add("ag22_marker_expression", using("r_counts") + """, p as (select p_partkey as gene, p_partkey as ord from part where p_partkey % 100 = 7), l as (select sample, sum(cnt) as lib from r_counts group by sample)
 select l.sample, ord, p.gene, coalesce(cnt, 0) as cnt, round(coalesce(cnt, 0) * 1e6 / lib, 6) as cpm, round(log2(coalesce(cnt, 0) * 1e6 / lib + 1), 6) as log2cpm from l cross join p left join r_counts c on c.sample = l.sample and c.gene = p.gene""")
def ag22(spark, d):
    panel = role(spark, d, "part").where("p_partkey % 100 = 7").select(F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("ord"))
    out = A.marker_expression(role(spark, d, "r_counts"), panel, "sample", "gene", "cnt", "ord")
    return out.withColumn("cpm", F.round("cpm", 6)).withColumn("log2cpm", F.round("log2cpm", 6))


@Q.add("ag23_panel_scores", using("r_counts") + """, v as (select gene, sample % 2 as region, sample as donor, cnt, count(cnt) over w as k, avg(cnt) over w as m, stddev_samp(cnt) over w as sd from r_counts window w as (partition by sample % 2, gene))
 select donor, region, p_type as panel, round(avg((cnt - m) / sd), 6) as score from v join part on gene = p_partkey where k >= 3 and sd > 0 group by 1, 2, 3""")
def ag23(spark, d):
    return _panel_scores(spark, d).withColumn("score", F.round("score", 6))


def _panel_scores(spark, d):
    values = role(spark, d, "r_counts").select("gene", (F.col("sample") % 2).alias("region"), F.col("sample").alias("donor"), "cnt")
    panel = role(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("panel"))
    return A.panel_scores(values, panel, "gene", "region", "donor", "cnt", "panel")


@Q.add("ag23_panel_contrast", "with s as (" + Q.oracles["ag23_panel_scores"].replace("round(avg((cnt - m) / sd), 6)", "avg((cnt - m) / sd)") + """), w as (select donor, region, max(score) filter (panel = 'PROMO') as n, max(score) filter (panel = 'SMALL') as a, max(score) filter (panel = 'LARGE') as b from s group by 1, 2)
 select donor, region, round(n, 6) as "PROMO", round(a, 6) as "SMALL", round(b, 6) as "LARGE", round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a is not null)::int + (b is not null)::int, 0), 6) as glia, round(n - (coalesce(a, 0) + coalesce(b, 0)) / nullif((a is not null)::int + (b is not null)::int, 0), 6) as neuron_minus_glia from w""")
def ag23b(spark, d):
    out = A.panel_contrast(_panel_scores(spark, d), "donor", "region", "panel", "score", "PROMO", ["SMALL", "LARGE"])
    return out.withColumns({c: F.round(c, 6) for c in ("PROMO", "SMALL", "LARGE", "glia", "neuron_minus_glia")})


@Q.add("ag24_qc_flags", using("r_qc") + ", a as (select median(m2) as m from r_qc), b as (select median(abs(m2 - m)) as dv from r_qc, a) select sample, n, m2 > m + 3 * dv as high from r_qc, a, b")
def ag24(spark, d):
    return A.qc_flags(role(spark, d, "r_qc"), "m2").select("sample", "n", "high")


@Q.add("ag24_threshold_flags", """select p_partkey as k, p_size / 100.0e0 > 0.10 as high_rrna, case when p_partkey % 5 > 0 then p_size / 50.0e0 < 0.60 end as low_mrna, p_retailprice * 10000 < 10000000 as low_unique_reads,
 p_size / 1000.0e0 > 0.01 as high_contamination, case when p_partkey % 3 > 0 then p_size / 10000.0e0 > 0.001 end as high_species from part""")
def ag24b(spark, d):
    text = lambda c, test: F.when(test, c.cast("string")).otherwise("NA")
    rows = role(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 100.0).alias("rrna"), text(F.col("p_size") / 50.0, F.col("p_partkey") % 5 > 0).alias("mrna"), (F.col("p_retailprice") * 10000).alias("unique_reads"),
                                         (F.col("p_size") / 1000.0).alias("contamination_pct"), text(F.col("p_size") / 10000.0, F.col("p_partkey") % 3 > 0).alias("species_pct"))
    return A.threshold_flags(rows).select("k", *[flag for flag, *_ in A.QC_LIMITS])


@Q.add("ag25_fraction_summary", "select l_returnflag as region, round(coalesce(avg(l_discount) filter (l_linestatus = 'F'), 0), 6) as F, round(coalesce(avg(l_discount) filter (l_linestatus = 'O'), 0), 6) as O, round(coalesce(avg(l_discount) filter (l_linestatus = 'Z'), 0), 6) as Z from lineitem group by 1")
def ag25(spark, d):
    out = A.fraction_summary(role(spark, d, "lineitem").withColumnRenamed("l_returnflag", "region"), ["region"], "l_linestatus", "l_discount", ["F", "O", "Z"])
    return out.select("region", *[F.round(c, 6).alias(c) for c in "FOZ"])


@Q.add("ag26_set_mean", using("r_sets", "r_annot") + " select set_id, round(avg(score), 9) as mean_all, round(avg(score) filter (gene % 3 = 0), 9) as mean_leading from r_sets left join r_annot on site = gene and site % 7 <> 0 group by set_id")
def ag26(spark, d):
    scores = role(spark, d, "r_annot").where("site % 7 <> 0").select(F.col("site").alias("gene"), "score")
    sets = role(spark, d, "r_sets").withColumn("leading", F.col("gene") % 3 == 0)
    return A.set_mean(sets, scores, "set_id", "gene", "score", "leading").select("set_id", F.round("mean_all", 9).alias("mean_all"), F.round("mean_leading", 9).alias("mean_leading"))


@Q.add("ag27_column_profile", "select 'p_type' as \"column\", p_type as value, count(*) as n from part group by p_type union all select 'p_brand', p_brand, count(*) from part group by p_brand union all select 'p_size', cast(p_size as varchar), count(*) from part group by p_size")
def ag27(spark, d):
    return A.column_profile(role(spark, d, "part"), ["p_type", "p_brand", "p_size", "p_partkey"])


@Q.add("ag27_cross_table", "select p_type, p_brand, count(*) as n from part group by 1, 2")
def ag27b(spark, d):
    return A.cross_table(role(spark, d, "part"), "p_type", "p_brand")
