"""Queries over sequences, labels and mappings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cohortlens.operators import mapping as M, ranking as R, search as S
from cohortlens.plans.roles import Catalogue, role

Q = Catalogue()


@Q.add("prj25_kmer_tile", "select item_id as k0, k, substr(text, i, k) as kmer, min(i - 1) as first from benchmark, (values (8), (9), (10), (11)) l(k), range(1, 20000) t(i) where i <= length(text) - k + 1 group by 1, 2, 3")
def prj25(spark, d):
    return S.kmer_tile(role(spark, d, "benchmark").withColumnRenamed("item_id", "k0"), "k0", "text", [8, 9, 10, 11])


_WORDS = "q as (select distinct w as q from (select unnest(regexp_split_to_array(text, '[^A-Za-z]+')) as w from benchmark) x where length(w) = 12)"


@Q.add("sq1_near_matches", f"""with {_WORDS}, t as (select doc_id, i - 1 as pos, substr(text, i, 12) as f from (select doc_id, text, unnest(range(1, length(text) - 10)) as i from documents) x),
 c as (select q, doc_id, pos, f from t join q on substr(q, 1, 4) = substr(f, 1, 4) union select q, doc_id, pos, f from t join q on substr(q, 5, 4) = substr(f, 5, 4) union select q, doc_id, pos, f from t join q on substr(q, 9, 4) = substr(f, 9, 4)),
 m as (select q, doc_id, pos, list_sum(list_transform(range(1, 13), lambda k: cast(substr(q, k, 1) = substr(f, k, 1) as int))) as ident from c where substr(q, 2, 1) = substr(f, 2, 1) and substr(q, 12, 1) = substr(f, 12, 1))
 select q as query, doc_id as k, pos, cast(ident as int) as identities, case when ident = 12 then 'exact' else 'near' end as tier from m where ident >= 10""")
def sq1(spark, d):
    """Words of twelve letters, searched in all whole texts."""
    words = F.explode(F.split("text", "[^A-Za-z]+")).alias("q")
    queries = role(spark, d, "benchmark").select(words).where(F.length("q") == 12)
    return S.near_matches(queries, role(spark, d, "documents"), "q", "doc_id", "text").select("query", F.col("doc_id").alias("k"), F.col("at").alias("pos"), "identities", "tier")


@Q.add("sq1_similar_matches")
def sq1b(spark, d):
    """Words of nine letters or more in all whole texts; letters that differ must be both vowels or both of one group of consonants."""
    words = F.explode(F.split("text", "[^A-Za-z]+")).alias("q")
    queries = role(spark, d, "benchmark").select(words).where(F.length("q") >= 9)
    return S.near_matches(queries, role(spark, d, "documents"), "q", "doc_id", "text", similar=["aeiou", "bdpt", "mn", "cgkq", "fvw", "sz"])


@Q.add("sq2_hits_by_organism", "select p_type as organism, count(*) as hits, count(*) filter (p_size % 2 = 0) as exact, p_type = 'PROMO' as is_self, p_type in ('SMALL', 'LARGE') as is_priority from part group by p_type")
def sq2(spark, d):
    hits = role(spark, d, "part").select(F.col("p_type").alias("organism"), F.when(F.col("p_size") % 2 == 0, "exact").otherwise("near").alias("tier"))
    return S.hits_by_organism(hits, "organism", "PROMO", ["SMALL", "LARGE"])


@Q.add("sq3_top_binders", """select p_brand as peptide, arg_min(p_type, p_partkey) as cls, min(p_partkey) as ord from part where (p_type = 'PROMO' and p_size / 50.0 <= 0.5) or (p_type = 'SMALL' and p_size / 50.0 <= 0.8) group by p_brand""")
def sq3(spark, d):
    rows = role(spark, d, "part").select(F.col("p_brand").alias("peptide"), F.col("p_type").alias("cls"), (F.col("p_size") / 50.0).alias("rank"), F.col("p_partkey").alias("ord"))
    return S.top_binders(rows, {"PROMO": 0.5, "SMALL": 0.8}, "peptide", "cls", "rank", "ord").select("peptide", "cls", "ord")


@Q.add("ud4_scorer", "select p_partkey as k, cast(length(p_brand) * 10 + length(p_type) as double) as rank from part")
def ud4(spark, d):
    def load():
        return lambda p, a: pd.Series(p.str.len() * 10.0 + a.str.len())

    return S.score_peptides(role(spark, d, "part"), "p_brand", "p_type", load).select(F.col("p_partkey").alias("k"), "rank")


@Q.add("prj18_low_complexity")
def prj18(spark, d):
    """Whole texts as reads, two neighbours a pair; the limit is one that some of them fail."""
    reads = role(spark, d, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 2).alias("pair"))
    return S.low_complexity_filter(reads, "doc_id", "pair", "text", least=0.96).select("doc_id", F.round("entropy", 6).alias("entropy"))


@Q.add("prj10_left_align", "select p_partkey as k, 11 as pos, 'G' as ref, 'GT' as alt from part where p_size % 2 = 0 union all select p_partkey, 29, 'GAC', 'G' from part where p_size % 2 = 1")
def prj10(spark, d):
    text = "ACGACGACGAGTTTTTTTTTACGAGGAGGACACACACACGGG"
    reference = role(spark, d, "part").limit(1).select(F.lit("c").alias("contig"), F.lit(0).alias("k"), F.lit(text).alias("seq"))
    even = F.col("p_size") % 2 == 0
    rows = role(spark, d, "part").select(F.col("p_partkey").alias("k0"), F.lit("c").alias("contig"), F.when(even, F.lit(18)).otherwise(F.lit(35)).alias("pos"), F.when(even, "T").otherwise("CAC").alias("ref"), F.when(even, "TT").otherwise("C").alias("alt"))
    return S.left_align(rows, reference, steps=64).select(F.col("k0").alias("k"), F.col("pos").cast("int").alias("pos"), "ref", "alt")


@Q.add("prj20_allele_names", """select c_custkey as s, 'DRB1_0401' as name from customer union all select c_custkey, 'HLA-DQA10501-DQB10201' from customer union all select c_custkey, 'HLA-A02:01' from customer where c_nationkey % 2 = 0""")
def prj20(spark, d):
    c = role(spark, d, "customer").select(F.col("c_custkey").alias("s"), "c_nationkey")
    calls = F.array(*[F.struct(F.lit(g).alias("gene"), F.lit(a).alias("allele")) for g, a in (("DRB1", "DRB1*04:01"), ("DQA1", "DQA1*05:01"), ("DQB1", "DQB1*02:01"), ("A", "A*02:01"))])
    rows = c.select("s", "c_nationkey", F.inline(calls)).where("gene <> 'A' or c_nationkey % 2 = 0")
    return S.allele_names(rows, "s", "gene", "allele")


@Q.add("prj28_explode_positional", "select p_partkey as k, 'd1' as donor, cast(p_size as double) as value from part union all select p_partkey, 'd2', p_size * 2.0e0 from part")
def prj28(spark, d):
    rows = role(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.col("p_size").cast("string"), F.lit(", "), (F.col("p_size") * 2).cast("string")).alias("v"))
    return S.explode_positional(rows, ["k"], "v", ["d1", "d2"])


@Q.add("ud1_strict_map", "select p_partkey as k, case p_type when 'PROMO' then 'a' else 'b' end as label from part where p_type <> 'SMALL'")
def ud1(spark, d):
    part = role(spark, d, "part")
    types = {r[0]: "b" for r in part.select("p_type").distinct().collect()} | {"PROMO": "a", "SMALL": M.DROP}  # a handful of types
    return M.strict_map(part, "p_type", types, "label").select(F.col("p_partkey").alias("k"), "label")


@Q.add("ud2_hierarchical_label", "select doc_id, case lang when 'en' then source when 'fr' then 'romance' else 'germanic' end as label from documents where lang <> 'es'")
def ud2(spark, d):
    rules = {"en": "FINE", "fr": "COARSE:romance", "de": "COARSE:germanic", "es": M.DROP}
    return M.hierarchical_label(role(spark, d, "documents"), "lang", rules, "source", "label").select("doc_id", "label")


@Q.add("ud3_label_fn", "select p_partkey as k, 'big' as label from part where p_size > 25")
def ud3(spark, d):
    return M.labelled(role(spark, d, "part"), "label", lambda df: F.when(df["p_size"] > 25, "big")).select(F.col("p_partkey").alias("k"), "label")


@Q.add("ud5_rule_table", "select p_partkey as k, 'small' as rule, p_size < 10 as fired from part union all select p_partkey, 'large', p_size >= 45 from part")
def ud5(spark, d):
    rules = M.rule_table(spark, [("small", "size", "<", 10), ("large", "size", ">=", 45), ("other", "weight", ">", 0)])
    rows = role(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit("size").alias("m"), F.col("p_size").cast("double").alias("v"))
    return M.apply_rules(rows, rules, "k", "m", "v")


@Q.add("ud6_provenance", """select '{"classes":{' || string_agg('"' || p_type || '":' || n, ',' order by p_type) || '},"rows":' || sum(n) || ',"seed":7}' as provenance from (select p_type, count(*) as n from part group by 1) t""")
def ud6(spark, d):
    return M.provenance(role(spark, d, "part"), "p_type", seed=7)


@Q.add("ud7_expectations", "select 'positive' as rule, count(*) filter (not p_size > 0) as broken from part union all select 'small', count(*) filter (not p_size <= 40) from part")
def ud7(spark, d):
    part = role(spark, d, "part")
    found = M.expectations(part, {"positive": F.col("p_size") > 0, "small": F.col("p_size") <= 40}, warn=["small"])
    return spark.createDataFrame(list(found.items()), "rule string, broken long")


@Q.add("wn13_two_caps", "select lang, source, count(*) as n from (select lang, source, doc_id, row_number() over (partition by lang order by md5('2|' || doc_id), doc_id) as m from (select lang, source, doc_id, row_number() over (partition by source order by md5('1|' || doc_id), doc_id) as n from documents) t where n <= 30) u where m <= 100 group by 1, 2")
def two_caps(spark, d):
    rows = R.stratified_cap(role(spark, d, "documents").select("lang", "source", "doc_id"), "source", "doc_id", 30, 1)
    return R.stratified_cap(rows, "lang", "doc_id", 100, 2).groupBy("lang", "source").agg(F.count("*").alias("n"))
