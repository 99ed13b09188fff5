"""Role views: the supplied tables seen as cohort data, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages")

ROLES = {
    # sample x site dosage
    "r_calls": """select cast(o_custkey % 24 as int) as sample, l_partkey as site, cast(least(2, count(*)) as int) as dosage
        from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 40 group by o_custkey % 24, l_partkey""",
    # two population frequencies, some absent
    "r_freq": """select p_partkey as site, case when p_partkey % 3 = 0 then null else p_size / 20000.0e0 end as af_a,
        case when p_partkey % 5 < 3 then null else p_size / 30000.0e0 end as af_b from part""",
    # annotated sites
    "r_annot": """select p_partkey as site, p_brand as symbol,
        case p_type when 'ECONOMY' then 'stop_gained,splice_region_variant' when 'PROMO' then 'missense_variant'
            when 'SMALL' then 'missense_variant,splice_region_variant' when 'LARGE' then 'inframe_deletion'
            else 'synonymous_variant' end as consequence,
        case when p_partkey % 4 = 0 then 'HC' when p_partkey % 4 = 1 then 'LC' else null end as lof,
        case when p_partkey % 11 = 0 then null else (p_partkey % 37) / 100.0e0 end as s1,
        case when p_partkey % 13 = 0 then null else (p_partkey % 23) / 100.0e0 end as s2,
        (p_partkey % 101) / 100.0e0 as score, case p_partkey % 17 when 0 then 'Likely_Pathogenic' when 1 then 'likely_benign' end as am_class,
        case when p_partkey % 19 = 0 then 'low' when p_partkey % 19 < 15 then cast((p_partkey % 89) / 100.0e0 as varchar(9)) end as revel from part""",
    # several transcripts per symbol, some symbols constrained
    "r_constraint": """select p_brand as symbol, p_partkey as ord, p_size % 5 = 0 as mane, p_size % 3 = 0 as canonical,
        (cast(substr(p_brand, 7) as int) + p_size % 3) / 30.0e0 as loeuf from part""",
    # several rows per symbol, in order
    "r_panel": "select p_partkey as ord, p_brand as symbol, p_name as phenotype, cast(p_size % 4 as int) as confidence from part where p_partkey % 7 = 0 and cast(substr(p_brand, 7) as int) % 3 > 0",
    # chains of random length
    "r_edges": "select c_custkey as src, c_custkey + 1 as dst from customer where c_acctbal > 6000",
    # half-open intervals with flag bits
    "r_reads": """select event_id as rid, cast(user_id % 12 as int) as sample, event_type as contig,
        day(ts) * 1440 + hour(ts) * 60 + minute(ts) as s, day(ts) * 1440 + hour(ts) * 60 + minute(ts) + 5 + event_id % 46 as e,
        cast(event_id % 61 as int) as mapq, case event_id % 10 when 0 then 1024 when 1 then 256 when 2 then 4 else 0 end as flag from events""",
    # named target intervals
    "r_regions": """select p_partkey as region_id, p_brand as name,
        case p_partkey % 5 when 0 then 'click' when 1 then 'error' when 2 then 'purchase' when 3 then 'signup' else 'view' end as contig,
        1440 + (p_partkey * 197) % 43000 as s, 1440 + (p_partkey * 197) % 43000 + 10 + p_size * 4 as e from part""",
    # sample x gene counts
    "r_counts": """select cast(o_custkey % 24 as int) as sample, l_partkey as gene, cast(sum(l_quantity) as bigint) as cnt
        from lineitem join orders on l_orderkey = o_orderkey group by o_custkey % 24, l_partkey""",
    # set collection
    "r_sets": "select distinct l_suppkey as set_id, l_partkey as gene from lineitem where l_quantity > 45 and l_discount < 0.06",
    # donor x gene statistic
    "r_stat": """select cast(o_custkey % 8 as int) as donor, l_partkey as gene, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as stat
        from lineitem join orders on l_orderkey = o_orderkey group by o_custkey % 8, l_partkey""",
    # one primary and up to two alternate contigs per read
    "r_hits": """select event_id as rid, cast(user_id % 12 as int) as sample, event_type as prim,
        case event_id % 4 when 0 then 'view;click' when 1 then 'view' when 2 then '' else 'other;other' end as alts from events""",
    # per-sample metrics
    "r_qc": """select user_id as sample, cast(avg(cast(value as decimal(18,6))) as double) as m1, max(value) as m2, count(*) as n from events group by user_id""",
    # statistic centred per donor, so that both signs occur
    "r_z": """select donor, gene, stat - 60000.0e0 as z from (select cast(o_custkey % 8 as int) as donor, l_partkey as gene,
        cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as stat
        from lineitem join orders on l_orderkey = o_orderkey group by o_custkey % 8, l_partkey) t""",
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role view, or a supplied table, as a DataFrame."""
    if name not in ROLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for table in TABLES:
        if table in ROLES[name]:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(ROLES[name])


def using(*names: str) -> str:
    """``with`` clause of the named role views for an oracle; ends open to further clauses after a comma."""
    return "with " + ",\n".join(f"{n} as ({ROLES[n]})" for n in names)


class Catalogue:
    """Queries and oracles of a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return put
