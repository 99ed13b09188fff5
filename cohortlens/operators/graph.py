"""Graph operators: connected components and family representatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.operators.ranking import rank_over_all
from cohortlens.runtime import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternates large-star and small-star contraction until the edges no longer change, so a chain of n nodes takes
    O(log n) rounds. Each round is aggregations and equi-joins whose output is written to the shared folder; the
    driver sees a row count and a checksum. Edges with a null end and self-loops link nothing, but the node of a
    self-loop is reported. An empty table gives an empty one.
    """
    scratch = Scratch(edges.sparkSession, "components")
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    given = scratch.keep(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "given")
    now, before, turn = given.where("u <> v"), None, 0

    def with_least(rows: DataFrame, label: str) -> DataFrame:
        """Each edge and the smallest neighbour m of its u; the minima are written first, so that the join reads
        both sides from plain exchanges, whose partitions Spark splits where a hub makes them large."""
        return rows.join(scratch.keep(rows.groupBy("u").agg(F.min("v").alias("m")), label, tidy=False), "u")

    while True:
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, f"up{turn}").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = scratch.keep(large, f"large{turn}", tidy=False)
        small = with_least(large, f"down{turn}")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = scratch.keep(small.distinct(), f"small{turn}")
        scratch.drop(f"up{turn}", f"large{turn}", f"down{turn}", f"small{turn - 1}")
        before, turn = seen, turn + 1
    roots = given.select("v").unionByName(given.select(F.col("u").alias("v"))).distinct().join(now.select(F.col("u").alias("v"), F.col("v").alias("m")), "v", "left")
    return roots.select(F.col("v").alias("node"), F.coalesce("m", "v").alias("component"))


def family_representatives(samples: DataFrame, relatives: DataFrame, node: str, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, family, kept): the smallest of each family of relatives is kept; ids outside the sample list link nothing."""
    known = samples.select(node).distinct()
    inside = relatives.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    inside = inside.join(known.select(F.col(node).alias("src")), "src", "left_semi").join(known.select(F.col(node).alias("dst")), "dst", "left_semi")
    family = connected_components(inside).select(F.col("node").alias(node), F.col("component").alias("family"))
    out = known.join(family, node, "left").withColumn("family", F.coalesce("family", node))
    return out.withColumn("kept", F.col(node) == F.col("family"))


#: Sites of a block, samples of a tile, and blocks whose counts one task sums before it tells them.
BLOCK_SITES, TILE, BLOCKS_EACH = 4096, 128, 64


def _site_words(calls: DataFrame, sample: str, site: str, dosage: str, scratch: Scratch) -> DataFrame:
    """(block, word, sample, het, alt, both): dosages of 64 sites a row, as bits: heterozygous, homozygous alternate, called."""
    called = scratch.keep(calls.where(F.col(dosage).isNotNull()).select(F.col(sample).alias("sample"), F.col(site).alias("__site"), F.col(dosage).cast("int").alias("d")), "calls", tidy=False)
    sites = called.select("__site").distinct()
    blocks = F.lit(max(1, -(-sites.count() // BLOCK_SITES)))
    within = Window.partitionBy("block").orderBy("__site")  # about BLOCK_SITES rows
    numbered = sites.withColumn("block", F.pmod(F.xxhash64("__site"), blocks)).withColumn("at", F.row_number().over(within) - 1)
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    t = called.join(numbered, "__site").groupBy("block", F.floor(F.col("at") / 64).cast("int").alias("word"), "sample")
    marked = lambda test: F.bit_or(F.when(test, bit).otherwise(F.lit(0).cast("long")))
    return t.agg(marked(F.col("d") == 1).alias("het"), marked(F.col("d") == 2).alias("alt"), marked(F.lit(True)).alias("both"))


def pairwise_kinship(calls: DataFrame, sample: str, site: str, dosage: str, least: float | None = 0.0) -> DataFrame:
    """KING-robust kinship of sample pairs over sites that both have: shared sites, both het, opposite homozygotes.

    With h the heterozygotes of each and m the smaller: (HH - 2 O) / 2m + 1/2 - (ha + hb) / 4m, null if m is 0;
    rows below ``least`` go (None keeps all), and pairs without a shared site are not reported. A sample has one
    call a site; dosages are 0, 1, 2 or null.

    Dosages of a block of sites are bits of 64-bit words, so a pair costs a few bit counts a word. Tiles of samples meet
    in pairs, and a task sums many blocks before it tells a pair of tiles' counts, so what is shuffled follows
    sites x samples / 64 and pairs of tiles, not sites x samples squared.
    """
    spark = calls.sparkSession
    scratch = Scratch(spark, "kinship")
    words = scratch.keep(_site_words(calls, sample, site, dosage, scratch), "words", tidy=False)
    samples = words.select("sample").distinct()
    numbered = scratch.keep(rank_over_all(samples, [F.col("sample")], "id").withColumn("id", F.col("id") - 1), "samples", tidy=False)
    tiles = -(-numbered.count() // TILE)
    words = words.join(numbered, "sample").select("block", "word", F.col("id"), F.floor(F.col("id") / TILE).cast("int").alias("tile"), "het", "alt", "both")
    words = words.withColumn("share", F.floor(F.col("block") / BLOCKS_EACH)).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(tiles, 1) - 1))))
    words = words.withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other"))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(group["ti"].iloc[0]), int(group["tj"].iloc[0])
        place, _ = pd.factorize(group["block"] * (BLOCK_SITES * 2) + group["word"])
        n_words = int(place.max()) + 1

        def bits(tile: int) -> list[np.ndarray]:
            mine = (group["tile"] == tile).to_numpy()
            out = [np.zeros((TILE, n_words), dtype=np.uint64) for _ in range(3)]
            for m, c in zip(out, ("het", "alt", "both")):
                m[group["id"].to_numpy()[mine] % TILE, place[mine]] = group[c].to_numpy(dtype=np.int64)[mine].view(np.uint64)
            return out

        het_a, alt_a, both_a = bits(ti)
        het_b, alt_b, both_b = bits(tj)
        ref_b = both_b & ~het_b & ~alt_b
        ones = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        rows = []
        for i in range(TILE):
            if both_a[i].any():
                h, v, t = het_a[i], both_a[i], alt_a[i]
                n, opposite = ones(v & both_b), ones(v & ~h & ~t & alt_b) + ones(t & ref_b)
                table = np.stack([n, ones(h & het_b), opposite, ones(h & both_b), ones(v & het_b)])
                at = np.flatnonzero((n > 0) & (tj * TILE + np.arange(TILE) > ti * TILE + i))
                rows.append(pd.DataFrame({"ia": ti * TILE + i, "ib": tj * TILE + at, **dict(zip(("n_sites", "het_het", "opposite", "ha", "hb"), table[:, at]))}))
        return pd.concat(rows) if rows else pd.DataFrame(columns=["ia", "ib", "n_sites", "het_het", "opposite", "ha", "hb"])

    counted = words.groupBy("ti", "tj", "share").applyInPandas(count, "ia long, ib long, n_sites long, het_het long, opposite long, ha long, hb long")
    t = counted.groupBy("ia", "ib").agg(*[F.sum(c).alias(c) for c in ("n_sites", "het_het", "opposite", "ha", "hb")])
    name = lambda end: numbered.select(F.col("id").alias(f"i{end}"), F.col("sample").alias(end))
    t = t.join(name("a"), "ia").join(name("b"), "ib")
    m = F.least("ha", "hb")
    k = F.when(m > 0, (F.col("het_het") - 2 * F.col("opposite")) / (2.0 * m) + 0.5 - (F.col("ha") + F.col("hb")) / (4.0 * m))
    out = t.select("a", "b", "n_sites", "het_het", "opposite", k.alias("kinship"))
    return out if least is None else out.where(F.col("kinship") >= least)


def hwe_p(het, hom_a, hom_b):
    """Exact Hardy-Weinberg p values of arrays of genotype counts, by recurrence over heterozygote counts."""
    out = np.ones(len(het))
    for k, (h, p, q) in enumerate(zip(het, hom_a, hom_b)):
        rare, n = 2 * min(p, q) + h, h + p + q
        if n == 0 or rare == 0:
            continue
        start = int(rare * (2 * n - rare) / (2 * n))
        start += (start ^ rare) & 1
        probs = {start: 1.0}
        x, a, b = start, (rare - start) // 2, n - start - (rare - start) // 2
        value = 1.0
        while x > 1:
            value *= x * (x - 1.0) / (4.0 * (a + 1.0) * (b + 1.0))
            x, a, b = x - 2, a + 1, b + 1
            probs[x] = value
        x, a, b = start, (rare - start) // 2, n - start - (rare - start) // 2
        value = 1.0
        while x <= rare - 2:
            value *= 4.0 * a * b / ((x + 2.0) * (x + 1.0))
            x, a, b = x + 2, a - 1, b - 1
            probs[x] = value
        total, own = sum(probs.values()), probs[h]
        out[k] = min(1.0, sum(v for v in probs.values() if v <= own * (1 + 1e-9)) / total)
    return out


#: Names of autosomes, with or without the prefix.
AUTOSOMES = r"^(chr)?([1-9]|1[0-9]|2[0-2])$"


def prune_sites(calls: DataFrame, site: str, dosage: str, n_samples: int, maf: float = 0.05, missing: float = 0.05, hwe: float = 1e-6, contig: str | None = None, ref: str | None = None, alt: str | None = None) -> DataFrame:
    """Sites with minor allele frequency, missing share and exact Hardy-Weinberg p inside the limits.

    With ``contig`` only autosomal sites count; with ``ref`` and ``alt`` only biallelic ones: one alternate, neither
    ``*`` nor missing. A call whose contig or allele is null does not count.
    """
    if contig is not None:
        calls = calls.where(F.col(contig).rlike(AUTOSOMES))
    if alt is not None:
        calls = calls.where(~F.col(alt).contains(",") & ~F.col(alt).isin("*", ".", ""))
    if ref is not None:
        calls = calls.where(~F.col(ref).isin(".", ""))

    @F.pandas_udf("double")
    def exact(het: pd.Series, hom_a: pd.Series, hom_b: pd.Series) -> pd.Series:
        return pd.Series(hwe_p(het.to_numpy(), hom_a.to_numpy(), hom_b.to_numpy()))

    d = F.col(dosage)
    t = calls.groupBy(site).agg(F.count(d).alias("n"), F.count_if(d == 0).alias("hom_ref"), F.count_if(d == 1).alias("het"), F.count_if(d == 2).alias("hom_alt"))
    share = (F.col("het") + 2 * F.col("hom_alt")) / (2.0 * F.col("n"))
    t = t.where("n > 0").withColumn("maf", F.least(share, 1 - share)).withColumn("missing", 1 - F.col("n") / n_samples)
    return t.where((F.col("maf") >= maf) & (F.col("missing") <= missing)).withColumn("p", exact("het", "hom_ref", "hom_alt")).where(F.col("p") >= hwe)


def _moved(links: DataFrame, start: DataFrame, scratch: Scratch, name: str, rounds: int) -> tuple[DataFrame, bool]:
    """(v, label) after moving nodes between communities while that raises modularity, and whether any moved.

    ``links`` has (u, v, w) both ways; a contracted node's inner weight is a loop. Each round every node finds the
    community where it raises modularity most, the smallest label among ties; of the nodes that want to move, those
    that a hash of the node and the round picks do, so that neighbours do not swap places for ever.
    """
    weight = scratch.keep(links.groupBy("u").agg(F.sum("w").alias("k")), f"{name}-weight")
    total = weight.agg(F.sum("k")).first()[0] or 0.0
    labels, moved = start, False
    if not total:
        return labels, False
    for k in range(rounds):
        own = labels.join(weight.withColumnRenamed("u", "v"), "v")
        sizes = own.groupBy("label").agg(F.sum("k").alias("__of"))
        votes = links.where("u <> v").join(labels, "v").groupBy("u", "label").agg(F.sum("w").alias("to"))
        here = own.select(F.col("v").alias("u"), "label", F.lit(0.0).alias("to"))
        votes = votes.unionByName(here).groupBy("u", "label").agg(F.sum("to").alias("to"))
        votes = votes.join(sizes, "label").join(own.select(F.col("v").alias("u"), F.col("label").alias("was"), "k"), "u")
        gain = F.col("to") - F.col("k") * (F.col("__of") - F.when(F.col("label") == F.col("was"), F.col("k")).otherwise(0.0)) / total
        rank = F.struct((-F.round(gain, 9)).alias("g"), (F.col("label") != F.col("was")).alias("away"), "label")
        best = votes.groupBy("u").agg(F.min(rank).alias("best"))
        chosen = labels.join(best.select(F.col("u").alias("v"), F.col("best.label").alias("new")), "v", "left").withColumn("new", F.coalesce("new", "label"))
        wants = F.col("new") != F.col("label")
        picked = F.pmod(F.xxhash64("v", F.lit(k)), F.lit(2)) == 0
        chosen = scratch.keep(chosen.select("v", F.when(wants & picked, F.col("new")).otherwise(F.col("label")).alias("label"), wants.alias("wants")), f"{name}-{k}", tidy=False)
        labels = chosen.select("v", "label")
        if not chosen.where("wants").head(1):
            return labels, moved
        moved = True
    return labels, moved


def modularity(links: DataFrame, labels: DataFrame) -> float:
    """Of the communities (v, label) of a graph (u, v, w both ways): inner weight less what degrees alone would give."""
    of = labels.select(F.col("v").alias("u"), F.col("label").alias("of"))
    t = links.join(of, "u").join(labels, "v").groupBy("of").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("of") == F.col("label"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = links.agg(F.sum("w")).first()[0]
    return t.agg(F.sum(F.col("inside") / total - F.pow(F.col("k") / total, 2))).first()[0] if total else 0.0


def similarity_graph(edges: DataFrame, nodes: DataFrame, node: str, a: str = "set_a", b: str = "set_b", weight: str = "similarity", padj: str | None = None, rounds: int = 24) -> DataFrame:
    """Nodes with all their columns and their ``community``, and with ``padj`` also ``neg_log10_padj``.

    Modularity is raised by moving nodes between communities; then each community becomes one node, with its inner
    weight as a loop, and moving goes on a level higher, until a level brings no more modularity. A community's name
    is its smallest node, and nodes without edges are their own. Moves are deterministic, ``rounds`` a level at most. Each
    pair of nodes is one edge at most.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "communities")
    one_way = edges.select(F.col(a).alias("u"), F.col(b).alias("v"), F.col(weight).cast("double").alias("w")).where("u <> v")
    base = scratch.keep(one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "edges")
    found = scratch.keep(base.select(F.col("u").alias("v")).distinct().select("v", F.col("v").alias("label")), "single")
    links, best, level = base, modularity(base, found), 0
    while True:
        here = links.select(F.col("u").alias("v")).distinct().select("v", F.col("v").alias("label"))
        labels, moved = _moved(links, here, scratch, f"level{level}", rounds)
        if not moved:
            break
        smallest = labels.groupBy("label").agg(F.min("v").alias("name"))
        labels = scratch.keep(labels.join(smallest, "label").select("v", F.col("name").alias("label")), f"names{level}")
        new = scratch.keep(found.join(labels.select(F.col("v").alias("label"), F.col("label").alias("up")), "label").select("v", F.col("up").alias("label")), f"found{level}")
        value = modularity(base, new)
        if value <= best + 1e-9:
            break
        found, best = new, value
        up = labels.select(F.col("v").alias("u"), F.col("label").alias("cu"))
        links = links.join(up, "u").join(labels, "v").groupBy(F.col("cu").alias("u"), F.col("label").alias("v")).agg(F.sum("w").alias("w"))
        links, level = scratch.keep(links, f"links{level}"), level + 1
    out = nodes.join(found.select(F.col("v").alias(node), F.col("label").alias("community")), node, "left").withColumn("community", F.coalesce("community", node))
    return out if padj is None else out.withColumn("neg_log10_padj", -F.log10(padj))
