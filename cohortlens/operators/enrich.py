"""Enrichment and statistics: running-sum scores, permutation nulls, matched nulls, correlations, markers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.operators.nulls import null_blocks, null_counts, tail_p, weight_chunks
from cohortlens.operators.ranking import bh_adjust, rank_over_all, running_totals
from cohortlens.runtime import Scratch, shuffle_partitions


def _hits(ranked: DataFrame, sets: DataFrame, keys: Sequence[str], gene: str) -> DataFrame:
    """Members of the sets with their rank and statistic in each ranking, and the ranking's length ``n_ranked``."""
    n = ranked.groupBy(*keys).agg(F.count("*").alias("n_ranked"))
    return sets.join(ranked, [c for c in sets.columns if c in ranked.columns and c in (*keys, gene)]).join(n, list(keys))


def _scores(hits: DataFrame, keys: Sequence[str], set_col: str, gene: str, least: int, most: int) -> DataFrame:
    """(keys, set, size, es, leading_edge, n_ranked) from hits with ``rank``, ``stat`` and ``n_ranked``."""
    w = Window.partitionBy(*keys, set_col)
    hits = hits.withColumn("size", F.count("*").over(w)).where(F.col("size").between(least, most))
    run = w.orderBy("rank")
    weight, total = F.abs(F.col("stat")), F.sum(F.abs(F.col("stat"))).over(w)
    up = F.sum(weight).over(run)
    miss = F.coalesce(F.try_divide(F.col("rank") - F.row_number().over(run), F.col("n_ranked") - F.col("size")), F.lit(0.0))
    share = lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))
    t = hits.withColumn("__top", share(up) - miss).withColumn("__bot", share(up - weight) - miss)
    g = t.groupBy(*keys, set_col).agg(
        F.first("size").alias("size"), F.first("n_ranked").alias("n_ranked"), F.max("__top").alias("__mx"), F.min("__bot").alias("__mn"),
        F.max_by("rank", F.struct("__top", -F.col("rank"))).alias("__at_max"), F.min_by("rank", F.struct("__bot", "rank")).alias("__at_min"),
        F.sort_array(F.collect_list(F.struct("rank", gene))).alias("__genes"))
    es = F.when(F.col("__mx") > -F.col("__mn"), F.col("__mx")).when(F.col("__mx") < -F.col("__mn"), F.col("__mn")).otherwise(0.0)
    edge = F.filter("__genes", lambda x: F.when(F.col("es") > 0, x["rank"] <= F.col("__at_max")).when(F.col("es") < 0, x["rank"] >= F.col("__at_min")).otherwise(False))
    return g.withColumn("es", es).select(*keys, set_col, "size", "es", F.transform(edge, lambda x: x[gene]).alias("leading_edge"), "n_ranked")


def enrichment_score(ranked: DataFrame, sets: DataFrame, keys: Sequence[str], set_col: str, gene: str, least: int = 20, most: int = 200) -> DataFrame:
    """(keys, set, size, es, leading_edge) of the sets with ``least`` to ``most`` genes in the ranking.

    ``ranked`` has the keys, gene, ``stat`` and ``rank`` (1 is the highest). The running sum rises by |stat| shares
    at hits and falls by 1 / (N - k) elsewhere; only hits are materialised, the extrema lie just at and before
    them. The leading edge is the hits up to the maximum, or from the minimum on.
    """
    if not keys:
        return enrichment_score(ranked.withColumn("__one", F.lit(0)), sets, ["__one"], set_col, gene, least, most).drop("__one")
    return _scores(_hits(ranked, sets, keys, gene), keys, set_col, gene, least, most).drop("n_ranked")


def _tested(scratch: Scratch, scores: DataFrame, chunks: DataFrame, requests: DataFrame, base: Sequence[str], keys: Sequence[str], set_col: str, n_perm: int, seed: int, few: int, chains: int, least_p: float) -> DataFrame:
    """Scores with ``pval`` and ``nes``; requests name for each of the keys its ranking and the ranks that it lacks."""
    sizes = scores.groupBy(*keys).agg(F.first("n_ranked").alias("n"), F.array_sort(F.collect_set(F.col("size").cast("long"))).alias("sizes"))
    asked = scratch.keep(requests.join(sizes, list(keys)), "requests", tidy=False)
    nulls = scratch.keep(null_blocks(chunks, asked, base, keys, n_perm, seed), "nulls", tidy=False)
    same, far, total = null_counts(F.col("nulls"), F.col("es"))
    t = scores.select(*keys, set_col, F.col("size").cast("long").alias("size"), "es").join(nulls, [*keys, "size"])
    t = t.groupBy(*keys, set_col).agg(F.sum(same).alias("__same"), F.sum(far).alias("__far"), F.sum(total).alias("__sum"))
    plain = (1 + F.col("__far")) / (1 + F.col("__same"))
    out = scores.join(t, [*keys, set_col]).withColumn("pval", plain).withColumn("nes", F.try_divide(F.col("es") * F.col("__same"), F.col("__sum")))
    if few > 0:
        out = scratch.keep(out, "plain", tidy=False)
        rare = out.where((F.col("__far") < few) & (F.col("es") != 0))
        units = rare.groupBy(*keys, F.col("size").cast("long").alias("size"), (F.col("es") > 0).alias("up")).agg(F.collect_set("es").alias("scores"))
        tails = tail_p(chunks, units.join(asked.drop("sizes"), list(keys)), base, keys, chains, seed, least_p)
        tails = scratch.keep(tails.select(*keys, F.col("size").alias("__size"), F.col("es").alias("__es"), "tail"), "tails")
        on = [out[c].eqNullSafe(tails[c]) for c in keys] + [out["size"] == tails["__size"], out["es"] == tails["__es"], out["__far"] < few]
        out = out.join(tails, on, "left").drop(*[tails[c] for c in keys], "__size", "__es")
        given = F.col("tail") * (1 + n_perm) / (1 + F.col("__same"))  # given the sign
        out = out.withColumn("pval", F.coalesce(F.least(F.lit(1.0), given), "pval")).drop("tail")
    return out.drop("__same", "__far", "__sum", "n_ranked")


def enrichment_test(ranked: DataFrame, sets: DataFrame, keys: Sequence[str], set_col: str, gene: str, n_perm: int = 1000, seed: int = 1, least: int = 20, most: int = 200, few: int = 10, chains: int = 201, least_p: float = 1e-50) -> DataFrame:
    """Adds ``pval, nes, padj`` to the scores, from ``n_perm`` seeded draws of ranks from each ranking.

    p = (1 + as extreme with the same sign) / (1 + with the same sign), NES = ES / mean |null ES| of the same sign,
    padj by Benjamini-Hochberg within the keys. Where fewer than ``few`` draws are as extreme, p comes from adaptive
    multilevel splitting with ``chains`` chains instead, so it has no floor at 1 / (1 + n_perm) but ``least_p``; its
    relative error grows as sqrt(log2(1 / p) / chains). ``few`` 0 leaves all as counted.
    """
    if not keys:
        how = dict(n_perm=n_perm, seed=seed, least=least, most=most, few=few, chains=chains, least_p=least_p)
        return enrichment_test(ranked.withColumn("__one", F.lit(0)), sets, ["__one"], set_col, gene, **how).drop("__one")
    scratch = Scratch(ranked.sparkSession, "enrichment")
    ranked = scratch.keep(ranked.select(*keys, gene, "rank", "stat"), "ranked")  # read by scores, lengths and chunks
    scores = scratch.keep(_scores(_hits(ranked, sets, keys, gene), keys, set_col, gene, least, most), "scores")
    chunks = scratch.keep(weight_chunks(ranked, keys), "chunks", tidy=False)
    requests = chunks.select(*keys).distinct().withColumn("removed", F.array().cast("array<long>"))
    return bh_adjust(_tested(scratch, scores, chunks, requests, keys, keys, set_col, n_perm, seed, few, chains, least_p), "pval", keys)


def leave_one_out(ranked: DataFrame, sets: DataFrame, candidates: DataFrame, set_col: str, gene: str, n_perm: int = 1000, seed: int = 1, least: int = 20, most: int = 200, few: int = 10, chains: int = 201, least_p: float = 1e-50) -> DataFrame:
    """The enrichment test once for each candidate gene, without it in ranking and sets: one job, ``left_out`` as key.

    The ranking is not copied for the candidates: members below a candidate move up by one rank, and draws skip the
    candidate's rank. Rows are members of sets for each candidate, as many as the result is about. A candidate that
    the ranking lacks leaves it as it is.
    """
    scratch = Scratch(ranked.sparkSession, "leave-one-out")
    found = ranked.select(gene, F.col("rank").cast("long").alias("rank"), "stat", F.lit(0).alias("__base"))
    each = candidates.select(gene).distinct().join(found.select(gene, F.col("rank").alias("__gone")), gene, "left").withColumnRenamed(gene, "left_out")
    each = scratch.keep(each.withColumn("__base", F.lit(0)), "candidates", tidy=False)
    n = found.groupBy("__base").agg(F.count("*").alias("__n"))
    hits = sets.join(found, gene).join(n, "__base").join(each, "__base").where(F.col(gene) != F.col("left_out"))
    hits = hits.withColumn("rank", F.col("rank") - F.coalesce((F.col("rank") > F.col("__gone")).cast("long"), F.lit(0))).withColumn("n_ranked", F.col("__n") - F.col("__gone").isNotNull().cast("int"))
    scores = scratch.keep(_scores(hits, ["left_out"], set_col, gene, least, most), "scores")
    chunks = scratch.keep(weight_chunks(found, ["__base"]), "chunks", tidy=False)
    requests = each.select("left_out", "__base", F.array_compact(F.array("__gone")).alias("removed"))
    return bh_adjust(_tested(scratch, scores, chunks, requests, ["__base"], ["left_out"], set_col, n_perm, seed, few, chains, least_p), "pval", ["left_out"])


def collapse_sets(tested: DataFrame, ranked: DataFrame, sets: DataFrame, set_col: str, gene: str, p: float = 0.01, significant: Column | None = None, n_perm: int = 1000, seed: int = 1) -> DataFrame:
    """(set, kept): sets (those that are ``significant``, if given) by p value, each dropped that an earlier kept set explains.

    A set is explained by another if its enrichment both among the other's genes and among all others has p above
    the limit. Only a set that shares genes can explain another, since outside of it the ranking would be as before.
    Ranks among a set's genes are its members' order; a rank among the others is the rank less the members above it. So
    a pair costs the members of both, and the ranking is not ranked anew. All pairs are tested as one job; the greedy
    walk is then a fix-point of joins: a set is dropped once an earlier kept one explains it, and kept once none that
    is undecided or kept does.
    """
    scratch = Scratch(ranked.sparkSession, "collapse")
    tested = tested if significant is None else tested.where(significant)
    order = scratch.keep(rank_over_all(tested.select(set_col, "pval"), [F.col("pval"), F.col(set_col)], "o"), "order")
    found = ranked.select(gene, F.col("rank").cast("long").alias("rank"), "stat")
    members = scratch.keep(sets.select(set_col, gene).distinct().join(order.select(set_col, "o"), set_col).join(found, gene), "members")
    parents = members.select(F.col(set_col).alias("parent"), F.col("o").alias("po"), gene, "rank", "stat")
    # pairs that share genes, the earlier one as parent
    shared = members.select(set_col, "o", gene).join(parents.select("parent", "po", gene), gene).where("po < o").select(set_col, "parent").distinct()
    shared = scratch.keep(shared, "shared")
    own = members.select(set_col, gene, "rank", "stat").join(shared, set_col).withColumn("__mine", F.lit(1))
    theirs = parents.select("parent", gene, "rank", "stat").join(shared, "parent").withColumn("__theirs", F.lit(1))
    both = own.unionByName(theirs, allowMissingColumns=True).groupBy("parent", set_col, gene, "rank", "stat").agg(F.max("__mine").alias("mine"), F.max("__theirs").alias("side"))
    above = F.count("side").over(Window.partitionBy("parent", set_col).orderBy("rank"))  # the parent's members down to this rank
    sized = parents.groupBy("parent").agg(F.count("*").alias("__k"))
    total = found.agg(F.count("*").alias("__n"))
    hits = both.withColumn("__above", above).where("mine = 1").withColumn("side", F.col("side").isNotNull()).join(sized, "parent").join(total, how="cross")  # one row
    hits = hits.withColumn("rank", F.when(F.col("side"), F.col("__above")).otherwise(F.col("rank") - F.col("__above"))).withColumn("n_ranked", F.when(F.col("side"), F.col("__k")).otherwise(F.col("__n") - F.col("__k")))
    scores = scratch.keep(_scores(hits, ["parent", "side"], set_col, gene, 1, 10**9), "scores")
    wanted = shared.select("parent").distinct()
    inside = parents.join(wanted, "parent", "left_semi")
    place = F.row_number().over(Window.partitionBy("parent").orderBy("rank")).cast("long")
    inner = inside.withColumn("rank", place).withColumn("of", F.col("parent"))
    outer = found.withColumn("of", F.lit(None).cast(dict(inner.dtypes)["of"]))
    named = lambda t: t.select(F.coalesce(F.col("of").cast("string"), F.lit("")).alias("__of"), F.col("of").isNotNull().alias("__in"), "rank", "stat")
    chunks = scratch.keep(weight_chunks(named(inner).unionByName(named(outer)), ["__of", "__in"]), "chunks", tidy=False)
    gone = inside.groupBy("parent").agg(F.array_sort(F.collect_list("rank")).alias("removed"))
    within = gone.select("parent", F.lit(True).alias("side"), F.array().cast("array<long>").alias("removed"), F.col("parent").cast("string").alias("__of"), F.lit(True).alias("__in"))
    without = gone.select("parent", F.lit(False).alias("side"), "removed", F.lit("").alias("__of"), F.lit(False).alias("__in"))
    result = _tested(scratch, scores, chunks, within.unionByName(without), ["__of", "__in"], ["parent", "side"], set_col, n_perm, seed, 0, 0, 0.0)
    explained = result.groupBy("parent", set_col).agg(F.min("pval").alias("least")).where(F.col("least") > p)
    pairs = scratch.keep(explained.select("parent", set_col), "pairs")
    state, turn = order.select(set_col, F.lit(None).cast("boolean").alias("kept")), 0
    while True:
        of = state.select(F.col(set_col).alias("parent"), F.col("kept").alias("by"))
        said = pairs.join(of, "parent").groupBy(set_col).agg(F.max(F.coalesce(F.col("by"), F.lit(False))).alias("hit"), F.max(F.col("by").isNull()).alias("open"))
        new = state.join(said, set_col, "left").select(set_col, F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(~F.coalesce("open", F.lit(False)), True).alias("kept"))
        state, turn = scratch.keep(new, f"state{turn}"), turn + 1
        if state.where("kept is null").isEmpty():
            return state


def min_p_per_gene(tested: DataFrame, members: DataFrame, set_col: str, gene: str, breaks: Sequence[int]) -> DataFrame:
    """Per gene: smallest p over its sets, that set and its size, number of sets, and sets per size class [a, b)."""
    t = members.select(gene, set_col).distinct().join(tested.select(set_col, "pval", "size"), set_col).where("pval is not null")
    classes = [F.count_if((F.col("size") >= a) & (F.col("size") < b)).alias(f"n_{a}_{b}") for a, b in zip(breaks, breaks[1:])]
    best = F.min(F.struct("pval", set_col, "size")).alias("__b")
    return t.groupBy(gene).agg(best, F.count("*").alias("n_sets"), *classes).select(gene, F.col("__b.pval").alias("min_p"), F.col(f"__b.{set_col}").alias("best_set"), F.col("__b.size").alias("best_size"), "n_sets", *[f"n_{a}_{b}" for a, b in zip(breaks, breaks[1:])])


def overlay_p(rows: DataFrame, own: DataFrame, keys: Sequence[str], p: str = "pval") -> DataFrame:
    """p of the own run where it has the key, else as it was."""
    return rows.join(own.select(*keys, F.col(p).alias("__own")), list(keys), "left").withColumn(p, F.coalesce("__own", p)).drop("__own")


def matched_null_test(rows: DataFrame, gene: str, stratum: str, min_p: str, candidate: str, least_pool: int = 20) -> DataFrame:
    """Empirical p of candidates: (1 + pool genes with at most that p) / (1 + pool), BH over candidates, ``small_pool`` flag.

    The pool is the genes of the stratum that are no candidates and have a p. The distinct p values of a stratum, with
    their pool genes counted, are summed in one sweep over ranges of both; candidates look their own value up in it.
    """
    asked = rows.where(F.col(candidate) & F.col(min_p).isNotNull())
    counted = rows.where(F.col(min_p).isNotNull()).groupBy(stratum, min_p).agg(F.count_if(~F.col(candidate)).alias("__k"))
    swept = running_totals(counted, [stratum], min_p, "__k", "n_le", "pool").drop("__k")
    side = swept.select(F.col(stratum).alias("__s"), F.col(min_p).alias("__p"), "n_le", "pool")
    out = asked.join(side, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col(min_p) == F.col("__p"))).drop("__s", "__p")
    out = out.withColumn("p_matched", (1 + F.col("n_le")) / (1 + F.col("pool"))).withColumn("small_pool", F.col("pool") < least_pool)
    return bh_adjust(out, "p_matched", name="padj")


def _t_tail(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a correlation by the t distribution, by the continued fraction of the incomplete beta function."""
    out = np.full(len(r), np.nan)
    from math import exp, lgamma, log

    for k, (x, m) in enumerate(zip(r, n)):
        if np.isnan(x) or m < 3:
            continue
        df = m - 2
        z = 1 - x * x  # df / (df + t^2)
        if z <= 0:
            out[k] = 0.0
            continue
        a, b = df / 2, 0.5

        def fraction(a: float, b: float, z: float) -> float:
            c, d = 1.0, 1 / max(1 - (a + b) * z / (a + 1), 1e-300)
            h = d
            for i in range(1, 500):
                even = i * (b - i) * z / ((a + 2 * i - 1) * (a + 2 * i))
                d, c = 1 / (1 + even * d), 1 + even / c
                h *= d * c
                odd = -(a + i) * (a + b + i) * z / ((a + 2 * i) * (a + 2 * i + 1))
                d, c = 1 / (1 + odd * d), 1 + odd / c
                h *= d * c
                if abs(d * c - 1) < 1e-14:
                    break
            return h

        if z >= 1:
            out[k] = 1.0
            continue
        front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(z) + b * log(1 - z))
        out[k] = front * fraction(a, b, z) / a if z < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - z) / b
    return out


def group_correlation(rows: DataFrame, keys: Sequence[str], x: str, y: str, method: str = "pearson", least: int = 4) -> DataFrame:
    """Correlation, n and p value per key; null with fewer than ``least`` pairs or without spread. Spearman uses average ranks."""

    @F.pandas_udf("double")
    def tail(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(_t_tail(r.to_numpy(float), n.to_numpy(float)))

    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if method == "spearman":
        for c in (x, y):
            ties = Window.partitionBy(*keys, c)
            rows = rows.withColumn(f"__{c}", F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(ties) - 1) / 2)
        rows = rows.select(*keys, F.col(f"__{x}").cast("double").alias(x), F.col(f"__{y}").cast("double").alias(y))
    t = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_samp(x, y).alias("__c"), F.stddev_samp(x).alias("__x"), F.stddev_samp(y).alias("__y"))
    r = F.when((F.col("n") >= least) & (F.col("__x") > 0) & (F.col("__y") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("__c") / (F.col("__x") * F.col("__y")))))
    return t.withColumn("r", r).withColumn("p", tail("r", "n")).withColumn("p", F.when(F.col("r").isNotNull(), F.col("p"))).select(*keys, "n", "r", "p")


def residual_z(rows: DataFrame, key: str, donor: str, x: str, y: str, index) -> DataFrame:
    """Per key: the index donor's y against the least-squares line of the others, over their residuals' SD (n - 1)."""
    others = rows.where(F.col(donor) != index)
    fit = others.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    spread = others.join(fit, key).groupBy(key).agg(F.stddev_samp(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).alias("sd"))
    own = rows.where(F.col(donor) == index).join(fit, key).join(spread, key)
    left = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
    return own.select(key, "slope", "intercept", left.alias("residual"), F.when(F.col("sd") > 0, left / F.col("sd")).alias("z"))


def permutation_null(observed: int, null: DataFrame, count: str) -> DataFrame:
    """One row over null counts: share at least the observed (no +1), mean, median, and p95 as the sorted value at int(0.95 n) - 1."""
    t = null.agg(F.sort_array(F.collect_list(count)).alias("v"))  # one number a shuffle
    return t.select(
        F.lit(observed).alias("observed"), (F.size(F.filter("v", lambda x: x >= observed)) / F.size("v")).alias("p"),
        (F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")).alias("mean"),
        ((F.get("v", ((F.size("v") - 1) / 2).cast("int")) + F.get("v", (F.size("v") / 2).cast("int"))) / 2).alias("median"),
        F.get("v", F.greatest((F.size("v") * 0.95).cast("int") - 1, F.lit(0))).alias("p95"))


def shuffled_sequences(rows: DataFrame, key: str, seq: str, n: int, seed: int) -> DataFrame:
    """(key, shuffle, seq): each sequence's letters in ``n`` seeded orders. The sequences are dealt out first, as a small
    file of them is much work."""
    t = rows.select(key, seq).repartition(shuffle_partitions(rows.sparkSession)).select(key, F.col(seq).alias("__s"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("shuffle"))
    letters = F.transform(F.sequence(F.lit(1), F.length("__s")), lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("shuffle").cast("string"), i.cast("string"))).alias("o"), F.substr("__s", i, F.lit(1)).alias("c")))
    return t.select(key, "shuffle", F.array_join(F.transform(F.sort_array(letters), lambda x: x["c"]), "").alias(seq))


def shuffle_test(rows: DataFrame, key: str, seq: str, scorer: Callable[[Column], Column], n: int, seed: int) -> DataFrame:
    """The permutation null of a count: ``scorer`` gives a number for each sequence, which is summed over the real ones and
    over each of ``n`` seeded shuffles of all; columns as :func:`permutation_null` has them."""
    total = F.sum(scorer(F.col(seq))).alias("n")
    observed = rows.agg(total).first()["n"]
    null = shuffled_sequences(rows, key, seq, n, seed)
    return permutation_null(observed, null.groupBy("shuffle").agg(total), "n")


def composition_null(frequencies: DataFrame, letter: str, freq: str, n: int, length: int, seed: int) -> DataFrame:
    """(k, seq): n sequences of letters drawn by frequency; an alphabet's cumulative frequencies are one small array."""
    w = Window.orderBy(letter)
    cum = frequencies.withColumn("c", F.sum(freq).over(w) / F.sum(freq).over(Window.partitionBy())).agg(F.sort_array(F.collect_list(F.struct("c", F.col(letter).alias("l")))).alias("t"))
    draws = frequencies.sparkSession.range(n).withColumnRenamed("id", "k").join(F.broadcast(cum), how="cross")
    uniform = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("k").cast("string"), i.cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)
    pick = lambda i: F.coalesce(F.get(F.filter("t", lambda x: x["c"] > uniform(i)), F.lit(0))["l"], F.element_at("t", -1)["l"])
    return draws.select("k", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), pick), "").alias("seq"))


def taxa_recurrence(hits: DataFrame, organism: str, shuffle: str, top: int = 12) -> DataFrame:
    """The organisms hit in most shuffles. A top-k report."""
    return hits.groupBy(organism).agg(F.count_distinct(shuffle).alias("n_shuffles")).orderBy(F.col("n_shuffles").desc(), organism).limit(top)


def _reaches(mean: Column, top: Column) -> Column:
    """Whether a mean of logarithms is the top one but for rounding, which depends on the order of its terms."""
    return (mean == top) | (mean >= top - 1e-12 * F.greatest(F.lit(1.0), F.abs(top)))


def marker_select(values: DataFrame, gene: str, cls: str, value: str, n: int = 10, ratio: float = 0.0) -> DataFrame:
    """Per class the n genes whose log2 value stands highest above the largest other class's, by at least ``ratio``.

    Of classes that reach the highest equally, the last one has the gene, with a lead of 0.
    """
    means = values.groupBy(gene, cls).agg(F.avg(F.log2(F.col(value) + 1)).alias("m"))
    top = means.groupBy(gene).agg(F.sort_array(F.collect_list(F.struct("m", cls)), False).alias("t"))
    best, other = F.get("t", F.lit(0)), F.coalesce(F.get("t", F.lit(1))["m"], F.lit(0.0))
    level = F.filter("t", lambda x: _reaches(x["m"], best["m"]))
    own = top.select(gene, F.when(F.size(level) > 1, F.array_max(F.transform(level, lambda x: x[cls]))).otherwise(best[cls]).alias(cls), F.when(F.size(level) > 1, 0.0).otherwise(best["m"] - other).alias("lead"))
    w = Window.partitionBy(cls).orderBy(F.col("lead").desc(), gene)
    return own.where(F.col("lead") >= ratio).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def marker_purity(markers: DataFrame, values: DataFrame, gene: str, cls: str, value: str) -> DataFrame:
    """Per class of the markers: how many there are, and the share of them whose mean log2 value is highest in that class.

    A gene that another class reaches equally, whatever the rounding of both sums, is not highest.
    """
    means = values.groupBy(gene, cls).agg(F.avg(F.log2(F.col(value) + 1)).alias("m"))
    top = means.groupBy(gene).agg(F.max("m").alias("top"))
    best = means.join(top, gene).where(_reaches(F.col("m"), F.col("top"))).groupBy(gene).agg(F.collect_list(cls).alias("__in"))
    t = markers.select(gene, cls).distinct().join(best, gene, "left")
    alone = F.coalesce((F.size("__in") == 1) & F.array_contains("__in", F.col(cls)), F.lit(False))
    return t.groupBy(cls).agg(F.count("*").alias("n_markers"), F.avg(alone.cast("double")).alias("highest"))


def proportions_closed_form(mixture: DataFrame, reference: DataFrame, markers: DataFrame, sample: str, gene: str, cls: str, value: str) -> DataFrame:
    """Class proportions per sample from marker means on the log scale, summing to 1. An approximation, not a solver."""
    ref = reference.groupBy(gene, cls).agg(F.avg(F.log2(F.col(value) + 1)).alias("r"))
    t = mixture.join(markers.select(gene, cls), gene).join(ref, [gene, cls])
    d = t.groupBy(sample, cls).agg(F.pow(F.lit(2.0), F.avg(F.log2(F.col(value) + 1) - F.col("r"))).alias("e"))
    return d.withColumn("proportion", F.col("e") / F.sum("e").over(Window.partitionBy(sample))).drop("e")
