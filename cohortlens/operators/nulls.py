"""Null distributions of running-sum scores: seeded draws of ranks in blocks, and splitting for small p values.

The null of a score depends on the ranking and on the set's size alone, so one draw of ranks serves all sizes: its
first k ranks are a set of size k. A ranking is kept as chunks of weights; ranks are drawn for requests (a ranking, maybe
without some of its ranks, and the sizes wanted), go to the chunks that they lie in to look up their weights, and a
block of draws is then scored as one matrix. So no task holds a ranking, whatever its length, and rows are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.runtime import shuffle_partitions

#: Ranks whose weights are one row.
CHUNK = 1 << 16
#: Draws that are scored together, fewer where sets are so large that a block would have more entries.
DRAWS, ENTRIES = 250, 1 << 20
#: Units of splitting that share one copy of a pool.
SHARE = 8
#: Drawn ranks that share one copy of a chunk.
LOOKUPS = 1 << 20
#: A chain proposes ranks from so many of a longer ranking, evenly spaced over it.
POOL = 1 << 16


def weight_chunks(ranked: DataFrame, base: Sequence[str]) -> DataFrame:
    """(base, chunk, first, weights): |stat| by rank, ``first`` the first rank of the chunk. Ranks count from 1 without gaps."""
    entry = F.struct("rank", F.abs("stat").cast("double").alias("w"))
    t = ranked.groupBy(*base, F.floor((F.col("rank") - 1) / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(entry)).alias("__e"))
    return t.select(*base, "chunk", (F.col("chunk") * CHUNK + 1).alias("first"), F.transform("__e", lambda x: x["w"]).alias("weights"))


def _apart(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows with columns of their own, keys prefixed, so that they can meet rows of the same origin."""
    return df.select(*[F.col(c).alias(f"__of_{c}" if c in keys else c) for c in df.columns])


def _scores_of(ranks: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Score of the set in each row: its ranks (from 1, of n, ascending) and their weights."""
    k = ranks.shape[1]
    up = np.cumsum(weights, axis=1)
    total = np.where(up[:, -1:] > 0, up[:, -1:], 1.0)
    miss = (ranks - np.arange(1, k + 1)) / (n - k) if n > k else np.zeros(ranks.shape)
    top, bottom = (up / total - miss).max(axis=1), ((up - weights) / total - miss).min(axis=1)
    return np.where(top > -bottom, top, np.where(top < -bottom, bottom, 0.0))


def null_scores(ranks: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """Scores of the sets made of the first ``size`` ranks of each draw (a row; ranks from 1, of n)."""
    along = np.argsort(ranks[:, :size], axis=1)
    return _scores_of(np.take_along_axis(ranks, along, axis=1), np.take_along_axis(weights, along, axis=1), n)


def _draw(seed: int, draw: int, n: int, most: int) -> np.ndarray:
    """The first ``most`` ranks of a seeded order of 1..n; rankings of equal length share draws."""
    return np.random.default_rng([seed, draw]).choice(n, most, replace=False) + 1


def original_ranks(ranks: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """Ranks in the whole ranking of ranks in the one without ``removed`` (ascending)."""
    return ranks + np.searchsorted(removed - np.arange(len(removed)), ranks, side="right") if len(removed) else ranks


def null_blocks(chunks: DataFrame, requests: DataFrame, base: Sequence[str], ids: Sequence[str], n_perm: int, seed: int) -> DataFrame:
    """(ids, block, size, nulls): for each request and size its null scores, an array of a block of draws each.

    ``requests`` has the base columns (which name the ranking), the ids, ``n`` (ranks after removal), ``sizes`` (array) and
    ``removed`` (ascending array of ranks that do not take part). ``ids`` include what of the base is needed. Ranks are
    drawn once and dealt to the chunks that they lie in, where their weights are looked up: a chunk is copied only for
    each LOOKUPS of them, so the work is that of the draws, whatever the length of the ranking.
    """
    count = F.ceil(F.lit(n_perm) / F.col("__draws")).cast("int")
    work = requests.withColumn("__most", F.array_max("sizes")).where("__most <= n")
    work = work.withColumn("__draws", F.greatest(F.lit(1), F.least(F.lit(DRAWS), F.floor(F.lit(ENTRIES) / F.col("__most")))).cast("int"))
    work = work.withColumn("block", F.explode(F.sequence(F.lit(0), count - 1)))
    work = work.withColumn("rows", F.least(F.col("__draws"), F.lit(n_perm) - F.col("block") * F.col("__draws")).cast("int"))
    long = chunks.groupBy(*base).agg(F.sum(F.size("weights")).alias("__long"))
    shares = work.groupBy(*base).agg(F.sum(F.col("rows") * F.col("__most")).alias("__looked")).join(long, list(base))
    shares = shares.select(*base, F.ceil(F.col("__looked") * F.least(F.lit(1.0), F.lit(float(CHUNK)) / F.col("__long")) / LOOKUPS).cast("int").alias("__shares"))
    asked = work.drop("sizes").join(shares, list(base)).withColumn("__share", F.pmod(F.xxhash64(*ids, "block"), F.col("__shares")).cast("int")).drop("__shares")
    asked = asked.repartition(shuffle_partitions(chunks.sparkSession)).sortWithinPartitions("n", "__most", "block")  # requests of the same draws in a row
    keys = [*base, "chunk", "__share"]
    copies = _apart(chunks.join(shares, list(base)).withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares"), keys)
    kinds = dict(asked.dtypes) | {"chunk": "long"}
    own, named = (", ".join(f"`{c}` {kinds[c]}" for c in cols) for cols in (dict.fromkeys([*keys, *ids]), ids))
    columns = list(dict.fromkeys([*keys, *ids]))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ranks, out, held = None, None, [], 0
        for frame in frames:
            for row in frame.to_dict("records"):
                low = row["block"] * row["__draws"]
                if last != (last := (row["n"], row["__most"], low, row["rows"])):
                    ranks = np.stack([_draw(seed, d, row["n"], row["__most"]) for d in range(low, low + row["rows"])]).ravel()
                at = original_ranks(ranks, np.asarray(row["removed"], dtype=np.int64)) - 1
                chunk = at // CHUNK
                along = np.argsort(chunk, kind="stable")
                there, first = np.unique(chunk[along], return_index=True)
                for k, place in zip(there.tolist(), np.split(along, first[1:])):
                    row["chunk"] = k
                    out.append([row[c] for c in columns] + [row["block"], place.astype(np.int32), (at[place] - k * CHUNK).astype(np.int32)])
                held += len(at)
                if held > ENTRIES:
                    yield pd.DataFrame(out, columns=[*columns, "block", "place", "at"])
                    out, held = [], 0
        yield pd.DataFrame(out, columns=[*columns, "block", "place", "at"])

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[[*dict.fromkeys(ids), "block", "chunk", "place", "at"]].copy()
        left["weights"] = None
        if len(left):
            weights = np.asarray(right["weights"].iloc[0], dtype=np.float64)
            left["weights"] = [weights[at] for at in left["at"]]
        return left

    def score(group: pd.DataFrame, request: pd.DataFrame) -> pd.DataFrame:
        one = request.iloc[0]
        most, n, removed = int(one["__most"]), int(one["n"]), np.asarray(one["removed"], dtype=np.int64)
        ranks, weights = np.zeros(one["rows"] * most, dtype=np.int64), np.zeros(one["rows"] * most)
        for k, place, at, w in zip(group["chunk"], group["place"], group["at"], group["weights"]):
            rank = k * CHUNK + 1 + np.asarray(at, dtype=np.int64)
            ranks[place], weights[place] = rank - np.searchsorted(removed, rank), w
        ranks, weights = ranks.reshape(-1, most), weights.reshape(-1, most)
        rows = [[one[f"__of_{c}"] for c in ids] + [one["__of_block"], size, null_scores(ranks[:, :size], weights[:, :size], n, size)] for size in map(int, one["sizes"])]
        return pd.DataFrame(rows, columns=[*ids, "block", "size", "nulls"])

    drawn = asked.mapInPandas(draw, f"{own}, block int, place array<int>, at array<int>")
    looked = drawn.groupBy(*keys).cogroup(copies.groupBy(*[f"__of_{c}" for c in keys])).applyInPandas(look, f"{named}, block int, chunk long, place array<int>, at array<int>, weights array<double>")
    wanted = _apart(work.select(*ids, "block", "n", "sizes", "removed", "__most", "rows"), [*ids, "block"])
    return looked.groupBy(*ids, "block").cogroup(wanted.groupBy(*[f"__of_{c}" for c in (*ids, "block")])).applyInPandas(score, f"{named}, block int, size long, nulls array<double>")


def split_tail(weights: np.ndarray, ranks: np.ndarray, n: int, size: int, sign: int, targets: np.ndarray, chains: int, seed: int, least: float) -> np.ndarray:
    """P(sign * score >= target) for each target, of random sets of ``size`` ranks, by adaptive multilevel splitting.

    Chains start as random sets. Each round, those at or below the median go on as copies of chains above it, at
    the price of the share that is left, and all are moved by swapping members for other ranks as long as their
    score stays above that median. A target is reached once most chains are there. Estimates are unbiased; they
    stop at ``least``.
    """
    rng = np.random.default_rng([seed, size, sign + 1])
    pool = len(ranks)
    state = np.stack([rng.choice(pool, size, replace=False) for _ in range(chains)])

    def value(s: np.ndarray) -> np.ndarray:
        s = np.sort(s, axis=1)  # ranks ascend with their places
        return sign * _scores_of(ranks[s], weights[s], n)

    now, out, left, p = value(state), np.empty(len(targets)), list(np.argsort(targets)), 1.0
    cut, step = (chains + 1) // 2, max(1, size // 10)
    while left:
        level = np.sort(now)[cut - 1]
        while left and (level >= targets[left[0]] or p < least):
            out[left[0]] = max(least, p * (now >= targets[left[0]]).mean())
            left.pop(0)
        above = np.flatnonzero(now > level)
        if not left or not len(above):
            break
        p *= len(above) / chains
        low = np.flatnonzero(now <= level)
        source = above[rng.integers(0, len(above), len(low))]
        state[low], now[low] = state[source], now[source]
        moved = tried = 0
        while moved < size * chains and tried < 20 * size:
            trial = state.copy()
            spots = rng.integers(0, size, (chains, step))
            np.put_along_axis(trial, spots, rng.integers(0, pool, (chains, step)), axis=1)
            s = np.sort(trial, axis=1)
            score = value(trial)
            ok = (score > level) & (s[:, 1:] != s[:, :-1]).all(axis=1)
            state[ok], now[ok] = trial[ok], score[ok]
            moved, tried = moved + step * int(ok.sum()), tried + step
            if step > 1 and ok.mean() < 0.15:
                step = max(1, step // 2)
    for k in left:
        out[k] = max(least, p * (now >= targets[k]).mean())
    return out


def tail_p(chunks: DataFrame, units: DataFrame, base: Sequence[str], ids: Sequence[str], chains: int, seed: int, least: float) -> DataFrame:
    """(ids, size, up, es, tail): P(score >= es) where ``up``, else P(score <= es), for each score of each unit.

    ``units`` has the base, the ids, ``n``, ``removed``, ``size``, ``up`` (the sign) and ``scores`` (array). A longer
    ranking than POOL is thinned evenly, its ranks kept, so a chain's memory does not grow with the ranking.
    """
    long = chunks.groupBy(*base).agg(F.sum(F.size("weights")).alias("__n"))
    at = lambda i: F.floor((F.col("first") + i - 1) * F.least(F.lit(1.0), F.lit(float(POOL)) / F.col("__n")))
    entries = F.filter(F.transform("weights", lambda w, i: F.when(at(i) != at(i - 1), F.struct((F.col("first") + i).alias("r"), w.alias("w")))), lambda x: x.isNotNull())
    thin = chunks.join(long, list(base)).withColumn("__x", F.when(F.col("__n") <= POOL, F.transform("weights", lambda w, i: F.struct((F.col("first") + i).alias("r"), w.alias("w")))).otherwise(entries))
    pool = thin.groupBy(*base).agg(F.array_sort(F.flatten(F.collect_list("__x"))).alias("__x")).select(*base, F.col("__x.r").alias("ranks"), F.col("__x.w").alias("weights"))
    spread = units.groupBy(*base).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("__shares"))
    asked = units.join(spread, list(base)).withColumn("__share", F.pmod(F.xxhash64(*ids, "size", "up"), F.col("__shares")).cast("int")).drop("__shares")
    copies = pool.join(spread, list(base)).withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
    keys = [*base, "__share"]
    copies = _apart(copies, keys)
    kinds = dict(units.dtypes)
    own = ", ".join(f"`{c}` {kinds[c]}" for c in ids)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            ranks, weights = np.asarray(right["ranks"].iloc[0], dtype=np.int64), np.asarray(right["weights"].iloc[0], dtype=np.float64)
            removed = np.asarray(row["removed"], dtype=np.int64)
            if len(removed):
                kept = ~np.isin(ranks, removed)
                ranks, weights = ranks[kept], weights[kept]
                ranks = ranks - np.searchsorted(removed, ranks)
            es, size = np.asarray(row["scores"], dtype=np.float64), int(row["size"])
            if size > len(ranks):
                continue
            sign = 1 if row["up"] else -1
            out += [[row[c] for c in ids] + [size, row["up"], e, t] for e, t in zip(es, split_tail(weights, ranks, int(row["n"]), size, sign, sign * es, chains, seed, least))]
        return pd.DataFrame(out, columns=[*ids, "size", "up", "es", "tail"])

    return asked.groupBy(*keys).cogroup(copies.groupBy(*[f"__of_{c}" for c in keys])).applyInPandas(run, f"{own}, size long, up boolean, es double, tail double")


def null_counts(nulls: Column, es: Column) -> tuple[Column, Column, Column]:
    """Of an array of null scores: how many have the sign of the score, how many of these are as extreme, and the sum of their magnitudes."""
    same = F.filter(nulls, lambda x: F.when(es >= 0, x >= 0).otherwise(x < 0))
    far = F.filter(same, lambda x: F.abs(x) >= F.abs(es))
    return F.size(same), F.size(far), F.aggregate(same, F.lit(0.0), lambda a, x: a + F.abs(x))
