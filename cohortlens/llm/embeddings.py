"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is padded to ``WIDTH`` dimensions and rotated at random; its code is the signs, its correction factor
the inner product of the vector with its code. From x's code and y's rotated vector comes an unbiased estimate of
their inner product with a confidence bound. Pairs meet in buckets: bands of sign bits, so many that a pair at the
threshold shares one with probability 1 - 1e-5, and so wide that a bucket of unrelated vectors stays small. A pair
is judged in the first band that it shares, so it counts once. Only codes, factors, band bits and vectors rounded
to 8 bits travel to buckets. There a pair goes if an upper bound (either way) is below the threshold; what is left
is bounded by the rounded vectors, for certain. Pairs above the threshold by that are linked, those below it go,
and just the pairs that the bounds leave open are recomputed from the vectors in double precision.

Buckets are dealt in blocks, and a block tells counts of links, a spanning forest and, for each vector with an open
pair, a bit mask of its partners: never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.jaccard import _by_key, _forest, _paired
from cohortlens.operators.graph import connected_components
from cohortlens.runtime import Scratch, shuffle_partitions

WIDTH = 256
#: Standard errors of the confidence bound.
SURE = 4.5
#: Vectors in a block of a bucket.
BLOCK = 256


@cache
def _rotation(dims: int, seed: int) -> np.ndarray:
    """The first ``dims`` rows of a random rotation of ``max(WIDTH, dims)`` dimensions."""
    width = max(WIDTH, dims)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:dims]


@cache
def _planes(dims: int, bits: int) -> np.ndarray:
    rounds = math.ceil(bits / max(WIDTH, dims))
    return np.concatenate([_rotation(dims, 1000 + k) for k in range(rounds)], axis=1)[:, :bits]


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes (-1, 1) of unit vectors, scaled to length one, and their correction factors."""
    turned = unit @ _rotation(unit.shape[1], 1)
    sign = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(turned.shape[1])
    return sign, (sign * turned).sum(axis=1)


def bounds(sign: np.ndarray, factor: np.ndarray, unit: np.ndarray, sure: float = SURE) -> tuple[np.ndarray, np.ndarray]:
    """Estimates [i, j] of the inner product of vectors i and j from the code of i and the vector j, and their errors."""
    turned = unit @ _rotation(unit.shape[1], 1)
    estimate = sign @ turned.T / factor[:, None]
    error = sure * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (turned.shape[1] - 1))
    return estimate, np.broadcast_to(error[:, None], estimate.shape)


def bands_for(largest: int, threshold: float, missed: float = 1e-5) -> tuple[int, int]:
    """Bits of a band and number of bands for a label with ``largest`` vectors; both grow with it."""
    bits = min(62, max(4, math.ceil(math.log2(max(largest, 1) / 64 + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - agree))


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors rounded to 8 bits, and the size of a step of each."""
    step = np.abs(unit).max(axis=1) / 127
    return np.rint(unit / step[:, None]).astype(np.int8), step


def certain_bounds(small: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of all pairs of rounded vectors, and how far the true ones can be off at most."""
    x = small * step[:, None]
    length = np.abs(x).sum(axis=1)
    half = step / 2
    room = half[:, None] * length[None] + half[None] * length[:, None] + half[:, None] * half[None] * x.shape[1]
    return x @ x.T, room + 1e-9


def _stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _told(key: dict[str, int], cid: np.ndarray, linked: np.ndarray, size: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
    """What a block tells: per vector with a link or an open pair its links (in rows), the first of its tree, its open partners."""
    at = np.flatnonzero((linked | open_).any(axis=1))
    root = _forest(linked)[at]
    mask = [x.tobytes() if x.any() else None for x in np.packbits(open_[at], axis=1)]
    columns = [pa.array(np.full(len(at), v), pa.int64()) for v in key.values()]
    columns += [pa.array(at), pa.array(cid[at]), pa.array(cid[root]), pa.array((linked[at] @ size).astype(np.int64)), pa.array(mask, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[*key, "place", "cid", "root", "links", "mask"])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row (id_col, n_links, component_id, kept) for every vector.

    Vectors with equal labels are linked if their cosine in double precision is at least ``threshold``. A null
    label, and a vector that is null, empty, zero or holds null or non-finite components, links with nothing, nor
    do vectors of different lengths. ``component_id`` is the smallest id reachable by links; a null id never names
    a component that has another. Equal vectors of a label are compared once. Rows that repeat an id are vectors of
    their own. Other columns are ignored. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    scratch = Scratch(spark, "vectors")
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    sound = F.col("label").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select("*", F.coalesce(sound, F.lit(False)).alias("sound"))
    # a class: equal vectors of a label and length, by two independent hashes; it is numbered as it is written
    keyed = rows.where("sound").select("id", F.xxhash64("label", "v").alias("k1"), F.xxhash64("v", F.lit(1), "label").alias("k2"), "label", "v")
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = scratch.keep(classes.select("*", F.xxhash64("label", F.size("v")).alias("part"), F.monotonically_increasing_id().alias("cid")), "classes")
    largest = classes.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    bits, bands = bands_for(largest, threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            part = np.asarray(batch["part"])
            for group in np.unique(part):
                own = batch.filter(pa.array(part == group))
                for a in range(0, own.num_rows, 2048):
                    b = own.slice(a, 2048)
                    unit = _unit(_stacked(b["v"]))
                    sign, factor = codes(unit)
                    small, step = rounded(unit)
                    side = unit @ _planes(unit.shape[1], bits * bands) >= 0
                    band = (side.reshape(len(unit), bands, bits) @ power).astype(np.int64)
                    packed = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (np.packbits(sign > 0, axis=1), small, np.packbits(side, axis=1))]
                    yield pa.RecordBatch.from_arrays([b["cid"], b["part"], b["size"], packed[0], pa.array(factor), packed[1], pa.array(step), packed[2], pa.array(band.tolist(), pa.list_(pa.int64()))], names=["cid", "part", "size", "code", "factor", "small", "step", "sides", "band"])

    coded = classes.select("cid", "part", "size", "v").mapInArrow(encode, "cid long, part long, size long, code binary, factor double, small binary, step double, sides binary, band array<long>")
    coded = scratch.keep(coded, "codes")
    spread = coded.select("cid", "part", F.posexplode("band").alias("k", "value")).select("cid", "k", F.xxhash64("part", "k", "value").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("members"), F.min("k").alias("k"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("mark")).where("members > 1")
    once = sizes.groupBy("members", "mark").agg(F.min(F.struct("k", "bucket")).alias("first"))  # of buckets with equal members the first band's
    once = once.select(F.col("first.bucket").alias("bucket"), "members")
    held = scratch.keep(spread.join(once, "bucket"), "buckets")
    held = _paired(held, "members", BLOCK).join(coded.drop("band", "part"), "cid")

    def unpacked(column: pa.Array, kind=np.uint8) -> np.ndarray:
        return np.stack([np.frombuffer(x, kind) for x in column.to_pylist()])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits, dtype=np.int64)
        for (bucket, bi, bj), t in _by_key(batches, ["bucket", "bi", "bj"]):
            t = t.combine_chunks()
            cid, own, size, k = (np.asarray(t[c]) for c in ("cid", "own", "size", "k"))
            small, step = unpacked(t["small"], np.int8), np.asarray(t["step"])
            width = max(WIDTH, small.shape[1])
            sign = (np.unpackbits(unpacked(t["code"]), axis=1)[:, :width] * 2.0 - 1) / math.sqrt(width)
            guess, error = bounds(sign, np.asarray(t["factor"]), small * step[:, None])
            most = guess + error + 0.02  # the rotated vectors are rounded ones here
            near = np.triu((most >= threshold) & (most.T >= threshold), 1)
            if bi != bj:
                near &= own[:, None] != own[None]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            inner, room = certain_bounds(small, step)
            upper = inner[a, b] + room[a, b] >= threshold
            a, b = a[upper], b[upper]
            band = np.unpackbits(unpacked(t["sides"]), axis=1)[:, : bits * bands].reshape(len(cid), bands, bits) @ power
            met = np.zeros(len(a), dtype=bool)
            for earlier in range(int(k[0])):
                met |= band[a, earlier] == band[b, earlier]
            a, b = a[~met], b[~met]
            sure = inner[a, b] - room[a, b] >= threshold
            linked, open_ = np.zeros((2, len(cid), len(cid)), dtype=bool)
            linked[a[sure], b[sure]] = open_[a[~sure], b[~sure]] = True
            yield _told({"bucket": bucket, "bi": bi, "bj": bj, "wide": len(cid)}, cid, linked | linked.T, size, open_ | open_.T)

    told = held.repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj").mapInArrow(judge, "bucket long, bi long, bj long, wide long, place long, cid long, root long, links long, mask binary")
    told = scratch.keep(told, "told")
    scratch.drop("buckets", "codes")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_key(batches, ["bucket", "bi", "bj"]):
            t = t.combine_chunks()
            cid, size, place = (np.asarray(t[c]) for c in ("cid", "size", "place"))
            x = _unit(_stacked(t["v"]))
            open_ = np.unpackbits(unpacked(t["mask"]), axis=1)[:, : t["wide"][0].as_py()][:, place].astype(bool)
            linked = open_ & (x @ x.T >= threshold)
            yield _told({}, cid, linked, size, np.zeros_like(linked)).select(["cid", "root", "links"])

    asked = told.where("mask is not null").select("bucket", "bi", "bj", "wide", "place", "cid", "mask").join(classes.select("cid", "size", "v"), "cid")
    settled = asked.repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj").mapInArrow(exact, "cid long, root long, links long")
    linked = scratch.keep(told.where("links > 0").select("cid", "root", "links").unionByName(settled), "linked")
    groups = connected_components(linked.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    groups = groups.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    names = groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    counts = linked.groupBy(F.col("cid").alias("node")).agg(F.sum("links").alias("links"))
    found = groups.join(names, "component").join(counts, "node", "left").select(F.col("node").alias("cid"), "component_id", "links")
    known = classes.select("cid", "k1", "k2", "rep", "size").join(found, "cid", "left")
    known = scratch.keep(known.select("k1", "k2", F.coalesce("component_id", "rep").alias("component_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    scratch.drop("told", "linked", "classes")
    judged = keyed.select("id", "k1", "k2").join(known, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return judged.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding; cosine of 0.93 or more within a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
