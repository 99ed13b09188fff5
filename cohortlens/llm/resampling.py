"""Importance resampling towards a target: documents are drawn by how their hashed word pairs resemble the target's.

Features are the words of a text and its pairs of neighbouring words; a feature's bucket is its CRC-32 modulo the
number of buckets. A bucket's gain compares how often the target and the corpus use it, a document's weight is the
mean gain of its features, and Gumbel noise from a hash of its id makes the highest sums a weighted draw.

The corpus is counted by segments: line ends are separators, so they cut texts into lines. Equal lines are counted
first, the features of each distinct line are computed once and multiplied by its occurrences, and the pairs that
reach over a line end are added from the texts themselves. CRCs of pairs come from those of their words, since the
CRC of a concatenation is a linear function of both parts' CRCs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.textops import Words, pieces, split_words
from cohortlens.runtime import Scratch, shuffle_partitions, with_fields

#: Words of more bytes take the library's CRC one by one.
LONG_WORD = 64
_LINE_END = 0x0A


def _lowered() -> np.ndarray:
    """Byte by byte: A-Z to a-z, word bytes (0-9, a-z, above ASCII) as they are, all others to a blank."""
    out = np.full(256, 0x20, dtype=np.uint8)
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    out[keep] = keep
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


_LOWERED = _lowered()


def lower_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of every text, A-Z lower-cased, and for each word whether a line end lies between it and the word before it in its text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    own = np.ascontiguousarray(offsets - offsets[0])
    words = split_words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(own), pa.py_buffer(_LOWERED[raw])]))
    if not len(words.start):
        return words, np.zeros(0, dtype=bool)
    ends = np.searchsorted(np.flatnonzero(raw == _LINE_END), words.start)  # line ends before each word
    crosses = np.concatenate(([False], ends[1:] > ends[:-1]))
    crosses[words.first[:-1][words.count > 0]] = False
    return words, crosses


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The CRC-32 byte table; per number n of zero bytes the four tables that carry a CRC over them; the CRC of a blank carried over n bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    step = lambda s: table[s & np.uint32(255)] ^ (s >> np.uint32(8))
    shifts = np.empty((LONG_WORD + 2, 4, 256), dtype=np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], dtype=np.uint32)[:, None]
    blank = np.empty(LONG_WORD + 2, dtype=np.uint32)
    blank[0] = zlib.crc32(b" ")
    for n in range(1, LONG_WORD + 2):
        shifts[n], blank[n] = step(shifts[n - 1]), step(blank[n - 1 : n])[0]
    return table, shifts, blank


def word_crcs(words: Words) -> np.ndarray:
    """CRC-32 of each word's bytes, all words side by side, a byte at a time."""
    table = _tables()[0]
    size = words.end - words.start
    order = np.argsort(-size, kind="stable")
    start, longest_first = words.start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(min(int(longest_first[0]), LONG_WORD) if len(order) else 0):
        n = int(np.searchsorted(-longest_first, -i))  # words longer than i bytes
        crc[:n] = table[(crc[:n] ^ words.buf[start[:n] + i]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = ~crc
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = zlib.crc32(words.buf[words.start[k] : words.end[k]])
    return out


def pair_crcs(words: Words, crcs: np.ndarray, second: np.ndarray) -> np.ndarray:
    """CRC-32 of "word before, blank, word" for each word number in ``second``."""
    _, shifts, blank = _tables()
    first, n = crcs[second - 1], (words.end - words.start)[second]
    short = np.minimum(n, LONG_WORD)
    over = short + 1
    carried = shifts[over, 0, first & 255] ^ shifts[over, 1, first >> 8 & 255] ^ shifts[over, 2, first >> 16 & 255] ^ shifts[over, 3, first >> 24]
    out = carried ^ blank[short] ^ crcs[second]
    for k in np.flatnonzero(n > LONG_WORD):
        out[k] = zlib.crc32(words.buf[words.start[second[k]] : words.end[second[k]]], zlib.crc32(b" ", int(first[k])))
    return out


def _has_before(words: Words) -> np.ndarray:
    """For each word whether its text has a word before it."""
    out = np.ones(len(words.start), dtype=bool)
    out[words.first[:-1][words.count > 0]] = False
    return out


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def bucket_counts(rows: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a null text has none.

    Equal lines are counted by a grouping that combines in the tasks first, so a common line is no hot group.
    """
    lines = rows.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("times"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "line"):
                words, _ = lower_words(part["line"])
                times = np.repeat(np.asarray(part["times"]), words.count)
                crcs, second = word_crcs(words), np.flatnonzero(_has_before(words))
                for crc, n in ((crcs, times), (pair_crcs(words, crcs, second), times[second])):
                    np.add.at(total, crc % np.uint32(buckets), n)
        yield _sparse(total)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, text_col):
                words, crosses = lower_words(part[text_col])
                second = np.flatnonzero(crosses)
                ends = np.union1d(second, second - 1)  # only words next to a line end
                crcs = np.zeros(len(words.start), dtype=np.uint32)
                crcs[ends] = word_crcs(Words(words.buf, words.start[ends], words.end[ends], words.first))
                total += np.bincount(pair_crcs(words, crcs, second) % np.uint32(buckets), minlength=buckets)
        yield _sparse(total)

    found = lines.mapInArrow(inside, "bucket int, n long").unionByName(rows.select(text_col).mapInArrow(across, "bucket int, n long"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of the B buckets, in doubles."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * float(s_all + b) / ((s + 1.0) * float(t_all + b))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target)], dtype=np.int64)


def with_weights(rows: DataFrame, gains: np.ndarray, text_col: str = "text") -> DataFrame:
    """Adds ``n_words``, ``n_features`` and ``weight``, the floored mean gain of a text's features (0 without any), and drops the text."""
    kept = [c for c in rows.columns if c not in (text_col, "n_words", "n_features", "weight")]
    shared = rows.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in pieces(batch, text_col):
                words, _ = lower_words(part[text_col])
                crcs, second = word_crcs(words), np.flatnonzero(_has_before(words))
                each = gain[crcs % np.uint32(len(gain))]
                each[second] += gain[pair_crcs(words, crcs, second) % np.uint32(len(gain))]
                running = np.concatenate(([0], np.cumsum(each)))
                total = running[words.first[1:]] - running[words.first[:-1]]
                n = np.maximum(2 * words.count - 1, 0)
                columns = [words.count, n, total // np.maximum(n, 1)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *(pa.array(c, pa.int64()) for c in columns)], names=[*kept, "n_words", "n_features", "weight"])

    return rows.select(*[f"`{c}`" for c in kept], f"`{text_col}`").mapInArrow(run, with_fields(rows.select(*[f"`{c}`" for c in kept]).schema, "n_words long, n_features long, weight long"))


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h the first 8 hexadecimal digits of sha256("seed:id")."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), "UTF-8"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` to the rows, and drops the text.

    Of the rows with at least ``least_words`` words, ``percent`` in 100 (rounded down) are drawn: those with the
    highest scores, ties to smaller ids, null ids last. ``rank`` counts them from 1, others have null. Rows that
    repeat an id are rows of their own with equal noise. A null text has no features and weight 0; a null id hashes
    like an empty one. An empty table gives an empty one, an empty target counts 0 everywhere. Columns of the input
    with the new names are replaced.

    Rows are ordered by ranges without their texts; places within a range and the sizes of the ranges before it
    make the ranks, so no task sees all rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    docs = docs.drop(*[c for c in ("score", "rank") if c in docs.columns])
    scored = scratch.keep(with_weights(docs, gains, text_col), "weights")
    names = [*scored.columns, "score", "rank"]
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col(f"`{id_col}`"), seed)).withColumn("__late", F.col("n_words") < least_words)
    order = [F.col("__late"), F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last()]
    ordered = scored.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ordered = scratch.keep(ordered.withColumn("__at", F.monotonically_increasing_id()), "order")  # range in the high bits, place in the low 33
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.count_if(~F.col("__late")).alias("__able"))
    along = Window.orderBy("__part")  # over one row a range
    before = F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    draws = F.floor(F.lit(percent) * F.sum("__able").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / 100)
    sizes = sizes.select("__part", before.alias("__before"), draws.alias("__draws"))
    placed = ordered.join(F.broadcast(sizes), part == F.col("__part"))
    place = F.col("__before") + F.col("__at").bitwiseAND(2**33 - 1) + 1
    return placed.withColumn("rank", F.when(~F.col("__late") & (place <= F.col("__draws")), place)).select(*[f"`{c}`" for c in names])


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's features, weight, score and rank in the draw of a quarter towards ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def _crc_by_nibbles() -> list[int]:
    out = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return out


OP13_SQL = rf"""
WITH cut AS (
    SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), used AS (
    SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM cut
), hashed AS (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h)), lambda i: strpos('0123456789ABCDEF', substr(h, i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END, 1)) - 1)),
        lambda a, x: xor(a >> 4, {_crc_by_nibbles()}[1 + (xor(a, x) & 15)])), 4294967295) % 10000 AS bucket
    FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM used))
), counted AS (
    SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM used JOIN hashed USING (f) GROUP BY bucket
), total AS (
    SELECT CAST(sum(s) + 10000 AS DOUBLE) AS s_all, CAST(sum(t) + 10000 AS DOUBLE) AS t_all FROM counted
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * s_all / ((s + 1.0::DOUBLE) * t_all))) AS BIGINT) AS gain FROM counted, total
), weighed AS (
    SELECT id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM used JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
    SELECT id AS doc_id, len(w) AS n_words, CAST(greatest(2 * len(w) - 1, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM cut LEFT JOIN weighed USING (id) WHERE side = 'd'
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_words >= 20 AND row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id) <= 25 * (count(*) FILTER (n_words >= 20) OVER ()) // 100
        THEN row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id) END AS rank
FROM scored
"""
