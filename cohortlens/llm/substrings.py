"""Removal of long repeated word sequences, found by difference-cover anchors.

A window is ``window`` consecutive words of one document. A difference cover D modulo v has, for any two
positions i and j, a shift d < v with (i + d) mod v and (j + d) mod v both in D. So two equal windows share an
equal anchor of ``window - v + 1`` words that starts at a cover position of both documents: hashing anchors at
cover positions alone (5 of 21) misses no repeated window. Anchors that occur twice are then extended: the
windows that hold one are hashed whole, with 95 bits, and counted.

An occurrence is a plain row (hash, check, text key, place, n); one window over (hash, check) counts it, and the
places of repeated ones go back to their text by its key. A hash that a task meets twice is settled there (it
repeats): it takes part once for all others, and the task tells its own places as ranges. So a passage that a third
of all documents hold is one row for each task, not one for each document, and copies of a text share their answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.textops import U64, Words, mix, pieces, split_words, window_hashes, window_starts, word_hashes
from cohortlens.runtime import Scratch, with_fields

#: A perfect difference set modulo 21 (Singer).
COVER, PERIOD = (3, 6, 7, 12, 14), 21
#: A task settles hashes among so many at a time.
SETTLED_TOGETHER = 2_000_000
_OCCURRENCE = "hash long, check int, key long, place long, n int"


def _anchor_mask(words: Words, width: int) -> np.ndarray:
    """True at word positions where an anchor starts."""
    place = np.arange(int(words.first[-1])) - np.repeat(words.first[:-1], words.count)
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    return window_starts(words.first, width) & cover[place % PERIOD]


def _anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all anchors of a batch."""
    at = np.flatnonzero(_anchor_mask(words, width))
    return at, window_hashes(word_hashes(words), width)[at] if len(at) else np.zeros(0, np.uint64)


def _range(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A range of places, both ends included, as one number; empty if high < low."""
    return low << 32 | high


def _occurrences(key: np.ndarray, place: np.ndarray, hash_: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_OCCURRENCE``: each distinct hash once, and ranges of the places whose hashes repeat among these.

    A repeated hash has n = 2 and no place, since the ranges (check -1, n = 2) hold its places.
    """
    order = np.lexsort((check, hash_))
    key, place, hash_, check = key[order], place[order], hash_[order], check[order]
    first = np.ones(len(hash_), dtype=bool)
    first[1:] = (hash_[1:] != hash_[:-1]) | (check[1:] != check[:-1])
    start = np.flatnonzero(first)
    many = np.diff(np.append(start, len(hash_))) > 1
    settled = np.repeat(many, np.diff(np.append(start, len(hash_))))
    k, p = key[settled], place[settled]
    order = np.lexsort((p, k))
    k, p = k[order], p[order]
    cut = np.ones(len(k), dtype=bool)
    cut[1:] = (k[1:] != k[:-1]) | (p[1:] > p[:-1] + 1)
    low = np.flatnonzero(cut)
    known, own = _range(p[low], p[np.append(low[1:], len(p)) - 1]) if len(p) else p, k[low]
    spread = mix(own.view(np.uint64) ^ mix(known.view(np.uint64)))
    columns = (
        np.concatenate((hash_[start], spread)).view(np.int64),
        np.concatenate((check[start], np.full(len(known), -1))).astype(np.int32),
        np.concatenate((key[start], own)),
        np.concatenate((np.where(many, _range(np.int64(1), np.int64(0)), _range(place[start], place[start])), known)),
        np.concatenate((1 + many, np.full(len(known), 2))).astype(np.int32),
    )
    order = np.lexsort((columns[3], columns[2]))  # rows of a text side by side: shuffled blocks compress to little more than the hashes
    return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in columns], names=["hash", "check", "key", "place", "n"])


def repeated_places(rows: DataFrame, found: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> DataFrame:
    """(key, places): for each text key, the ranges of places whose hashes occur at two places or more.

    ``found`` gives keys, places, hashes and check values of a batch; an occurrence is one entry.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in pieces(batch, "text"):
                held.append(found(part))
                if sum(len(x[0]) for x in held) >= SETTLED_TOGETHER:
                    yield _occurrences(*(np.concatenate(x) for x in zip(*held)))
                    held = []
        if held:
            yield _occurrences(*(np.concatenate(x) for x in zip(*held)))

    total = F.sum("n").over(Window.partitionBy("hash", "check"))
    place = F.col("place")
    told = rows.mapInArrow(tell, _OCCURRENCE).withColumn("total", total)
    told = told.where((F.col("total") > 1) & (F.shiftright(place, 32) <= place.bitwiseAND(F.lit(0xFFFFFFFF))))
    return told.groupBy("key").agg(F.collect_set("place").alias("places"))


def _expanded(words: Words, column: pa.Array, first: np.ndarray) -> np.ndarray:
    """True at the places in the ranges of each document; ``first`` has where each document's places begin, and their end."""
    ranges = np.asarray(column.flatten())
    owner = np.repeat(np.arange(len(column)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)))
    edge = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    np.add.at(edge, first[owner] + (ranges >> 32), 1)
    np.add.at(edge, first[owner] + (ranges & 0xFFFFFFFF) + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _counted(which: np.ndarray, n: int) -> np.ndarray:
    """Where the entries of each of n documents begin, and the end; ``which`` has the document of each entry, ascending."""
    return np.searchsorted(which, np.arange(n + 1))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Every document with the words removed that a repeated window covers.

    Returns ``id_col`` and the columns in ``carry``, then ``n_words, n_removed, kept`` (kept words joined by one
    blank; these three replace columns of the same names) for each row of docs. A window
    is repeated if its words also start anywhere else, in the same document or another; windows are judged on
    the input. Null and empty texts have no words and an empty ``kept``. A null id is allowed; rows that repeat
    an id are documents of their own. An empty table gives an empty one. ``window`` must be above 21.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be above {PERIOD}")
    width = window - PERIOD + 1
    scratch = Scratch(docs.sparkSession, "substrings")
    new = ("n_words", "n_removed", "kept")
    names = [c for c in dict.fromkeys([id_col, *carry]) if c not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    text = F.col(text_col)
    rows = docs.select(row.alias("row"), F.xxhash64(text).alias("key"), text.alias("text"))

    def anchors(part: pa.RecordBatch):
        words = split_words(part["text"])
        at, h = _anchors(words, width)
        which = np.searchsorted(words.first, at, side="right") - 1
        place = np.arange(len(at)) - _counted(which, part.num_rows)[which]  # among the document's own anchors
        return np.asarray(part["key"], dtype=np.int64)[which], place, h, np.zeros(len(h), np.int64)

    flagged = scratch.keep(repeated_places(rows.select("key", "text"), anchors), "anchors")

    def windows(part: pa.RecordBatch):
        words = split_words(part["text"])
        at = np.flatnonzero(_anchor_mask(words, width))
        which = np.searchsorted(words.first, at, side="right") - 1
        hit = at[_expanded(words, part["places"], _counted(which, part.num_rows))]
        n = int(words.first[-1])
        near = np.zeros(n + 1, dtype=np.int64)  # windows that hold a hit anchor less than a period after their start
        np.add.at(near, np.maximum(hit - PERIOD + 1, 0), 1)
        np.add.at(near, np.minimum(hit + 1, n), -1)
        starts = np.flatnonzero((np.cumsum(near[:-1]) > 0) & window_starts(words.first, window))
        which = np.searchsorted(words.first, starts, side="right") - 1
        key, none = np.asarray(part["key"], dtype=np.int64)[which], np.zeros(0, np.uint64)
        hashes = word_hashes(words) if len(starts) else none
        h, check = (window_hashes(hashes, window, seed)[starts] if len(starts) else none for seed in (0, 7))
        return key, starts - words.first[which], h, (check >> U64(33)).astype(np.int64)

    candidates = rows.select("key", "text").join(flagged, "key")
    matched = scratch.keep(repeated_places(candidates, windows), "windows")
    schema = with_fields(rows.select("row").schema, "n_words long, n_removed long, kept string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = split_words(part["text"])
                n = int(words.first[-1])
                cover = np.zeros(n + 1, dtype=np.int64)
                hit = np.flatnonzero(_expanded(words, part["places"], words.first))
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(gone)))
                removed = total[words.first[1:]] - total[words.first[:-1]]
                kept = []
                for k in range(part.num_rows):
                    a, b = words.first[k], words.first[k + 1]
                    left = words.text(k) if removed[k] < b - a else []
                    kept.append(b" ".join(left if not removed[k] else [w for w, x in zip(left, gone[a:b]) if not x]))
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", *new])

    judged = rows.join(matched, "key", "left").select("row", "text", "places")
    return judged.mapInArrow(cut, schema).select("row.*", *new)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of what is left of every document; windows of 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
