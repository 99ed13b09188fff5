"""Document quality by weak supervision.

Nine overlapping heuristics vote good, bad or abstain on each text. Spark counts how often each pattern of votes
occurs over all documents (at most 3**9 patterns, so the histogram is small whatever the corpus); expectation-
maximisation on it estimates each heuristic's rates given the hidden class, and with them the posterior of each
pattern. Those posteriors are the labels from which a linear scorer over hashed words and text statistics learns,
on a bounded sample: shards train side by side and their weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.textops import U64, Words, pieces, split_words, word_hashes
from cohortlens.runtime import with_fields

#: Texts that the scorer learns from, about, and shards that learn side by side.
TRAIN_TEXTS, SHARDS = 20_000, 4
BITS = 14
HEURISTICS = ("capitals", "symbols", "variety", "word length", "marks per word", "lines", "sentences", "shouting", "digits")
_PATTERNS = 3 ** len(HEURISTICS)


def _byte_classes() -> np.ndarray:
    """0 other, 1 upper, 2 lower, 3 digit, 4 mark, 5 full stop, 6 exclamation mark, 7 bar, 8 line end, 9 blank."""
    out = np.zeros(256, dtype=np.int8)
    for c in range(128):
        ch = chr(c)
        out[c] = 1 if ch.isupper() else 2 if ch.islower() else 3 if ch.isdigit() else {".": 5, "!": 6, "|": 7, "\n": 8}.get(ch, 9 if ch.isspace() else 4)
    return out


_CLASS = _byte_classes()
N_STATS = 12


def statistics(texts: pa.Array, words: Words, hashes: np.ndarray) -> np.ndarray:
    """Per text: words, then shares of capitals, marks, distinct words, marks per word, repeated lines, stops, exclamations, digits, mean word length, lines per word, log length."""
    n_docs, n = len(texts), np.maximum(words.count, 1)
    kind = _CLASS[words.buf]
    high = np.flatnonzero(words.buf[:-1] == 0xC3) + 1 if len(words.buf) else np.zeros(0, np.int64)
    kind[high] = np.where(words.buf[high] < 0x9F, 1, 2)  # Latin-1 letters in UTF-8
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    doc_of_byte = np.repeat(np.arange(n_docs), size)
    count = np.bincount(doc_of_byte * 10 + kind, minlength=10 * n_docs).reshape(n_docs, 10).astype(np.float64)
    doc = np.repeat(np.arange(n_docs), words.count)
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))[: len(d)]
    distinct = np.bincount(d[fresh], minlength=n_docs) / n
    repeated = np.zeros(n_docs)
    for k, text in enumerate(texts.to_pylist()):
        if text and len(lines := [x for x in text.split("\n") if x]) > 2:
            repeated[k] = 1 - len(set(lines)) / len(lines)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    solid = np.maximum(count[:, :8].sum(axis=1), 1)
    marks = count[:, 4] + count[:, 6] + count[:, 7]
    return np.stack([words.count, count[:, 1] / letters, marks / solid, distinct, marks / n, repeated, count[:, 5] / n, count[:, 6] / n, count[:, 3] / solid, letters / n, count[:, 8] / n, np.log1p(words.count)], axis=1)


def votes(s: np.ndarray) -> np.ndarray:
    """Votes (1 good, 0 bad, 2 abstain) of each heuristic on each text; an empty text gets bad votes only."""
    n = s[:, 0]
    pick = lambda bad, good: np.where(bad, 0, np.where(good, 1, 2))
    by = [
        pick(s[:, 1] > 0.5, False),
        pick(s[:, 2] > 0.07, (n >= 20) & (s[:, 2] < 0.03)),
        pick((n >= 50) & (s[:, 3] < 0.3), (n >= 20) & (s[:, 3] > 0.4)),
        pick((s[:, 9] < 2) | (s[:, 9] > 14), (s[:, 9] > 3) & (s[:, 9] < 10)),
        pick((n >= 5) & (s[:, 4] > 0.35), False),
        pick(s[:, 5] > 0.3, False),
        pick((n >= 40) & ((s[:, 6] < 0.01) | (s[:, 6] > 0.6)), (n >= 20) & (s[:, 6] > 0.02) & (s[:, 6] < 0.4)),
        pick((n >= 5) & (s[:, 7] > 0.1), False),
        pick((n >= 5) & (s[:, 8] > 0.3), False),
    ]
    out = np.stack(by, axis=1)
    out[n == 0] = 0
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(HEURISTICS)))


def fit_labellers(count: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of good for each vote pattern, by expectation-maximisation.

    It starts from "bad if any heuristic says bad". ``count[p]`` is the number of texts with pattern p. Votes are
    independent given the class, abstaining says nothing, and rates have one pseudo-count. Patterns that do not
    occur get a posterior as well.
    """
    v = np.arange(_PATTERNS)[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3
    post = np.where((v == 0).any(axis=1), 0.1, 0.99)
    for _ in range(rounds):
        weight = np.stack([count * (1 - post), count * post], axis=1)
        prior = (weight.sum(axis=0) + 1) / (weight.sum() + 2)
        like = np.log(prior)[None].repeat(_PATTERNS, axis=0)
        for j in range(len(HEURISTICS)):
            seen = np.stack([weight[v[:, j] == k].sum(axis=0) for k in range(2)]) + 1
            like += np.vstack([np.log(seen / (weight.sum(axis=0) + 2)), np.zeros((1, 2))])[v[:, j]]
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -60, 60)))
        if np.abs(new - post)[count > 0].max(initial=0) < 1e-9:
            break
        post = new
    return post


def _dense(s: np.ndarray) -> np.ndarray:
    scale = np.array([0, 2, 8, 2, 1, 2, 4, 6, 3, 0.1, 2, 0.2])
    return np.clip(s * scale, 0, 3)


def _prepared(part: pa.RecordBatch, text_col: str) -> tuple[Words, np.ndarray, np.ndarray]:
    words = split_words(part[text_col])
    hashes = word_hashes(words)
    return words, (hashes >> U64(64 - BITS)).astype(np.int64), statistics(part[text_col], words, hashes)


def _margin(weights: np.ndarray, words: Words, slot: np.ndarray, s: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(s)), words.count)
    hashed = np.bincount(doc, weights=weights[slot], minlength=len(s)) / np.maximum(words.count, 1)
    return weights[-1] + hashed + _dense(s) @ weights[2**BITS : 2**BITS + N_STATS]


def _learn(posterior: np.ndarray, text_col: str, epochs: int = 12, rate: float = 0.3):
    """Weights of one shard: logistic regression on posteriors, AdaGrad over texts in the order of their draw."""

    def run(table: pa.Table) -> pa.Table:
        weights, squares = np.zeros(2**BITS + N_STATS + 1), np.full(2**BITS + N_STATS + 1, 1e-2)
        rows = []
        for batch in table.sort_by("draw").select([text_col]).combine_chunks().to_batches():
            for part in pieces(batch, text_col):
                words, slot, s = _prepared(part, text_col)
                target, dense = posterior[patterns(votes(s))], _dense(s)
                for k in range(len(s)):
                    at, c = np.unique(slot[words.first[k] : words.first[k + 1]], return_counts=True)
                    index = np.concatenate((at, np.arange(2**BITS, 2**BITS + N_STATS + 1)))
                    rows.append((index, np.concatenate((c / max(words.count[k], 1), dense[k], [1.0])), target[k]))
        for _ in range(epochs):
            for index, value, target in rows:
                p = 1 / (1 + np.exp(-np.clip(weights[index] @ value, -30, 30)))
                g = (p - target) * value
                squares[index] += g * g
                weights[index] -= rate * g / np.sqrt(squares[index])
        return pa.table({"weights": pa.array([weights.astype("<f8").tobytes()], pa.binary())})

    return run


def score_quality(docs: DataFrame, keep_from: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``quality_score`` (0 to 1, higher is better), ``weak_label`` (the posterior of the votes) and ``kept``.

    Columns of those names are replaced. A null or empty text has only bad votes, score 0, and is not kept. Rows
    are judged one by one, and ids are not used, so null and repeated ids change nothing; repeated rows count once each
    in the histogram and once in all for the scorer. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    new = ["quality_score", "weak_label", "kept"]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    schema = with_fields(docs.schema, "quality_score double, weak_label double, kept boolean")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PATTERNS, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, text_col):
                total += np.bincount(patterns(votes(_prepared(part, text_col)[2])), minlength=_PATTERNS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])

    counted = docs.select(text_col).mapInArrow(tally, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(_PATTERNS)
    count[np.asarray(counted["pattern"])] = np.asarray(counted["n"])
    posterior = fit_labellers(count)
    every = max(1, int(count.sum()) // TRAIN_TEXTS)
    draw = F.xxhash64(F.col(text_col), F.lit(11))  # by the text: copies are drawn together, and learnt from once
    sample = docs.where((F.pmod(draw, F.lit(every)) == 0) & F.col(text_col).isNotNull()).select(draw.alias("draw"), text_col).dropDuplicates(["draw"])
    sample = sample.withColumn("shard", F.pmod(F.shiftright("draw", 32), F.lit(SHARDS)))
    learnt = sample.groupBy("shard").applyInArrow(_learn(posterior, text_col), "weights binary").collect()
    weights = np.mean([np.frombuffer(r["weights"], "<f8") for r in learnt], axis=0) if learnt else np.zeros(2**BITS + N_STATS + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                words, slot, s = _prepared(part, text_col)
                score = 1 / (1 + np.exp(-np.clip(_margin(weights, words, slot, s), -30, 30)))
                score[words.count == 0] = 0
                weak = posterior[patterns(votes(s))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(weak), pa.array((score >= keep_from) & (words.count > 0))], names=[*part.schema.names, *new])

    return docs.mapInArrow(judge, schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs).select("doc_id", "quality_score", "weak_label", "kept")
