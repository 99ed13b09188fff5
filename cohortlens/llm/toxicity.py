"""Toxic spans by a linear-chain conditional random field.

Chains are sentences, cut after ``LONGEST`` tokens. A token has hashed features (its letters, prefixes, a suffix, its
shape) and those of its neighbours in the chain; the chain has two labels. Token labels come from document labels:
within toxic documents those tokens are toxic whose word or prefix
occurs far more often in toxic documents than in others. The field learns on a bounded sample of the labelled rows
(whose ids alone are broadcast), from all their sentences, in shards whose weights are averaged, by gradient ascent
with forward-backward expectations. On all documents, forward-backward marginals give toxic spans; their largest
value and their sum give the document score, calibrated by logistic regression on sampled documents that the field
has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.textops import Words, pieces, split_words
from cohortlens.runtime import with_fields

#: Labelled rows that are learnt from, at most about: toxic ones, others. Shards learn side by side.
TOXIC_ROWS, OTHER_ROWS, SHARDS = 4_000, 8_000, 4
BITS = 18
#: Tokens of a chain, at most.
LONGEST = 256
#: Features of a token itself, and those that it lends to each neighbour.
OWN, LENT = 7, 2
_CACHE = 400_000


_MASK = 2**BITS - 1
_DIGIT = re.compile(rb"[0-9]")
#: Start values that tell the kinds of features apart.
_WORD, _P3, _P4, _P5, _P6, _END, _SHAPE, _AFTER, _AFTER4, _BEFORE, _BEFORE4 = (crc32(x) for x in (b"w", b"3", b"4", b"5", b"6", b"s", b"h", b"<", b"<4", b">", b">4"))


def features(word: bytes) -> tuple[int, ...]:
    """Slots of a token's own features, of those it lends to the token after it, and to the one before it."""
    text = word.decode("utf-8", "replace")
    core = text.strip(".,;:!?\"'()[]*|&%$#").lower()
    b = core.encode()
    shape = text[:1].isupper() | 2 * text[1:].isupper() | 4 * (_DIGIT.search(word) is not None) | 8 * (core != text.lower())
    p4 = b[:4]
    slots = crc32(b, _WORD), crc32(b[:3], _P3), crc32(p4, _P4), crc32(b[:5], _P5), crc32(b[:6], _P6), crc32(b[-3:], _END), _SHAPE + shape, crc32(b, _AFTER), crc32(p4, _AFTER4), crc32(b, _BEFORE), crc32(p4, _BEFORE4)
    return tuple([x & _MASK for x in slots])


def stems(word: bytes) -> set[str]:
    """What the token labels are decided by: the word and its prefixes of four to six letters."""
    core = word.decode("utf-8", "replace").strip(".,;:!?\"'()[]*|&%$#").lower()
    return {f"w{core}", *(core[:k] for k in (4, 5, 6) if len(core) >= k)} if len(core) > 2 else set()


def _chains(words: Words) -> np.ndarray:
    """Where chains begin among the words of a batch, and the end."""
    n = len(words.start)
    if not n:
        return np.zeros(1, np.int64)
    stop = np.isin(words.buf[words.end - 1], np.frombuffer(b".!?", np.uint8))
    begin = np.zeros(n + 1, dtype=bool)
    begin[1:] = stop
    begin[words.first[words.first < n]] = True
    begin[n] = True
    sentences = np.flatnonzero(begin)
    place = np.arange(n) - np.repeat(sentences[:-1], np.diff(sentences))
    begin[:n] |= place % LONGEST == 0
    return np.flatnonzero(begin)


def marginals(emission: np.ndarray, chains: np.ndarray, weights: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each token and the expected transitions (2 x 2; zeros if not wanted), by forward-backward over all chains at once.

    ``weights`` are the scores start (2), transitions (2 x 2, row: label before) and end (2). Tokens are laid out by
    step, longest chains first, so that step t is one slice; messages are scaled to sum to one.
    """
    size = np.diff(chains)
    order = np.argsort(-size, kind="stable")
    start, size = chains[:-1][order], size[order]
    n, longest = len(emission), int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    off = np.concatenate(([0], np.cumsum(live)))
    step_of = np.repeat(np.arange(longest), live)
    at = start[np.arange(n) - off[step_of]] + step_of
    (s0, s1), (t00, t01, t10, t11), (e0, e1) = np.exp(weights[:2]), np.exp(weights[2:6]), np.exp(weights[6:8])
    local = np.exp(np.clip(emission[at], -30, 30))
    ahead, back = np.empty(n), np.empty(n)  # the scaled messages of label 1; label 0 has the rest
    for t in range(longest):
        a, b = off[t], off[t + 1]
        if t:
            one = ahead[off[t - 1] : off[t - 1] + b - a]
            zero = 1 - one
            m0, m1 = zero * t00 + one * t10, (zero * t01 + one * t11) * local[a:b]
        else:
            m0, m1 = s0, s1 * local[a:b]
        ahead[a:b] = m1 / (m0 + m1)
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        a, b = off[t], off[t + 1]
        last = live[t + 1] if t + 1 < longest else 0
        back[a + last : b] = e1 / (e0 + e1)
        if last:
            one = back[b : b + last]
            c0, c1 = 1 - one, one * local[b : b + last]
            m0, m1 = t00 * c0 + t01 * c1, t10 * c0 + t11 * c1
            back[a : a + last] = m1 / (m0 + m1)
            if moves:
                f1 = ahead[a : a + last]
                f0 = 1 - f1
                total = f0 * m0 + f1 * m1
                pairs += [[(f0 * t00 * c0 / total).sum(), (f0 * t01 * c1 / total).sum()], [(f1 * t10 * c0 / total).sum(), (f1 * t11 * c1 / total).sum()]]
    p = np.empty(n)
    hit = ahead * back
    p[at] = hit / np.maximum(hit + (1 - ahead) * (1 - back), 1e-300)
    return p, pairs


def _emissions(own: np.ndarray, after: np.ndarray, before: np.ndarray, chains: np.ndarray) -> np.ndarray:
    """Scores of label 1: each token's own, what the token before it lends, and the token after it; inside chains."""
    out = own.copy()
    if len(own) > 1:
        inner = np.ones(len(own) - 1, dtype=bool)
        inner[chains[1:-1] - 1] = False
        out[1:] += np.where(inner, after[:-1], 0)
        out[:-1] += np.where(inner, before[1:], 0)
    return out


def _learn(lexicon: frozenset, epochs: int = 25, rate: float = 0.5):
    """Weights of one shard, from all sentences of its documents."""

    def run(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        slots, bad = [], []
        ids, labels, sizes = [], [], []
        for batch in table.select(["text", "toxic"]).combine_chunks().to_batches():
            for part in pieces(batch, "text"):
                words = split_words(part["text"])
                raw = words.buf.tobytes()
                found = np.empty(len(words.start), dtype=np.int64)
                for k, (i, j) in enumerate(zip(words.start.tolist(), words.end.tolist())):
                    word = raw[i:j]
                    at = known.get(word)
                    if at is None:
                        at = known[word] = len(slots)
                        slots.append(features(word))
                        bad.append(not lexicon.isdisjoint(stems(word)))
                    found[k] = at
                ids.append(found)
                labels.append(np.repeat(np.asarray(part["toxic"]).astype(bool), words.count) & np.array(bad, dtype=bool)[found])
                sizes.append(np.diff(_chains(words)))
        weights, tail = np.zeros(2**BITS), np.zeros(8)
        if sum(map(len, sizes)):
            x, y = np.concatenate(ids), np.concatenate(labels).astype(np.float64)
            chains = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            first, last = chains[:-1], chains[1:] - 1
            inner = np.ones(len(y), dtype=bool)
            inner[last] = False
            inner = np.flatnonzero(inner)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
            used, slot = np.unique(np.array(slots), return_inverse=True)
            slot = slot.reshape(len(slots), -1)
            parts = slot[:, :OWN], slot[:, OWN : OWN + LENT], slot[:, OWN + LENT :]
            w, g2, t2 = np.zeros(len(used)), np.full(len(used), 1e-3), np.full(8, 1e-3)
            total = lambda index, error: np.bincount(x[index], weights=error, minlength=len(slots))
            for _ in range(epochs):
                own, after, before = (w[p].sum(axis=1)[x] for p in parts)
                p, pairs = marginals(_emissions(own, after, before, chains), chains, tail)
                error = y - p
                by_word = (np.bincount(x, weights=error, minlength=len(slots)), total(inner, error[inner + 1]), total(inner + 1, error[inner]))
                grad = -1e-2 * w
                for index, e in zip(parts, by_word):
                    grad += np.bincount(index.ravel(), weights=np.repeat(e, index.shape[1]), minlength=len(used))
                ends = np.array([(p[first] - y[first]).sum(), (y[first] - p[first]).sum(), *(seen - pairs).ravel(), (p[last] - y[last]).sum(), (y[last] - p[last]).sum()]) - 1e-2 * tail
                g2, t2 = g2 + grad**2, t2 + ends**2
                w, tail = w + rate * grad / np.sqrt(g2), tail + rate * ends / np.sqrt(t2)
            weights[used] = w
        return pa.table({"weights": pa.array([np.concatenate((weights, tail)).astype("<f8").tobytes()], pa.binary())})

    return run


class Tagger(dict):
    """Number of each word met, by its bytes; ``scores`` has its own score and what it lends to the words after and before."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.tail = weights[: 2**BITS], weights[2**BITS :]
        self.scores = np.zeros((3, 1024))
        self.fresh: list[tuple[int, ...]] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(features(word))
        self[word] = at = len(self)
        return at

    def _score_fresh(self) -> None:
        """Scores of the words that have come since the last call."""
        n = len(self)
        if n > self.scores.shape[1]:
            self.scores = np.concatenate((self.scores, np.zeros((3, 2 * n - self.scores.shape[1]))), axis=1)
        w = self.weights[np.array(self.fresh, dtype=np.int64).reshape(len(self.fresh), OWN + 2 * LENT)]
        self.scores[:, n - len(self.fresh) : n] = w[:, :OWN].sum(axis=1), w[:, OWN : OWN + LENT].sum(axis=1), w[:, OWN + LENT :].sum(axis=1)
        self.fresh.clear()

    def tag(self, words: Words) -> np.ndarray:
        """P(toxic) of each word."""
        if not len(words.start):
            return np.zeros(0)
        if len(self) > _CACHE:
            self.clear()
        raw = words.buf.tobytes()
        at = np.fromiter((self[raw[i:j]] for i, j in zip(words.start.tolist(), words.end.tolist())), np.int64, len(words.start))
        self._score_fresh()
        chains = _chains(words)
        return marginals(_emissions(*self.scores[:, at], chains), chains, self.tail, moves=False)[0]


_TAGGERS: dict[int, Tagger] = {}


def _tagger(weights: np.ndarray) -> Tagger:
    """The tagger of these weights; tasks that a worker runs one after another share its words."""
    key = crc32(weights.tobytes())
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(weights)
    return _TAGGERS[key]


def _evidence(words: Words, p: np.ndarray) -> np.ndarray:
    """Per document: largest marginal, and log of one plus the sum of the marginals above 0.2."""
    n_docs = len(words.first) - 1
    top, doc = np.zeros(n_docs), np.repeat(np.arange(n_docs), words.count)
    np.maximum.at(top, doc, p)
    return np.stack([top, np.log1p(np.bincount(doc, weights=np.where(p > 0.2, p, 0), minlength=n_docs))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; intercept last."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``spans`` (array of start, end in characters, and the span's largest marginal).

    Learns from labelled rows where ``train`` (over the id) holds; a null label is ignored, and of labels that
    repeat an id the largest counts. Text alone decides a score: rows with equal texts get equal scores. A null or
    empty text has no spans and the score of a text without any evidence. Columns of those two names are replaced;
    all others are kept. Without labels of both kinds, or texts that have them, every score is 0. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    new = ["score", "spans"]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    schema = with_fields(docs.schema, "score double, spans array<struct<start: int, end: int, peak: double>>")
    usable = labels.where(train & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    total = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    unscored = docs.select("*", F.lit(0.0).alias("score"), F.array().cast(schema["spans"].dataType).alias("spans"))
    if len(total) < 2:
        return unscored
    draw = F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, F.lit(int(1e6 * min(1, TOXIC_ROWS / total.get(1, 1))))).otherwise(F.lit(int(1e6 * min(1, OTHER_ROWS / total.get(0, 1)))))
    chosen = usable.where(draw < share).limit(2 * (TOXIC_ROWS + OTHER_ROWS))  # the draw keeps it far below
    role = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(10))
    sample = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    sample = sample.select("text", F.col("toxic").cast("int").alias("toxic"), role.alias("role"), F.pmod(F.xxhash64(id_col), F.lit(SHARDS)).alias("shard")).where("text is not null")
    sample = sample.dropDuplicates(["text", "toxic"])  # else the rare words of a copied text pass for common ones

    def count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                for stem in set().union(*(stems(w) for w in set(text.encode().split()))) if text.strip() else ():
                    found.setdefault(stem, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], names=["stem", "n0", "n1"])

    counted = sample.where("role < 7").select("text", "toxic").mapInArrow(count_stems, "stem string, n0 long, n1 long").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = (F.col("n1") + 0.1) / min(total[1], TOXIC_ROWS) / ((F.col("n0") + 0.1) / min(total[0], OTHER_ROWS))
    least = max(4, 0.01 * min(total[1], TOXIC_ROWS))
    lexicon = frozenset(r["stem"] for r in counted.where((F.col("n1") >= least) & (ratio >= 20)).select("stem").collect())
    learnt = sample.where("role < 7").groupBy("shard").applyInArrow(_learn(lexicon), "weights binary").collect()
    if not learnt:
        return unscored
    weights = np.mean([np.frombuffer(r["weights"], "<f8") for r in learnt], axis=0)
    shared = spark.sparkContext.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                words = split_words(part["text"])
                x = _evidence(words, tagger.tag(words))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), part["toxic"]], names=["top", "total", "toxic"])

    unseen = sample.where("role >= 7").select("text", "toxic").mapInArrow(measure, "top double, total double, toxic int").toArrow()
    x, y = np.stack([np.asarray(unseen["top"]), np.asarray(unseen["total"])], axis=1).astype(np.float64), np.asarray(unseen["toxic"]).astype(np.float64)
    link = fit_logistic(x, y) if 0 < y.sum() < len(y) else np.array([4.0, 4.0, -4.0])  # too few to calibrate on

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared.value)
        for batch in batches:
            for part in pieces(batch, text_col):
                words = split_words(part[text_col])
                p = tagger.tag(words)
                score = 1 / (1 + np.exp(-np.clip(_evidence(words, p) @ link[:2] + link[2], -30, 30)))
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    letters = np.concatenate(([0], np.cumsum((words.buf & 0xC0) != 0x80)))  # code points before each byte
                    begin = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(part[text_col]), 0), dtype=np.int64))))
                    doc = np.searchsorted(words.first, hit, side="right") - 1
                    for run in np.split(hit, np.flatnonzero((np.diff(hit) > 1) | (np.diff(doc) > 0)) + 1):
                        d = int(np.searchsorted(words.first, run[0], side="right")) - 1
                        base = letters[begin[d]]
                        spans[d].append({"start": int(letters[words.start[run[0]]] - base), "end": int(letters[words.end[run[-1]]] - base), "peak": float(p[run].max())})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "peak": pa.float64()})))], names=[*part.schema.names, *new])

    return docs.mapInArrow(judge, schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels with remainder 1 of 3 are held out, a score from 0.7 on is predicted 1."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    done = score_toxicity(docs, labels, ~held_out)
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
