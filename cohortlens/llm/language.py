"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 for each language, over lower-case letters, with runs of anything else as one separator.
Counts are summed by Spark over all training texts. All languages share one sorted array of 64-bit gram keys per
order (four 16-bit characters), beside which stand the log probabilities of each language; a lookup is a binary
search. A model of more than ``BROADCAST_GRAMS`` rows is not broadcast: its counts stay on Spark, and each block of
documents joins those of its own grams; the probabilities are the same.

The predicted language has the lowest cross-entropy per character. For rejection, a text is cut into blocks of 64
characters, each taken in the language that explains it best, so that passages in a second known language count as
explained. A text is rejected if its mean over blocks is more than ``z`` standard deviations above what the texts
of its predicted language have. That deviation has a part between documents and a part that falls with the length,
both measured on all training texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortlens.llm.textops import U64, pieces
from cohortlens.runtime import Scratch, with_fields

ORDER = 4
#: Rows (language, gram) of a model that is broadcast, at most; a larger one is joined. Results do not depend on it.
BROADCAST_GRAMS = 2_000_000
#: A block of documents that joins its grams has 2**BLOCK_BITS rows at most.
BLOCK_BITS = 10
#: Characters of a block that is taken in its best language; texts from LONG on show the spread between documents.
BLOCK_CHARS, LONG = 64, 200
#: The least standard deviation between documents, in nats per character.
LEAST_SPREAD = 0.02
_SEPARATOR = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram keys of a batch of texts, the text of each, and the number of letters in each text."""
    padded = [" " * (ORDER - 1) + (t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    text = np.repeat(np.arange(len(texts)), sizes)
    n_letters = np.bincount(text, weights=letter, minlength=len(texts)).astype(np.int64)
    head = np.zeros(len(code), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for k in range(ORDER - 1):
        head[starts + k] = True
    keep = letter | head
    keep[1:] |= letter[:-1]
    code, letter, text, head = code[keep], letter[keep], text[keep], head[keep]
    c = np.where(letter, np.minimum(code, 0xFFFF), _SEPARATOR).astype(np.uint64)
    key = c.copy()
    for back in range(1, ORDER):
        key[back:] |= c[:-back] << U64(16 * back)
    return key[~head], text[~head], n_letters


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): counts of grams per language over all texts; each task sends a gram of a language once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for part in pieces(batch, text_col):
                key, text, _ = grams(part[text_col].to_pylist())
                langs = np.asarray(part[lang_col].to_pylist(), dtype=object)
                for lang in set(langs):
                    found = np.unique(key[(langs == lang)[text]], return_counts=True)
                    old = held.setdefault(lang, [])
                    old.append(found)
                    if len(old) > 8:
                        held[lang] = [_merged(old)]
        for lang, parts in held.items():
            keys, n = _merged(parts)
            for a in range(0, len(keys), 1 << 16):
                k = keys[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n[a : a + len(k)])], names=["lang", "gram", "n"])

    counted = docs.select(text_col, lang_col).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted keys of each order with log probabilities (grams x languages), and log backoff weights of contexts."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray

    def score(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability in each language of the last character of each gram, given those before it."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(key), len(self.langs)))
        own = key & U64(2 ** (16 * order) - 1)
        at = np.minimum(np.searchsorted(self.keys[order], own), len(self.keys[order]) - 1)
        out = self.logp[order][at]
        missed = np.flatnonzero(self.keys[order][at] != own)
        if len(missed):
            out[missed] = self.score(own[missed], order - 1) + self.weight(own[missed] >> U64(16), order)
        return out

    def weight(self, context: np.ndarray, order: int) -> np.ndarray:
        """Log backoff weight of contexts; 0 where a language has not seen the context."""
        known = self.contexts[order]
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        return np.where((known[at] == context)[:, None], self.backoff[order][at], 0)


def fit_model(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney: raw counts at the highest order, numbers of distinct left neighbours below it."""
    width = len(langs)
    alphabet = 1 + len(np.unique(np.concatenate([k & U64(0xFFFF) for k, _ in counts.values()])))
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for lang in langs:
        keys, n = counts[lang]
        for order in range(ORDER, 0, -1):
            by_order[order].append((keys, n))
            keys, n = np.unique(keys & U64(2 ** (16 * (order - 1)) - 1), return_counts=True)
    discount = np.array([[_discount((n == 1).sum(), (n == 2).sum()) for _, n in by_order[order]] for order in range(1, ORDER + 1)])
    tables = []
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k for k, _ in by_order[order]]))
        context = np.unique(union >> U64(16))
        of = np.searchsorted(context, union >> U64(16))
        seen, total, kinds = np.zeros((len(union), width)), np.zeros((len(context), width)), np.zeros((len(context), width))
        for j, (keys, n) in enumerate(by_order[order]):
            at = np.searchsorted(union, keys)
            seen[at, j] = n
            total[:, j] = np.bincount(of[at], weights=n, minlength=len(context))
            kinds[:, j] = np.bincount(of[at], minlength=len(context))
        tables.append((union, context, seen, total, kinds))
    return _interpolated(langs, alphabet, discount, tables)


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once else 0.5


def _interpolated(langs: list[str], alphabet: int, discount: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> Model:
    """Model of the grams and contexts in tables: per order, keys, contexts, counts, and totals and kinds of contexts."""
    width = len(langs)
    none = np.zeros(0, np.uint64)
    model = Model(langs, [none], [np.zeros((0, width), np.float32)], [none], [np.zeros((0, width))], np.full(width, -np.log(alphabet), np.float32))
    for order, (union, context, seen, total, kinds) in enumerate(tables, 1):
        of = np.searchsorted(context, union >> U64(16))
        less = discount[order - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(total > 0, less * kinds / total, 1.0)
            direct = np.where(total[of] > 0, np.maximum(seen - less, 0) / total[of], 0.0)
        lower = np.exp(model.score(union, order - 1).astype(np.float64))
        model.keys.append(union)
        model.logp.append(np.log(direct + rest[of] * lower).astype(np.float32))
        model.contexts.append(context)
        model.backoff.append(np.log(rest).astype(np.float32))
    return model


def _asked(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order, the distinct grams of texts and their contexts."""
    key = np.unique(grams(texts)[0])
    keys = [np.unique(key & U64(2 ** (16 * order) - 1)) for order in range(1, ORDER + 1)]
    return [(k, np.unique(k >> U64(16))) for k in keys]


def _joined_stats(scratch: Scratch, counts: DataFrame, langs: list[str]) -> tuple[int, np.ndarray, DataFrame]:
    """What ``fit_model`` counts, for a model too large for the driver: alphabet, discounts, and rows (part, key, j, n, kinds).

    Part is the order of a gram, or ORDER + order for a context of grams of that order; j is the place of the language.
    """
    place = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("j")
    alphabet = 1 + counts.select(F.col("gram").bitwiseAND(F.lit(0xFFFF))).distinct().count()
    discount, stats = np.zeros((ORDER, len(langs))), None
    for order in range(ORDER, 0, -1):
        for r in counts.groupBy(place).agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
            discount[order - 1, r["j"]] = _discount(r["once"], r["twice"])
        own = counts.select(F.lit(order).alias("part"), F.col("gram").alias("key"), place, "n", F.lit(0).cast("long").alias("kinds"))
        context = counts.groupBy(F.shiftrightunsigned("gram", 16).alias("key"), place).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        own = own.unionAll(context.select(F.lit(ORDER + order).alias("part"), "key", "j", "n", "kinds"))
        stats = own if stats is None else stats.unionAll(own)
        if order > 1:
            lower = F.col("gram").bitwiseAND(F.lit(2 ** (16 * (order - 1)) - 1)).alias("gram")
            counts = scratch.keep(counts.groupBy("lang", lower).agg(F.count("*").alias("n")), f"counts{order - 1}")
    return alphabet, discount, stats


def _look_up(docs: DataFrame, stats: DataFrame, text_col: str) -> DataFrame:
    """The rows of stats that the texts of each ``__block`` of docs need."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.asarray(batch["__block"])
            for b in np.unique(block):
                for part in pieces(batch.filter(pa.array(block == b)), text_col):
                    for order, pair in enumerate(_asked(part[text_col].to_pylist()), 1):
                        for which, key in zip((order, ORDER + order), pair):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b)), pa.array(np.full(len(key), which, np.int32)), pa.array(key.view(np.int64))], names=["__block", "part", "key"])

    asked = docs.select("__block", text_col).mapInArrow(ask, "__block long, part int, key long").distinct()
    return asked.join(stats, ["part", "key"])


def _block_model(langs: list[str], alphabet: int, discount: np.ndarray, found: pa.Table, texts: list[str | None]) -> Model:
    """The model for the grams of texts, from what was looked up for their block."""
    part, key, j, n, kinds = (np.asarray(found[c].combine_chunks()) for c in ("part", "key", "j", "n", "kinds"))
    key = key.view(np.uint64)

    def fill(which: int, keys: np.ndarray) -> list[np.ndarray]:
        own = np.flatnonzero((part == which) & np.isin(key, keys))
        at, out = np.searchsorted(keys, key[own]), []
        for values in (n, kinds):
            out.append(np.zeros((len(keys), len(langs))))
            out[-1][at, j[own]] = values[own]
        return out

    return _interpolated(langs, alphabet, discount, [(keys, context, fill(order, keys)[0], *fill(ORDER + order, context)) for order, (keys, context) in enumerate(_asked(texts), 1)])


def _cross_entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text and language nats per character, and per text the same with each block in its best language; grams and letters of each text."""
    key, text, letters = grams(texts)
    logp = model.score(key)
    n = np.bincount(text, minlength=len(texts))
    blocks = -(-n // BLOCK_CHARS)
    block = (np.arange(len(text)) - (np.cumsum(n) - n)[text]) // BLOCK_CHARS + (np.cumsum(blocks) - blocks)[text]
    by_block = np.stack([np.bincount(block, weights=logp[:, j], minlength=int(blocks.sum())) for j in range(len(model.langs))], axis=1)
    owner = np.repeat(np.arange(len(texts)), blocks)
    total = np.stack([np.bincount(owner, weights=x, minlength=len(texts)) for x in by_block.T], axis=1)
    best = np.bincount(owner, weights=by_block.max(axis=1), minlength=len(texts))
    size = np.maximum(n, 1)
    return -total / size[:, None], -best / size, n, letters


def _limits(langs: list[str], measured: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per language the mean of ``explained``, its variance between documents, and the variance of one character.

    A language without long texts (or without texts) has the mean of the others' variances (or means).
    """
    long_ones = F.when(F.col("size") >= LONG, F.col("explained"))
    w = F.when(F.col("size") < LONG, F.col("size").cast("double"))
    e = F.col("explained")
    rows = measured.groupBy("lang").agg(
        F.avg(e).alias("all"), F.avg(long_ones).alias("mean"), F.var_samp(long_ones).alias("between"),
        F.count(w).alias("short"), F.sum(w).alias("w0"), F.sum(w * e).alias("w1"), F.sum(w * e * e).alias("w2"))
    mean, between, single = (np.full(len(langs), np.nan) for _ in range(3))
    for r in rows.collect():  # one row a language
        j = langs.index(r["lang"])
        mean[j] = r["all"] if r["mean"] is None else r["mean"]
        between[j] = np.nan if r["between"] is None else r["between"]
        if r["short"] >= 10:
            single[j] = max(0.0, (r["w2"] - 2 * mean[j] * r["w1"] + mean[j] ** 2 * r["w0"]) / r["short"])
    known = lambda x, other: np.where(np.isnan(x), np.nanmean(x) if (~np.isnan(x)).any() else other, x)
    return known(mean, 0.0), np.maximum(known(between, 0.01), LEAST_SPREAD**2), np.maximum(known(single, 2.0), 1.0)


def identify(docs: DataFrame, train: Column, z: float = 8.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds ``lang_pred, score, cross_entropy, rejected`` to every row; columns of those names are replaced.

    Learns from the text and non-null language of the rows where ``train`` holds, and predicts from text alone.
    ``score`` is the softmax over languages of minus the cross-entropy times the number of characters (40 at
    most). A text that is null, empty or has no letter is ``und`` with score 0, cross-entropy null, and rejected.
    Ties go to the first language in alphabetical order. Without any training row all texts are ``und``.
    """
    spark = docs.sparkSession
    new = ["lang_pred", "score", "cross_entropy", "rejected"]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    schema = with_fields(docs.schema, "lang_pred string, score double, cross_entropy double, rejected boolean")
    of_use = train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    learn = docs.where(of_use)
    scratch = Scratch(spark, "language")
    counts = scratch.keep(gram_counts(learn, text_col, lang_col), "counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    if counts.count() <= BROADCAST_GRAMS:
        table = counts.toArrow()
        scratch.drop("counts")
        lang_of = np.asarray(table["lang"].to_pylist(), dtype=object)
        gram, n = np.asarray(table["gram"]).view(np.uint64), np.asarray(table["n"])
        by_lang = {}
        for lang in langs:
            k, c = gram[lang_of == lang], n[lang_of == lang]
            order = np.argsort(k)
            by_lang[lang] = k[order], c[order]
        model = spark.sparkContext.broadcast(fit_model(langs, by_lang))

        def apply(rows: DataFrame, work: Callable[[Model, pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part in pieces(batch, text_col):
                        yield work(model.value, part)

            return rows.mapInArrow(run, schema)
    else:
        alphabet, discount, stats = _joined_stats(scratch, counts, langs)
        block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
        docs = scratch.keep(docs.withColumns({"__block": block, "__learn": F.coalesce(of_use, F.lit(False))}), "blocks")
        looked_up = scratch.keep(_look_up(docs, stats, text_col), "looked_up")
        learn = docs.where("__learn")

        def apply(rows: DataFrame, work: Callable[[Model, pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
            def run(own: pa.Table, found: pa.Table) -> pa.Table:
                drop = [c for c in ("__block", "__learn") if c in own.column_names]
                batches = own.drop_columns(drop).combine_chunks().to_batches()
                parts = [part for batch in batches for part in pieces(batch, text_col)]
                done = [work(_block_model(langs, alphabet, discount, found, part[text_col].to_pylist()), part) for part in parts]
                return pa.Table.from_batches(done) if done else empty

            empty = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema).empty_table()
            return rows.groupBy("__block").cogroup(looked_up.groupBy("__block")).applyInArrow(run, schema)

    def calibrate(m: Model, part: pa.RecordBatch) -> pa.RecordBatch:
        _, explained, size, _ = _cross_entropies(m, part[text_col].to_pylist())
        return pa.RecordBatch.from_arrays([part[lang_col], pa.array(explained), pa.array(size)], names=["lang", "explained", "size"])

    measured = apply(learn.select(*[c for c in learn.columns if c == "__block"], text_col, F.col(lang_col).cast("string").alias(lang_col)), calibrate, "lang string, explained double, size long").where("size > 0")
    usual, between, single = _limits(langs, measured)

    def predict(m: Model, part: pa.RecordBatch) -> pa.RecordBatch:
        ce, explained, size, letters = _cross_entropies(m, part[text_col].to_pylist())
        best = ce.argmin(axis=1)
        low = ce.min(axis=1)
        odds = np.exp((low[:, None] - ce) * np.minimum(size, 40)[:, None])
        some = letters > 0
        score = np.where(some, 1 / odds.sum(axis=1), 0.0)
        limit = usual[best] + z * np.sqrt(between[best] + single[best] / np.maximum(size, 1))
        pred = pa.array([*langs, "und"], pa.string()).take(pa.array(np.where(some, best, len(langs))))
        return pa.RecordBatch.from_arrays([*part.columns, pred, pa.array(score), pa.array(low, mask=~some), pa.array(~some | (explained > limit))], names=[*part.schema.names, *new])

    return apply(docs, predict, schema)


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; texts with remainder 2 of 4 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    done = identify(docs, ~held_out)
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
