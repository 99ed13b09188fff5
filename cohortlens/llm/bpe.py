"""Byte-pair encoding and decoding with a given vocabulary.

Merges of a word run over a doubly linked list of symbols. A heap holds (merge rank, place) of all adjacent
pairs; entries whose symbols have changed since are stale and skipped. Decoding concatenates the strings of the
vocabulary. The vocabulary file has a fixed size, is read once on the driver and broadcast; the work on texts is
one pass without a shuffle. Each task keeps the encodings of words that it has seen, up to ``cache_words``.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.textops import pieces
from cohortlens.runtime import with_fields

#: One encoder in each Python worker, so that its tasks share what they have cached: (key, encoder).
_ENCODER: list = [None, None]
#: A vocabulary file above this size is refused, as it is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Plain data of a tokenizer file: token ids, merge ranks, split pattern, special tokens."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    pattern: str
    end_of_word: str
    special: dict[str, int]
    strings: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read(MAX_VOCABULARY_BYTES + 1)
        if len(raw) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
        top = json.loads(raw)
        model, first = top["model"], top["pre_tokenizer"]["pretokenizers"][0]
        special = {t["content"]: t["id"] for t in top["added_tokens"]}
        strings = [""] * (1 + max([*model["vocab"].values(), *special.values()]))
        for token, k in [*model["vocab"].items(), *special.items()]:
            strings[k] = token
        ranks = {tuple(pair): k for k, pair in enumerate(model["merges"])}
        return cls(model["vocab"], ranks, first["pattern"]["Regex"], model["end_of_word_suffix"], special, strings)


def merge_word(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of a word after all merges, lowest rank first, leftmost first within a rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    text: list[str | None] = list(symbols)
    right, left = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(ranks[pair], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, (a, b) = heapq.heappop(heap)
        j = right[i]
        if j < 0 or text[i] != a or text[j] != b:
            continue  # stale: one of the two has been merged since
        text[i], text[j] = a + b, None
        right[i] = after = right[j]
        right[j] = -1
        if after >= 0:
            left[after] = i
            if (rank := ranks.get(pair := (text[i], text[after]))) is not None:
                heapq.heappush(heap, (rank, i, pair))
        if (before := left[i]) >= 0 and (rank := ranks.get(pair := (text[before], text[i]))) is not None:
            heapq.heappush(heap, (rank, before, pair))
    return [t for t in text if t is not None]


class Encoder(dict):
    """Maps a lower-case run between blanks to its ids as little-endian 32-bit bytes; unseen runs are encoded on access."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int):
        super().__init__()
        self.vocabulary, self.cache_words = vocabulary, cache_words
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.words = regex.compile(vocabulary.pattern).findall
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def _word(self, word: str) -> bytes:
        if (out := self.known.get(word)) is None:
            symbols = [self.letters[b] for b in word.encode()]
            symbols[-1] += self.vocabulary.end_of_word
            ids = self.vocabulary.ids
            out = np.asarray([ids[s] for s in merge_word(symbols, self.vocabulary.ranks) if s in ids], dtype="<u4").tobytes()
            if len(self.known) < self.cache_words:
                self.known[word] = out
        return out

    def __missing__(self, run: str) -> bytes:
        out = b"".join(map(self._word, self.words(run)))
        if len(self) < self.cache_words:
            self[run] = out
        return out

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        return b"".join(map(self.__getitem__, text.lower().replace("\n", " ").split(" ")))

    def encode(self, text: str) -> bytes:
        """Ids of a text; the strings of special tokens in it become those tokens."""
        if self.marks is None or self.marks.search(text) is None:
            return self._plain(text)
        special = self.vocabulary.special
        return b"".join(np.uint32(special[p]).tobytes() if p in special else self._plain(p) for p in self.marks.split(text) if p)

    def decode(self, ids: bytes) -> str:
        """Strings of the vocabulary, joined by a blank (the file names no decoder)."""
        return " ".join(map(self.vocabulary.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", cache_words: int = 300_000) -> DataFrame:
    """Adds the token ids of each whole text and the text decoded from them again.

    ``ids_col`` is binary: ids as little-endian unsigned 32-bit integers. A null or empty text has no ids and
    decodes to the empty string. Columns of the input with those two names are replaced; all others are kept.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(Vocabulary.read(vocab_path)), (uuid.uuid4().hex, cache_words)
    docs = docs.drop(*[c for c in (ids_col, decoded_col) if c in docs.columns])
    schema = with_fields(docs.schema, f"`{ids_col}` binary, `{decoded_col}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _ENCODER[0] != key:
            _ENCODER[:] = key, Encoder(shared.value, cache_words)
        encoder = _ENCODER[1]
        for batch in batches:
            for part in pieces(batch, text_col):
                ids = [encoder.encode(t) if t else b"" for t in part[text_col].to_pylist()]
                decoded = pa.array([encoder.decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), decoded], names=[*part.schema.names, ids_col, decoded_col])

    return docs.mapInArrow(run, schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
