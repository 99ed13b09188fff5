"""Byte-level byte-pair encoding and decoding through a sentencepiece model that is written, not trained.

A rank file names tokens by their bytes. Each byte stands for a printable letter, so that a token is a string, and a
model in sentencepiece's format lists these strings in the order of their ranks, scored by the negative rank, with
an identity normaliser: merging the pair with the highest score is then merging the pair with the lowest rank. Texts
are cut by a pattern, every match is encoded on its own, and decoding maps the letters of the pieces back to bytes.
The rank file has a fixed size, is read once on the driver, and the model is broadcast; the work on texts is one
pass without a shuffle.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.bpe import MAX_VOCABULARY_BYTES, byte_letters
from cohortlens.llm.textops import pieces
from cohortlens.runtime import with_fields

#: One codec in each Python worker, so that its tasks share what they have cached: (key, codec).
_CODEC: list = [None, None]
#: Kinds of a piece and of a model in the format.
_UNKNOWN, _BPE = 2, 2


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (lines of a base64 token and its rank) in the order of their ranks, which must be 0, 1, 2..."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, raw.splitlines())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks of {path} are not consecutive from 0")
    return [ranks[k] for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _piece(text: str, score: float, kind: int | None = None) -> bytes:
    """A piece of the model: its string, its score as a 32-bit float, and its kind unless it is a plain one."""
    return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + (b"" if kind is None else _number(3, kind)))


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece k is token k in byte letters, with score -k; the unknown piece comes last.

    Scores are exact up to 2**24 tokens. The unknown piece holds a blank, which no byte letter is, so it never collides.
    The normaliser is the identity: no prefix, no removed blanks, no escaped blanks.
    """
    letters = byte_letters()
    body = [_piece("".join(letters[b] for b in token), -float(k)) for k, token in enumerate(tokens)]
    trainer = _message(2, _number(3, _BPE))
    normaliser = _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return b"".join([*body, _piece(" unknown", 0.0, _UNKNOWN), trainer, normaliser])


class Codec:
    """Encodes texts run by run and match by match, and keeps what it has seen.

    A run ends before each blank that follows another character than white space. With a pattern that matches a
    blank only first in a match or among white space, no match crosses that place, nor looks over it, so runs can be
    encoded one by one. Runs and matches that some texts bring anew are encoded together in one call of the
    processor. What is kept is let go when it has more than ``cache_runs`` entries, or 32 characters for each of them.
    """

    def __init__(self, model: bytes, pattern: str, cache_runs: int):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        self.to_letters, to_bytes = dict(enumerate(letters)), {ord(c): b for b, c in enumerate(letters)}
        self.unknown = self.processor.vocab_size() - 1
        self.bytes_of = [p.translate(to_bytes).encode("latin-1") for p in self.processor.id_to_piece(list(range(self.unknown)))]
        self.matches, self.split = regex.compile(pattern).findall, re.compile(r"(?<=\S) ").split
        self.cache_runs = cache_runs
        self.known_runs: dict[str, bytes] = {}
        self.known_matches: dict[str, bytes] = {}
        self.characters = 0

    def runs(self, text: str) -> list[str]:
        first, *rest = self.split(text)
        return [first, *[" " + r for r in rest]]

    def _learn_matches(self, matches: set[str]) -> None:
        new = [m for m in matches if m not in self.known_matches]
        for match, ids in zip(new, self.processor.encode([m.encode().decode("latin-1").translate(self.to_letters) for m in new], num_threads=1)):
            if self.unknown in ids:
                raise ValueError(f"the vocabulary has no token for a byte of {match[:40]!r}")
            self.known_matches[match] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        by_text = [self.runs(t) for t in texts]
        if len(self.known_runs) > self.cache_runs or self.characters > 32 * self.cache_runs:
            self.known_runs.clear()
            self.known_matches.clear()
            self.characters = 0
        new = {r: self.matches(r) for r in {r for runs in by_text for r in runs} if r not in self.known_runs}
        self._learn_matches({m for matches in new.values() for m in matches})
        for run, matches in new.items():
            self.known_runs[run] = b"".join(map(self.known_matches.__getitem__, matches))
            self.characters += len(run)
        return [b"".join(map(self.known_runs.__getitem__, runs)) for runs in by_text]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", cache_runs: int = 500_000) -> DataFrame:
    """Adds the token ids of each whole text (array of ints) and the bytes decoded from them again (binary).

    ``pattern`` must match a blank only first in a match or among white space, as such patterns do. A null or empty
    text has no ids and decodes to no bytes; strings of special tokens are ordinary text. Columns of the input with
    those two names are replaced, all others kept. Rows are encoded one by one, so repeated rows and null ids change
    nothing; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(serialised_model(read_ranks(ranks_path))), (uuid.uuid4().hex, cache_runs)
    docs = docs.drop(*[c for c in (ids_col, decoded_col) if c in docs.columns])
    schema = with_fields(docs.schema, f"`{ids_col}` array<int>, `{decoded_col}` binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _CODEC[0] != key:
            _CODEC[:] = key, Codec(shared.value, pattern, cache_runs)
        codec = _CODEC[1]
        for batch in batches:
            for part in pieces(batch, text_col):
                raw = codec.encode([t or "" for t in part[text_col].to_pylist()])
                ids = np.frombuffer(b"".join(raw), dtype="<i4")
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int64)
                decoded = [codec.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.binary())], names=[*part.schema.names, ids_col, decoded_col])

    return docs.mapInArrow(run, schema)


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
