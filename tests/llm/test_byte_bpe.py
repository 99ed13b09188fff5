"""Byte-level BPE: equal to the tiktoken library on whole texts, odd characters, and empty or repeated rows."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import bytebpe

DOCS = "doc_id long, text string, ids string, source string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(3)
    letters = " \n\t\r\x0b\x1c\x85\xa0　 ab1.'sré☃<|>🤷" + 6 * " "
    yield from ("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000))
    yield from ("it's they'll WE'RE I'd", "<|endoftext|> unknown", "  two  blanks  ", "\n \n a", "\u0000\u0001", "a" * 50_000, " " * 5_000, "ab1" * 20_000, "naïve é ﬁ")


def test_equals_the_library(spark, library):
    path, pattern, encoding = library
    texts = [*odd_texts(), None, "", "same", "same"]
    rows = [(k if k % 7 else None, t, "x", "s") for k, t in enumerate(texts)]
    got = bytebpe.encode_decode(spark.createDataFrame(rows, DOCS).repartition(3), path, pattern)
    assert got.columns == ["doc_id", "text", "source", "ids", "decoded"]
    for r in got.collect():
        text = r["text"] or ""
        assert r["ids"] == encoding.encode_ordinary(text), repr(text[:60])
        assert bytes(r["decoded"]) == text.encode()
    assert bytebpe.encode_decode(spark.createDataFrame([], DOCS), path, pattern).count() == 0


def test_merging_in_the_model_finds_every_token_of_the_vocabulary(library):
    path, pattern, _ = library
    tokens = bytebpe.read_ranks(path)
    codec = bytebpe.Codec(bytebpe.serialised_model(tokens), pattern, 1000)
    assert codec.bytes_of == tokens
    letters = bytebpe.byte_letters()
    assert codec.processor.encode(["".join(letters[b] for b in t) for t in tokens]) == [[k] for k in range(len(tokens))]


def test_what_is_kept_is_bounded_and_does_not_change_ids(library):
    path, pattern, encoding = library
    codec = bytebpe.Codec(bytebpe.serialised_model(bytebpe.read_ranks(path)), pattern, 50)
    for text in odd_texts():
        assert codec.encode([text, text])[1] == bytebpe.np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert codec.characters <= 32 * 50 + len(text)


def test_ranks_must_be_consecutive_and_bytes_known(tmp_path):
    (tmp_path / "gap").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="consecutive"):
        bytebpe.read_ranks(str(tmp_path / "gap"))
    (tmp_path / "few").write_text("YQ== 0\n")
    codec = bytebpe.Codec(bytebpe.serialised_model(bytebpe.read_ranks(str(tmp_path / "few"))), r"\S+|\s+", 10)
    with pytest.raises(ValueError, match="no token"):
        codec.encode(["b"])


def test_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in bytebpe.op12_byte_bpe(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(rows)
    for r in rows:
        ids, one = library[2].encode_ordinary(r["text"]), got[r["doc_id"]]
        assert one["n_tokens"] == len(ids)
        assert one["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert one["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
