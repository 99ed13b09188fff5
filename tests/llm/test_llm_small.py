"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; brute force on small rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import bpe, embeddings, jaccard, language, merkle, packing, quality, substrings, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 160))) for _ in range(50)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    out = [*base, *base[:6], None, "", "   \n\t ", "one", "one", base[0] + " extra words here", passage, base[1] + " " + passage, passage + "\n" + base[2]]
    long = " ".join(r.choice(vocabulary) for _ in range(20_000))
    return [*out, long, long.replace(" ", "\n", 5), base[3] + "é ☃ 🤷 <|endoftext|> Σ"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 3 else "de", "s", None) for k, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], None, None, None), (5, "another text under a used id", None, None, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = bpe.encode_decode(docs.withColumn("ids", F.lit(1)), path)
    assert got.columns == [*DOCS.replace(",", "").split()[::2], "ids", "decoded"]
    for r in got.collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        want = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert ids == want and r["decoded"] == tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(none, path).count() == 0


def test_merges_skip_stale_entries():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("abc", "abc"): 3}
    assert bpe.merge_word(list("abcabc"), ranks) == ["abcabc"]
    assert bpe.merge_word(["x"], ranks) == ["x"] and bpe.merge_word([], ranks) == []


def test_substrings_equal_brute_force(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    window = 35
    seen = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((k, i))
    want = []
    for k, (i, t) in enumerate(rows):
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if len(seen[tuple(w[p : p + window])]) > 1:
                gone[p : p + window] = [True] * window
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [tuple(r) for r in substrings.remove_repeats(docs.withColumn("kept", F.lit(0)), window).collect()]
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substrings.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, 21)


def test_difference_cover_aligns_all_shifts():
    v, cover = substrings.PERIOD, set(substrings.COVER)
    for i, j in itertools.product(range(v), repeat=2):
        assert any((i + d) % v in cover and (j + d) % v in cover for d in range(v))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_equals_brute_force(spark, none):
    r = random.Random(9)
    rows = []
    for g in range(8):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(60, 200))]
        for c in range(r.randint(1, 40 if g == 0 else 6)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "a b"), (1004, rows[0][1]), (1004, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t) for _, t in rows]
    links = {k: [j for j in range(len(rows)) if j != k and sets[k] and sets[j] and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])] for k in range(len(rows))}
    want = []
    for k in range(len(rows)):
        reach, front = {k}, [k]
        while front:
            front = [j for x in front for j in links[x] if j not in reach and not reach.add(j)]
        want.append((rows[k][0], min(rows[j][0] for j in reach), len(links[k])))
    rows_of = jaccard.jaccard_classes(df.withColumn("h", F.lit(1)).withColumn("class_id", F.lit("x")))
    assert sorted(tuple(x)[:3] for x in rows_of.collect()) == sorted(want)
    assert rows_of.where("kept <> (doc_id = class_id)").count() == 0
    assert jaccard.jaccard_classes(none).count() == 0


def test_jaccard_splits_large_children(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    r = random.Random(2)
    common = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join([*common, *(f"u{r.randint(0, 10**9)}" for _ in range(80))])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " end") for k in range(5)]
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + k] == (k, 1) == got[k] for k in range(5)) and all(got[k] == (k, 0) for k in range(5, 60))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    x = np.concatenate([base, base[:10] + rng.normal(scale=0.15, size=(10, 8)), base[:3] * 2, base[:3]])
    label = [int(k) for k in rng.integers(0, 2, len(x))]
    rows = [(k, [float(v) for v in vec], label[k]) for k, vec in enumerate(x)]
    rows += [(90, None, 1), (91, [], 1), (92, [0.0] * 8, 1), (93, [float("nan")] * 8, 1), (94, [None] * 8, 1), (95, rows[0][1], None), (96, [1.0, 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    root = jaccard._forest(near)
    for k in range(len(x)):
        assert got[k] == (int(near[k].sum()), int(root[k]), bool(root[k] == k))
    assert all(got[k] == (0, k, True) for k in range(90, 97))
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_vectors_recall_on_a_planted_table(spark):
    """Thousands of vectors at graded distances, a dense group among them, scales near the ends of doubles; null ids and other columns."""
    rng = np.random.default_rng(14)
    base = rng.normal(size=(1200, 32))
    near = base[rng.integers(0, 1200, 2600)]
    near = near + rng.normal(size=near.shape) * rng.uniform(0.05, 0.5, (len(near), 1))
    dense = base[:1] + rng.normal(size=(500, 32)) * 0.27
    x = np.concatenate([base, near, dense])
    label = rng.integers(0, 3, len(x))
    label[-500:] = label[0]
    scale = np.where(np.arange(len(x)) % 97 == 0, 1e160, np.where(np.arange(len(x)) % 89 == 0, 1e-170, 1.0))
    rows = [(k, [float(v) for v in x[k] * scale[k]], int(label[k]), 7) for k in range(len(x))] + [(None, [1.0] * 32, 0, 7), (None, [1.0] * 32, 0, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid int").withColumn("component_id", F.lit("x"))
    found = embeddings.near_vectors(df).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert sorted(r["n_links"] for r in found if r["vec_id"] is None) == [1, 1]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    links = np.array([got[k][0] for k in range(len(x))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.9999 * near.sum() > 10_000
    root = jaccard._forest(near)
    assert np.mean([got[k][1] == root[k] for k in range(len(x))]) > 0.999


def test_estimates_are_unbiased_and_inside_their_bounds():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sign, factor = embeddings.codes(x)
    guess, error = embeddings.bounds(sign, factor, x)
    off = (guess - x @ x.T)[~np.eye(200, dtype=bool)]
    assert abs(off.mean()) < 0.005 and (np.abs(guess - x @ x.T) <= error).mean() > 0.9999


def leaf_ids(text):
    """Merkle tree by brute force: the fingerprint and its distinct leaves."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections, leaves = [], set()
    for s in text.split("\n\n"):
        paragraphs = []
        for p in s.split("\n"):
            own = [sha(x) for x in re.findall(r"[^.!?]{1,24}[.!?]*|[.!?]+", p, re.S)]
            leaves |= {x[:6] for x in own}
            paragraphs.append((sha("".join(own)), "".join(x[:6] for x in own)))
        sections.append((sha("".join(h for h, _ in paragraphs)), ",".join(f"{h[:16]}~{x}" for h, x in paragraphs)))
    return sha("".join(h for h, _ in sections)) + "|" + ";".join(f"{h[:16]}:{x}" for h, x in sections), leaves


def test_fingerprints(spark, docs, none):
    got = merkle.fingerprint_texts(docs.withColumn("fingerprint", F.lit(1))).select("text", "fingerprint").collect()
    assert all(r["fingerprint"] == leaf_ids(r["text"] or "")[0] for r in got)
    assert len({r["fingerprint"] for r in got}) == len({r["text"] or "" for r in got})
    a, b = "first line\nsecond line\n\nthird\n\nfourth", "first line\nsecond lime\n\nthird\n\nfourth\nmore"
    df = merkle.fingerprint_texts(spark.createDataFrame([(a, b)], "text string, other string")).withColumnRenamed("fingerprint", "fa")
    df = merkle.fingerprint_texts(df, "other")
    assert [tuple(x) for x in df.select(merkle.differing_paragraphs(F.col("fa"), F.col("fingerprint"))).first()[0]] == [(0, 1), (2, 1)]
    assert df.select(F.size(merkle.differing_paragraphs(F.col("fa"), F.col("fa")))).first()[0] == 0
    assert merkle.fingerprint_texts(none).count() == 0


@pytest.mark.parametrize("parts", [2, 7])
def test_fingerprint_query_equals_brute_force(spark, tmp_path, parts):
    r = random.Random(1)
    rows = [(k * 7 % 101, "".join(r.choice("abc é.\n") for _ in range(r.randint(0, 190)))) for k in range(60)] + [(500, None), (501, ""), (None, "no id"), (502, "x " * 30_000)]
    spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = merkle.op4_fingerprints(spark, str(tmp_path)).withColumn("leaves", merkle.leaves_of(F.col("fingerprint"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows) + 1
    by = {x["doc_id"]: x for x in got}
    order = sorted(rows, key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    near = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        (own, leaves), (new, other), (_, following) = leaf_ids(t), leaf_ids(edited), leaf_ids(after)
        x = by[i]
        assert (x["n_chars"], x["edited_sha256"], x["fingerprint"], x["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, new)
        assert abs(x["near_edited"] - near(leaves, other)) < 1e-12 and abs(x["near_next"] - near(leaves, following)) < 1e-12
        assert {f"{v:06x}" for v in x["leaves"]} == leaves


def test_fingerprint_query_of_an_empty_table_and_one_row(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert merkle.op4_fingerprints(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(1, "abcdef")], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    got = merkle.op4_fingerprints(spark, f"{tmp_path}/b").first()
    assert got["near_next"] == 1.0 and got["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_language(spark, none):
    r = random.Random(6)
    kinds = {"aa": ["kala", "tuna", "mika", "sola"], "bb": ["strz", "przy", "krzy", "wszy"]}
    rows = [(k, " ".join(r.choice(kinds[x]) for _ in range(30)), x) for k, x in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa"), (101, "", None), (102, "123 !!", "bb"), (103, "KALA Tuna", None), (104, "₿₿₿ " + "漢字語文" * 40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(3))
    got = {x["doc_id"]: x for x in language.identify(df, F.col("doc_id") % 4 != 2).collect()}
    assert all(got[k]["lang_pred"] == x and not got[k]["rejected"] for k, _, x in rows[:80])
    assert [got[k]["lang_pred"] for k in (100, 101, 102, 103)] == ["und", "und", "und", "aa"]
    assert got[102]["rejected"] and got[104]["rejected"] and got[104]["lang_pred"] in kinds
    tied = spark.createDataFrame([(1, "kala tuna", "zz"), (2, "kala tuna", "aa"), (3, "kala", None), (3, "kala", None)], "doc_id long, text string, lang string")
    assert [x["lang_pred"] for x in language.identify(tied, F.lit(True)).collect()] == ["aa"] * 4
    assert language.identify(none, F.lit(True)).count() == 0
    assert language.identify(df, F.lit(False)).where("lang_pred <> 'und'").count() == 0


def test_language_model_of_any_size_is_whole(spark, monkeypatch):
    r = random.Random(8)
    letters = {"aa": "abcdefghij", "bb": "klmnopqrst", "cc": "uvwxyzäöüß"}
    rows = [(k, " ".join("".join(r.choice(letters[x]) for _ in range(r.randint(2, 7))) for _ in range(50)), x) for k, x in enumerate(["aa", "bb"] * 60)]
    rows += [(900 + k, "vuxy wzäö üßuv", "cc") for k in range(3)]
    rows += [(1000, "vuxy wzäö", None), (1001, None, None), (1002, "", None), (1003, "漢字", None), (1004, "ab kl uv ₿", None), (None, rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    run = lambda: sorted(map(str, (tuple(x[c] if not isinstance(x[c], float) else round(x[c], 6) for c in x.asDict()) for x in language.identify(df, F.lit(True)).collect())))
    want = run()
    monkeypatch.setattr(language, "MAX_GRAMS", 50, raising=False)
    monkeypatch.setattr(language, "BROADCAST_GRAMS", 50, raising=False)
    monkeypatch.setattr(language, "BLOCK_BITS", 3, raising=False)
    assert run() == want
    got = {x["doc_id"]: x["lang_pred"] for x in language.identify(df, F.lit(True)).collect()}
    assert got[1000] == got[900] == "cc"


def test_rare_languages_are_calibrated(spark):
    r = random.Random(3)
    rare = [x["id"] for x in spark.range(10_000, 10_100).where(F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(2)) == 1).limit(3).collect()]
    rows = [(k, " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(4)), "aa") for k in range(8_100)]
    rows += [(k, "vuxy wzäö " * 40, "cc") for k in rare]
    rows += [(20_000, " ".join("".join(r.choice("uvwxyzäö") for _ in range(6)) for _ in range(80)), None)]
    got = {x["doc_id"]: x for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).where(F.col("doc_id") >= 10_000).collect()}
    assert all(got[k]["lang_pred"] == "cc" and not got[k]["rejected"] for k in rare)
    assert got[20_000]["lang_pred"] == "cc" and got[20_000]["rejected"]


def kneser_ney(texts, order=4):
    """Log probability of a character after its context by the formula, on plain strings."""
    lines = []
    for t in texts:
        t = re.sub(r"[^a-z]+", " ", t)
        lines.append(" " * (order - 1) + t)
    grams = [g[i : i + order] for g in lines for i in range(len(g) - order + 1)]
    counts = {order: {}}
    for g in grams:
        counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    letters = {g[-1] for g in counts[order]}
    discount = {}
    for k, c in counts.items():
        once, twice = (sum(v == n for v in c.values()) for n in (1, 2))
        discount[k] = once / (once + 2 * twice) if once else 0.5

    def p(gram, k):
        if k == 0:
            return 1 / (1 + len(letters))
        own = gram[len(gram) - k :]
        inside = [v for g, v in counts[k].items() if g[:-1] == own[:-1]]
        lower = p(gram, k - 1)
        if not inside:
            return lower
        return max(counts[k].get(own, 0) - discount[k], 0) / sum(inside) + discount[k] * len(inside) / sum(inside) * lower

    return p, letters


def test_kneser_ney_equals_the_formula():
    texts = ["abab abba baab", "abba cab abc", "bca cc"]
    key, _, _ = language.grams(texts)
    model = language.fit_model(["x"], {"x": np.unique(key, return_counts=True)})
    p, letters = kneser_ney(texts)
    pack = lambda g: sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(g))
    asked = ["".join(x) for x in itertools.product("abcz ", repeat=4)]
    got = np.exp(model.score(np.array([pack(g) for g in asked], dtype=np.uint64)))[:, 0]
    assert np.allclose(got, [p(g, 4) for g in asked], rtol=1e-4)
    for context in ("aba", " ab", "zzz"):
        assert abs(sum(p(context + x, 4) for x in letters) + p(context + "z", 4) - 1) < 1e-9


def test_foreign_texts_are_rejected_and_own_ones_kept(spark):
    r = random.Random(12)
    kinds = {"aa": ["kala", "tuna", "mika", "sola", "runa", "lemi", "taku"], "bb": ["strz", "przy", "krzy", "wszy", "szcz", "drza", "brze"]}
    text = lambda x, n: " ".join(r.choice(kinds[x]) + r.choice(["", "n", "s", "a"]) for _ in range(n))
    rows = [(k, text(x, r.choice([3, 20, 60, 200])), x) for k, x in enumerate(["aa", "bb"] * 150)]
    mixed = [(1000 + k, text("aa", 60) + ". " + text("bb", 60), "aa") for k in range(20)]
    foreign = ["".join(r.choice(x) for _ in range(n)) for n in (120, 400) for x in ("dfghjqwvx ", "漢字語文化", "абвгдежз ") for _ in range(10)]
    rows += mixed + [(2000 + k, t, None) for k, t in enumerate(foreign)] + [(3000, text("bb", 20_000), "bb")]
    got = {x["doc_id"]: x["rejected"] for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 4 != 2).collect()}
    assert sum(got[k] for k in got if k < 2000 or k == 3000) == 0
    assert all(got[2000 + k] for k in range(len(foreign)))


def test_quality(spark, none, docs):
    r = random.Random(3)
    good = lambda: ". ".join(" ".join(r.choice(["the", "house", "water", "many", "people", "walked", "under", "green", "trees"]) + r.choice("abcdefgh") for _ in range(9)) for _ in range(8)) + "."
    bad = lambda: " ".join(r.choice(["BUY", "NOW", "CHEAP", "DEAL"]) + "!!" for _ in range(70))
    rows = [(k, bad() if k % 10 == 0 else good()) for k in range(200)] + [(300, None), (301, ""), (0, good())]
    rows += [(None, rows[3][1]), rows[3], (302, rows[5][1] * 100)]
    got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))).collect()
    assert len({(x["text"], x["quality_score"]) for x in got}) == len({x["text"] for x in got})
    for x in got:
        assert x["kept"] == (x["text"] not in (None, "") and "!!" not in x["text"])
    assert quality.score_quality(none).count() == 0 and quality.score_quality(docs).count() == docs.count()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(7)
    weights, sizes = rng.normal(size=8), [3, 1, 5, 2]
    chains = np.concatenate(([0], np.cumsum(sizes)))
    emission = rng.normal(size=chains[-1])
    got, pairs = toxicity.marginals(emission, chains, weights)
    expected = np.zeros((2, 2))
    for a, b in zip(chains, chains[1:]):
        total, mass, moves = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            s = weights[y[0]] + weights[6 + y[-1]] + sum(emission[a + k] for k in range(b - a) if y[k]) + sum(weights[2 + 2 * p + q] for p, q in zip(y, y[1:]))
            total += np.exp(s)
            mass += np.exp(s) * np.array(y)
            for p, q in zip(y, y[1:]):
                moves[p, q] += np.exp(s)
        assert np.allclose(got[a:b], mass / total)
        expected += moves / total
    assert np.allclose(pairs, expected)


def test_toxicity(spark, none):
    r = random.Random(5)
    clean = lambda: " ".join(r.choice(["calm", "river", "stone", "light", "music", "paper"]) + r.choice("xyz") for _ in range(30)) + "."
    rows, labels = [], []
    for k in range(240):
        toxic = k % 4 == 0
        rows.append((k, clean() + (" you grumblefoo and nastybar. " if toxic else " ") + clean()))
        labels.append((k, int(toxic)))
    rows += [(500, None), (501, ""), (502, "  grumblefoo nastybar"), (0, rows[0][1])]
    rows += [(600, "calmé " * 20_000 + "grumblefoo nastybar"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    lab = spark.createDataFrame([*labels, (500, 1), (3, None)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(df, lab, F.col("doc_id") % 3 != 1).collect()}
    assert all((got[k]["score"] >= 0.7) == bool(t) for k, t in labels)
    assert [got[k]["text"][s["start"] : s["end"]] for k in (502, 600) for s in got[k]["spans"]] == ["grumblefoo nastybar"] * 2
    assert got[None]["score"] == got[0]["score"]
    assert got[500]["score"] < 0.5 and got[501]["spans"] == []
    assert toxicity.score_toxicity(none, lab, F.lit(True)).count() == 0
    assert toxicity.score_toxicity(df, lab.where("toxic = 1"), F.lit(True)).agg(F.max("score")).first()[0] == 0


def test_packing(spark, none, docs):
    rng = np.random.default_rng(2)
    longest = np.sort(rng.choice(60, 9, False)) + 1
    count, total = rng.integers(1, 9, 9), None
    total = count * longest - rng.integers(0, 3, 9)
    for buckets in (1, 2, 3, 4):
        bounds, cost = packing.best_boundaries(longest, count, total, buckets)
        best = min(sum(min(b for b in (*cut, longest[-1]) if b >= x) * c for x, c in zip(longest, count)) for n in range(buckets) for cut in itertools.combinations(longest[:-1], n)) - total.sum()
        assert cost == best and bounds[-1] == longest[-1] and len(bounds) <= buckets
    sized = packing.count_words(docs).withColumn("batch", F.lit(1))
    got = packing.pack(sized, budget=500, buckets=4).toPandas()
    assert len(got) == docs.count() and (got.n_tokens <= got.padded_to).all()
    for (_, padded), g in got.groupby(["bucket", "padded_to"]):
        sizes = g.groupby("batch").size()
        capacity = max(1, 500 // max(1, padded))
        assert sorted(sizes.index) == list(range(len(sizes))) and (sizes.sort_index()[:-1] == capacity).all() and sizes.max() <= capacity
    assert packing.pack(packing.count_words(none)).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.Com/x?y", "<p>" + "word " * 50), (2, "https://www.example.com/en/1", None), (3, "http://example.com/en/1#a", ""), (4, "nothing", "x"), (5, None, None), (6, "http://x.net/es/", "y"), (7, "http://net/fr/1", "y"), (8, "http://com", "z"), (9, "ftp://h?q/://", "z")]
    rows += [(100 + k, f"http://thin.bad.org/{k}", "<p>x") for k in range(40)] + [(200 + k, f"http://good.org/{k}", f"<p>page {k} " + "text " * 60) for k in range(40)] + [rows[0], (300, "http://same.org/a", "<p>" + "copy " * 60)] * 9
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "bad", "verdict")})
    assert urls.judge_urls(pages).count() == len(rows)
    got = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    told = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, outcome=(F.col("page_id") >= 200)).collect()}
    assert told[100] == "allow" and told[200] == "block" and told[1] == "allow"
    want = {1: ("a.com", "/x", "com/", "allow"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 3: ("example.com", "/en/1", "example.com/en/", "block"), 6: ("x.net", "/es/", "net/es/", "block"), 7: ("net", "/fr/1", "net/fr/", "block")}
    for k, v in want.items():
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == v
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in (4, 5, 8, 9)] == [("", "", None), ("", "", None), ("com", "", None), ("h", "", None)]
    assert got[100]["verdict"] == "block" and got[200]["verdict"] == "allow"
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_jaccard_recall_on_a_planted_table(spark):
    """Six thousand texts: graded copies in groups, one group of hundreds, a passage that many share."""
    r = random.Random(40)
    text = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage, rows, group = text(60), [], []

    def copies(n, edits):
        words_ = (passage if r.random() < 0.4 else []) + text(r.randint(40, 160))
        for _ in range(n):
            copy = list(words_)
            for _ in range(r.randint(0, edits)):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(copy)))
            group.append(g)

    for g in range(1500):
        copies(400 if g == 0 else r.choice([1, 2, 4, 8]), 5)
    got = {x["doc_id"]: x["n_links"] for x in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    sets, members, want = [shingles(t) for _, t in rows], {}, 0
    for k, g in enumerate(group):
        members.setdefault(g, []).append(k)
    found = 0
    for own in members.values():  # texts of different groups share the passage at most
        for i in own:
            n = sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in own)
            assert got[i] <= n
            want, found = want + n, found + got[i]
    assert found >= 0.999 * want > 20_000


def test_jaccard_with_null_and_repeated_ids(spark):
    r = random.Random(21)
    text = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    a, b, c = text(80), text(80), text(20_000)
    rows = [(None, a), (None, a + " more"), (7, a + " tail"), (None, b), (None, b), (9, b + " x"), (9, c), (3, c + " y"), (None, text(40)), (None, None)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x["doc_id"], x["class_id"], x["n_links"]) for x in got), key=str) == sorted([(None, 7, 2), (None, 7, 2), (7, 7, 2), (None, 9, 2), (None, 9, 2), (9, 9, 2), (9, 3, 1), (3, 3, 1), (None, None, 0), (None, None, 0)], key=str)
    assert sum(x["kept"] for x in got) == 5


def test_labellers_equal_a_plain_expectation_maximisation():
    r = np.random.default_rng(5)
    good = r.random(600) < 0.7
    n = len(quality.HEURISTICS)
    votes = np.where(r.random((600, n)) < 0.3, 2, np.where(r.random((600, n)) < 0.85, good[:, None], ~good[:, None]).astype(int))
    post = np.where((votes == 0).any(axis=1), 0.1, 0.99)
    for _ in range(200):
        weight = {1: post, 0: 1 - post}
        like = {}
        for y in (0, 1):
            like[y] = np.full(600, np.log((weight[y].sum() + 1) / 602))
            for j in range(n):
                for k in (0, 1):
                    like[y] = like[y] + np.where(votes[:, j] == k, np.log((weight[y][votes[:, j] == k].sum() + 1) / (weight[y].sum() + 2)), 0)
        post = 1 / (1 + np.exp(like[0] - like[1]))
    count = np.bincount(quality.patterns(votes), minlength=3**n).astype(float)
    assert np.allclose(quality.fit_labellers(count)[quality.patterns(votes)], post, atol=1e-6)
    assert ((post > 0.5) == good).mean() > 0.95


def test_reputation_equals_the_formula(spark):
    """Posteriors and bounds by plain code over hosts, domains and suffixes."""
    r = random.Random(9)
    hosts = {f"{h}.{d}.{x}": r.randint(1, 30) for x in ("org", "co.uk") for d in "pq" for h in "abc"} | {"": 4}
    rows = [(h, int(r.random() < (0.8 if ".p." in h else 0.1))) for h, n in hosts.items() for _ in range(n)] + [("lone.org", None)]
    got = {x["host"]: x for x in urls.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    n, bad = {}, {}
    for h, b in rows:
        n[h], bad[h] = n.get(h, 0) + (b is not None), bad.get(h, 0) + (b or 0)
    domain = lambda h: ".".join(h.split(".")[-3:]) if h.endswith(".co.uk") else ".".join(h.split(".")[-2:])
    suffix = lambda h: "co.uk" if h.endswith(".co.uk") else h.split(".")[-1]

    def strength(children, mean):
        pairs = [(n_, b, mean[k]) for k, (n_, b) in children.items() if n_]
        spread = sum(n_ * (b / n_ - m) ** 2 - m * (1 - m) for n_, b, m in pairs)
        share = sum((n_ - 1) * m * (1 - m) for n_, _, m in pairs)
        rho = min(spread / share, 0.999) if share > 0 and spread > 0 else 0.001
        return min(max(1 / max(rho, 0.001) - 1, 1), 1000)

    def level(name):
        out = {}
        for h in n:
            a = out.setdefault(name(h), [0, 0])
            a[0] += n[h]
            a[1] += bad[h]
        return out

    root = (sum(bad.values()) + 1) / (sum(n.values()) + 2)
    s1 = level(suffix)
    s = strength(s1, dict.fromkeys(s1, root))
    up = {k: (b + root * s) / (n_ + s) for k, (n_, b) in s1.items()}
    d1 = level(domain)
    of = {domain(h): up[suffix(h)] for h in n}
    s = strength(d1, of)
    up = {k: (b + of[k] * s) / (n_ + s) for k, (n_, b) in d1.items()}
    h1 = {h: (n[h], bad[h]) for h in n}
    of = {h: up[domain(h)] for h in n}
    s = strength(h1, of)
    for h in n:
        mean = (bad[h] + of[h] * s) / (n[h] + s)
        low = max(mean - 2 * (mean * (1 - mean) / (n[h] + s + 1)) ** 0.5, 0)
        assert abs(got[h]["posterior"] - mean) < 1e-9 and abs(got[h]["lower"] - low) < 1e-9


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Null and repeated ids, near copies and repeated passages; every stage held against plain code on its own input."""
    import corpus_pipeline
    from cohortlens.llm import stages

    r = random.Random(31)
    vocabulary = ["".join(r.choice("aeiou") + r.choice("lmnrst") for _ in range(r.randint(1, 4))) for _ in range(400)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    text = lambda: " ".join(sentence(9) for _ in range(r.randint(6, 14)))
    passage = " ".join(sentence(10) for _ in range(6))
    rows = [(k, text(), "en", "s", k) for k in range(120)]
    rows += [(200 + k, f"{text()} {passage} {text()}", "en", "s", None) for k in range(6)]
    rows += [(300 + k, rows[k][1] + " end", "en", "s", 1) for k in range(15)] + [(None, rows[20][1], None, None, None), (5, text(), "en", "s", 0), rows[7]]
    rows += [(400 + k, " ".join(r.choice(["BUY", "NOW", "CHEAP", "DEAL"]) + "!!" for _ in range(70)), "en", "s", 1) for k in range(15)] + [(450, "漢字語文 " * 60, None, "s", 1), (451, None, None, None, None), (452, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "substring dedup", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, str(tmp_path))
        if k < 4:
            assert docs.columns == before.columns
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        after[name] = before, docs
    before, kept = after["quality classifier"]
    assert plain(kept) == plain(before.where("text is not null and text <> '' and text not like '%!!%'"))
    before, kept = after["language ID"]
    assert {x["doc_id"] for x in before.join(kept, "doc_id", "left_anti").collect() if x["doc_id"] is not None} == {450}
    assert kept.where("doc_id <> 450 or doc_id is null").count() == before.where("doc_id <> 450 or doc_id is null").count()
    before, kept = after["n-gram Jaccard join"]
    given = sorted({(x["doc_id"], x["text"]) for x in before.collect()}, key=lambda x: (x[0] is None, x[0]))
    sets, chosen, group = [shingles(t) for _, t in given], [], list(range(len(given)))
    for i, j in itertools.combinations(range(len(given)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    chosen = [given[k] for k in range(len(given)) if group[k] == k]
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted(chosen, key=str)
    before, kept = after["substring dedup"]
    seen = {}
    for x in before.collect():
        w = words(x["text"])
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    want = []
    for x in before.collect():
        w = words(x["text"])
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        want.append((x["doc_id"], " ".join(y for p, y in enumerate(w) if p not in gone) if gone else x["text"]))
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted(want, key=str)
    assert sum(a != b for a, b in zip(sorted((x["text"] for x in before.collect())), sorted(x["text"] for x in kept.collect()))) > 0
    before, packed = after["packing"]
    assert packed.count() == before.count() and packed.where("n_tokens > padded_to").count() == 0
    assert plain(packed.groupBy("doc_id").count()) == plain(before.groupBy("doc_id").count())
    assert plain(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "bucket", "padded_to")) == plain(packed.select("doc_id", "n_tokens", "bucket", "padded_to"))
