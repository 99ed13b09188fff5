"""Work that grows no faster than the input: the same results as by hand, and no step that makes more rows."""

import hashlib
import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import enrich as E, intervals as I, nulls as N, search as S, sets as T
from cohortlens.plans import files, spans
from cohortlens.sources import readers


def test_sizes_without_a_member_copy_no_collection(spark):
    r = random.Random(1)
    rows = sorted({(r.randrange(30), r.randrange(40)) for _ in range(200)}) + [(90, 1), (91, 2), (92, None), (None, 1), (None, 3)]
    sets = spark.createDataFrame(rows, "s int, g int").repartition(3)
    asked = sets.where("g % 3 = 1 or g is null")
    got = T.sizes_without(sets, asked, "s", "g")
    want = T.remove_member(sets, asked, "g").groupBy("s", "left_out").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {tuple(x) for x in got.where("s = 90").collect()} == {(90, k, 1) for k in range(4, 40, 3)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # counted first, then repeated
    assert T.sizes_without(sets, sets.limit(0), "s", "g").count() == 0


def test_mean_logs_that_tie_but_for_rounding_are_ties(spark):
    """13 * 33 * 69 = 11 * 39 * 69, and the sums of logarithms differ by the order of their terms."""
    pairs = list(itertools.product(itertools.permutations((12, 32, 68)), itertools.permutations((10, 38, 68))))
    rows = [(k, c, v) for k, both in enumerate(pairs) for c, own in enumerate(both) for v in own] + [(99, 0, 7), (99, 1, 8)]
    values = spark.createDataFrame(rows, "g int, c int, v long").coalesce(1)
    markers = values.select("g", "c").distinct()
    got = {r["c"]: (r["n_markers"], r["highest"]) for r in E.marker_purity(markers, values, "g", "c", "v").collect()}
    assert got == {0: (37, 0.0), 1: (37, 1 / 37)}
    chosen = E.marker_select(values, "g", "c", "v", n=50).where("g < 99").collect()
    assert len(chosen) == 36 and {(r["c"], r["lead"]) for r in chosen} == {(1, 0.0)}


def test_masked_intervals_reach_beyond_a_fixed_length(spark, tmp_path):
    part = spark.range(9000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), (F.col("id") % 4).cast("string")).alias("p_brand"), F.when(F.col("id") % 4 == 3, 1).otherwise(50).alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(spans.Q.oracles["prj27_mask_intervals"]).fetchall()
    assert sorted(map(tuple, spans.Q.queries["prj27_mask_intervals"](spark, str(tmp_path)).collect())) == sorted(want)
    assert max(w[2] for w in want) == 22500


def test_similar_letters_leave_few_places_to_compare():
    """Pieces of three letters lie at every other place of a text; the whole word by groups of letters at a few."""
    r = random.Random(2)
    words = ["".join(r.choice("aeioubdptmn") for _ in range(9)) for _ in range(40)]
    text = "".join(r.choice("aeioubdptmn") for _ in range(20_000)) + "".join(words)
    similar = ["aeiou", "bdpt", "mn"]
    block = S._Blocks(words, 2, similar, 1.0)
    which, start = block.places(text)
    assert {(k, 20_000 + 9 * k) for k in range(40)} <= set(zip(which.tolist(), start.tolist())) and len(which) < 400
    assert len(S._Blocks(words, 2, [], 1.0).places(text)[0]) > 1_000
    assert len(S._Blocks(words, 2, ["aeiou", "bdpta"], 1.0).places(text)[0]) > 1_000  # a letter in two groups


def _intervals(r, n, extra):
    """Mostly short intervals, a few long ones, empty, reversed and null ones."""
    long = lambda: r.choice([r.randrange(1, 60)] * 6 + [r.randrange(1, 5000), 0, -3])
    rows = [(k, r.choice("ab"), r.choice("xy"), s, s + long()) for k in range(n) for s in [r.randrange(-300, 3000)]]
    return rows + [(n, "a", None, 1, 50), (n + 1, None, "x", 5, 2500), (n + 2, "a", "x", None, 9), *extra]


def _overlapping(reads, regions):
    for a in reads:
        for b in regions:
            if a[2] is not None and a[2] == b[2] and None not in (a[3], a[4], b[3], b[4]) and a[3] < a[4] and b[3] < b[4] and a[3] < b[4] and b[3] < a[4]:
                yield a, b, max(a[3], b[3]), min(a[4], b[4])


def test_counts_and_depths_make_no_pairs(spark, monkeypatch):
    r = random.Random(3)
    reads, regions = _intervals(r, 150, [(900, "b", "x", -100_000, 200_000)]), _intervals(r, 80, [(901, "b", "x", 0, 90_000), (902, "a", "y", 100, 164)])
    regions += [(k + 2000, *x[1:]) for k, x in enumerate(regions[:20])]  # equal places
    schema = "id int, grp string, contig string, s long, e long"
    a, b = spark.createDataFrame(reads, schema).repartition(3), spark.createDataFrame(regions, schema).repartition(3)
    each, depth, length = Counter(), Counter(), Counter()
    for x, y, s, e in _overlapping(reads, regions):
        each[x[1], y[0]] += 1
        depth[x[1], y[1]] += e - s
    for x in regions:
        length[x[1]] += x[4] - x[3] if x[3] is not None else 0
    wanted = {(k, c): v / length[c] for (k, c), v in depth.items() if c is not None}
    got_depth = I.region_depth(a, b.withColumnRenamed("grp", "cls"), ["grp"], "cls", block=64)
    assert {(x["grp"], x["cls"]): x["depth"] for x in got_depth.collect()} == wanted
    assert I.region_depth(a.limit(0), b.withColumnRenamed("grp", "cls"), ["grp"], "cls").count() == 0
    monkeypatch.setattr(I, "overlap_pairs", None)  # counted, not paired
    for width in (8, 64):
        got = I.count_overlaps(a, b, "id", ["grp", "b_id"], unique=True, width=width)
        assert got.columns == ["grp", "b_id", "n"] and {(x["grp"], x["b_id"]): x["n"] for x in got.collect()} == each
    assert I.count_overlaps(a.limit(0), b, "id", ["grp", "b_id"], unique=True).count() == 0


def test_clipped_intervals_are_counted_before_they_meet(spark):
    r = random.Random(4)
    reads = _intervals(r, 120, [(5, "b", "x", 10, 90), (5, "b", "x", 20, 95), (5, "a", "x", 10, 90), (7, "a", "y", -100_000, 4_000)])
    regions = _intervals(r, 90, [(901, "b", "x", 0, 90_000), (902, "a", "y", 100, 164)])
    regions += regions[:20]
    schema = "id int, grp string, contig string, s long, e long"
    a, b = spark.createDataFrame(reads, schema).repartition(3), spark.createDataFrame(regions, schema).repartition(3)
    want = Counter((x[0], x[2], s, e) for x, _, s, e in _overlapping(reads, regions))
    for width in (8, 64):
        got = I.intersect_counts(a, b, "id", width=width).collect()
        assert {(x["id"], x["contig"], x["s"], x["e"]): x["n"] for x in got} == want and len(got) == len(want)
    few, many = (spark.range(n).select(F.lit("x").alias("contig"), F.lit(0).alias("s"), F.lit(50).alias("e")) for n in (1, 3000))
    out = I.intersect_counts(few.withColumn("id", F.lit(1)), many, "id")
    assert [tuple(x) for x in out.collect()] == [(1, "x", 0, 50, 3000)]


def shuffled_bytes(spark):
    """Bytes that the stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_requests_for_draws_copy_no_ranking(spark, tmp_path):
    r = random.Random(3)
    stat = [r.random() for _ in range(N.CHUNK + 900)]
    ranked = spark.createDataFrame([(0, k + 1, x) for k, x in enumerate(stat)], "b int, rank long, stat double")
    N.weight_chunks(ranked, ["b"]).write.parquet(str(tmp_path / "chunks"))
    removed = {q: sorted(r.sample(range(1, len(stat) + 1), 1 + q % 3)) for q in range(160)}
    asked = [(0, q, len(stat) - len(gone), [2, 4 + q % 2], gone) for q, gone in removed.items()]
    requests = spark.createDataFrame(asked, "b int, q int, n long, sizes array<long>, removed array<long>")
    before = shuffled_bytes(spark)
    got = N.null_blocks(spark.read.parquet(str(tmp_path / "chunks")), requests, ["b"], ["q"], 6, 1).collect()
    assert shuffled_bytes(spark) - before < 4_000_000  # a copy for each eight requests: ten million
    assert sorted((x["q"], x["size"]) for x in got) == sorted((q, s) for _, q, _, sizes, _ in asked for s in sizes)
    for x in got:
        n, most = len(stat) - len(removed[x["q"]]), 4 + x["q"] % 2
        ranks = np.stack([N._draw(1, d, n, most) for d in range(6)])
        weights = np.array(stat)[N.original_ranks(ranks, np.array(removed[x["q"]])) - 1]
        assert np.allclose(x["nulls"], N.null_scores(ranks[:, : x["size"]], weights[:, : x["size"]], n, x["size"]), rtol=1e-12)


def test_entropy_of_long_texts_makes_no_rows_of_pieces(spark, monkeypatch):
    """The same as by counting each window, whatever the pieces, the letters and what lies beside a text."""
    r = random.Random(4)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("ab", "acgt", "abc\U0001f600é", "".join(map(chr, range(0x4E00, 0x9000)))) for n in (19, 20, 21, 300, 9000)] + ["a" * 20, "ab" * 40, None, ""]

    def entropy(s):
        windows = [Counter(s[i + j : i + j + 5] for j in range(16)) for i in range(len(s) - 19)]
        return sum(-sum(v / 16 * math.log2(v / 16) for v in w.values()) / 4 for w in windows) / len(windows)

    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string").repartition(2)
    out = S.sequence_entropy(df, "k", "s")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x["k"]: x["entropy"] for x in out.collect()}
    want = {k: entropy(s) for k, s in enumerate(texts) if s and len(s) >= 20}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    codes = S._codes(texts[4] + texts[9])
    whole = S._window_entropies(codes, 5, 20)
    monkeypatch.setattr(S, "PIECE", 64)
    assert np.array_equal(whole, S._window_entropies(codes, 5, 20)) and len(np.unique(S._kmer_codes(S._codes(texts[19]), 5))) > 8_900


def test_shuffles_of_one_small_file_are_dealt_out(spark):
    rows = spark.createDataFrame([(k, "abcdefg"[: k % 8]) for k in range(50)] + [(50, None)], "k int, s string").coalesce(1)
    out = E.shuffled_sequences(rows, "k", "s", 3, 9)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    order = lambda k, n, s: "".join(c for _, c in sorted((hashlib.md5(f"9|{k}|{n}|{i}".encode()).hexdigest(), c) for i, c in enumerate(s, 1)))
    want = {(k, n): order(k, n, "abcdefg"[: k % 8]) for k in range(50) for n in (1, 2, 3)} | {(50, n): None for n in (1, 2, 3)}
    assert {(x["k"], x["shuffle"]): x["s"] for x in out.collect()} == want


def test_lines_are_numbered_and_records_made_without_a_shuffle_of_lines(spark, tmp_path):
    """Files of many blocks, several of them a task; empty lines, a carriage return, a record that ends early."""
    r = random.Random(5)
    made = {f: [x for k in range(n) for x in (f"@{f}{k} x", "ACGT"[: r.randrange(1, 5)] * 20 if k % 50 else "", "+", "@III" + "I" * r.randrange(90))] for f, n in (("a", 3000), ("b", 2500), ("c", 1))}
    made["c"] = made["c"][:2]
    for f, lines in made.items():
        (tmp_path / f"{f}.fq").write_bytes(("\r\n" if f == "b" else "\n").join(lines).encode())
    confs = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "10"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        before = shuffled_bytes(spark)
        got = {(x["file"][-4], x["n"]): x["value"] for x in readers._numbered(spark, str(tmp_path)).collect()}
        assert shuffled_bytes(spark) - before < 60_000  # once all lines
        assert got == {(f, n): x for f, lines in made.items() for n, x in enumerate(lines) if x}
        records = sorted((x["name"], x["seq"], x["qual"]) for x in readers.read_fastq(spark, str(tmp_path)).collect() if x["seq"])
        assert len(records) == 60 * 49 + 50 * 49 and records == sorted((v[k][1:].split()[0], v[k + 1], v[k + 3]) for v in made.values() for k in range(0, len(v) - 3, 4) if v[k + 1])
        assert readers.read_fastq(spark, str(tmp_path)).where("seq is null or qual is null").count() == 60 + 50 + 1
    finally:
        for k in confs:
            spark.conf.unset(k)


def test_small_files_are_written_by_all_tasks(spark):
    texts = [f"{k}\n\n{k + 1}" for k in range(60)]
    path = files._file_each(spark.createDataFrame([(x,) for x in texts], "line string").coalesce(1), "t")
    got = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_path").alias("p")).collect()
    assert sorted(x["value"].removesuffix("\n") for x in got) == sorted(texts) and all(x["p"].endswith(f"/t/{x['f']}") for x in got)
    assert len({x["f"][:10] for x in got}) > 1  # part-00000 and others


def test_a_ranking_is_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    ranked = spark.createDataFrame([(0, g, 9.5 - g, g + 1) for g in range(20)], "d int, g int, stat double, rank int").mapInPandas(counted, "d int, g int, stat double, rank int")
    sets = spark.createDataFrame([(s, g) for s in range(3) for g in range(s, 20, 4)], "s int, g int")
    assert E.enrichment_test(ranked, sets, ["d"], "s", "g", n_perm=4, least=1, few=0).count() == 3
    assert made.value == 20
