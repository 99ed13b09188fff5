"""Jaccard join of documents on word n-grams by chosen paths.

Each document is its set of hashed 5-word shingles. Documents with equal sets form a class, which takes part once.
Per run, a class follows at each node of a tree the tokens that a hash of (node, token) selects at rate
``branch / set size``; so two similar sets choose common tokens, hence common children. Children with one class
are dropped, small ones are compared by brute force, large ones are split again. To split a group of near copies
would never end: in a large child each class is held against a few leaders, against the first of them once for all
children that have the same first. Those near one are linked to it and leave; those within reach of such a class (by the triangle inequality of Jaccard distance) are linked and go on. Runs are
repeated until the recall that ``branch`` gives for pairs at the threshold reaches ``recall``.

All this works on a coordinated sample of each set (about 64 tokens), and only yields candidate components. The
true sets of each component are then compared exactly, in blocks of at most ``2 * BLOCK`` classes, which count
links and emit a spanning forest of them, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.textops import U64, Words, mix, pieces, split_words, window_hashes, window_starts, word_hashes
from cohortlens.operators.graph import connected_components
from cohortlens.runtime import Scratch, shuffle_partitions

#: Expected size of the sample of a set.
POOL = 64
#: Children with at most so many classes are compared by brute force.
SMALL = 128
#: In a large child, classes so similar to a leader leave the tree; those so similar, which any class at the threshold
#: from one that left must be, are linked to that leader or one that stands for it. The partner of a class that left
#: has 0.3 with the leader at least, so its estimate is below REACH only if it is two standard errors (0.05) off.
NEAR, REACH = 0.5, 0.2
#: Rows of a large child that are held against its leaders in one group.
SHARE = 512
#: Leaders of a large child at most.
LEADERS = 8
#: Expected children of a class at the nodes below the root. With more, classes that share a common passage would follow its
#: tokens together from level to level and their rows not fall; what pairs lose by fewer, runs make up for at the root.
DEEP_BRANCH = 1.5
#: Classes in a block of the exact comparison, and shingles (about) that it holds at most.
BLOCK, BLOCK_TOKENS = 128, 2_000_000
#: From this depth on, large children are compared in blocks of SMALL.
DEPTH = 4
_TOP = 2.0**64


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of the distinct shingles of a batch, sorted by both.

    A document with fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(words)
    doc = np.repeat(np.arange(len(words.first) - 1), words.count)
    at = np.flatnonzero(window_starts(words.first, width))
    docs, hashes = [doc[at]], [window_hashes(h, width)[at] if len(at) else np.zeros(0, np.uint64)]
    for short in range(1, width):
        which = np.flatnonzero(words.count == short)
        if len(which):
            docs.append(which)
            hashes.append(mix(window_hashes(h, short)[words.first[which]], short))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
    return doc[new], h[new]


def _keys(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, and two order-free 64-bit keys of each set."""
    size = np.bincount(doc, minlength=n_docs)
    end = np.cumsum(size)
    sums = []
    for seed in (1, 2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h, seed), dtype=np.uint64)))
        sums.append((total[end] - total[end - size]).view(np.int64))
    return size, *sums


def _rate(size: np.ndarray, expected: float) -> np.ndarray:
    """Thresholds on 64-bit hashes that select ``expected`` of ``size`` values on average."""
    share = np.minimum(1.0, expected / np.maximum(size, 1))
    return np.where(share >= 1, U64(2**64 - 1), (np.minimum(share, 1 - 2.0**-53) * _TOP).astype(np.uint64))


def _likeness(sizes: np.ndarray, pools: list[np.ndarray]) -> np.ndarray:
    """Estimated Jaccard of all pairs; each pool is compared below the smaller of two thresholds."""
    top = _rate(sizes, POOL)
    common = _common(pools)
    below = np.array([np.searchsorted(p, np.minimum(top, t), side="right") for p, t in zip(pools, top)])
    union = below + below.T - common
    return np.where(union > 0, common / np.maximum(union, 1), 0)


def _alike(n: int, a: np.ndarray, m: int, b: np.ndarray) -> float:
    """The same estimate for one pair."""
    top = _rate(np.array([max(n, m)]), POOL)[0]
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = int(np.searchsorted(a, top, side="right")) + int(np.searchsorted(b, top, side="right")) - common
    return common / union if union > 0 else 0.0


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct values."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    mask = count[token] > 1
    owner, token = owner[mask], shared[token[mask]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out, step = np.zeros((n, n), dtype=np.float64), 1 << 14
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        a, b = np.searchsorted(token, [low, low + step])
        grid = np.zeros((n, min(step, int(token[b - 1]) - low + 1)), dtype=np.float32)
        grid[owner[a:b], token[a:b] - low] = 1
        out += grid @ grid.T
    return out


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row of its component."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] < 0:
            reach = np.zeros(len(linked), dtype=bool)
            front = np.array([k])
            while len(front):
                reach[front] = True
                front = np.flatnonzero(linked[front].any(axis=0) & ~reach)
            root[reach] = k
    return root


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of a partition that is sorted by keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([np.asarray(batch[k], dtype=np.int64) for k in keys])
        cut = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            key = tuple(cols[:, a].tolist())
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _paired(df: DataFrame, size_col: str, block: int) -> DataFrame:
    """Rows of each group dealt to all pairs of its blocks that hold them: columns bi <= bj, and own (the row's block)."""
    blocks = F.ceil(F.col(size_col) / block).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    return df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other")


def runs_for(recall: float, threshold: float, branch: float) -> int:
    """Runs that find a pair at the threshold with probability ``recall``, if every tree is DEPTH levels deep."""
    lost = 0.0
    for level in range(DEPTH, -1, -1):
        lost = math.exp(-(branch if level == 0 else DEEP_BRANCH) * threshold * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def _expand(branch: float, runs: int):
    """Root children of all runs: rows (cid, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, path = [], []
            for c, n, pool in zip(*(batch[k].to_pylist() for k in ("cid", "n", "pool"))):
                tokens = np.frombuffer(pool, "<u8")
                top = _rate(np.array([min(n, POOL)]), branch)[0]
                for r in range(runs):
                    chosen = mix(tokens, 100 + r)
                    chosen = chosen[mix(chosen, 1) <= top]
                    cid.append(np.full(len(chosen), c)), path.append(chosen.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.zeros(0, np.int64)]), pa.int64()) for x in (cid, path)], names=["cid", "path"])

    return run


def _stands_for(leaders: list) -> list[int]:
    """For each leader the first of those that it is linked with, directly or by way of others in reach."""
    pools = [np.frombuffer(x["pool"], "<u8") for x in leaders]
    return _forest(_likeness(np.array([x["n"] for x in leaders]), pools) >= REACH).tolist()


def _split(at: int):
    """In large children: a row a class, with a link if leaders are in reach and the next level's children if none is near.

    Leaders whose groups a class joins are linked with each other once, not by every such class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[int]] = {}  # of the child at hand
        joined: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            for c, p, n, pool, leaders in zip(*(batch[k].to_pylist() for k in ("cid", "path", "n", "pool", "leaders"))):
                if p not in groups:
                    groups, joined = {p: _stands_for(leaders)}, set()  # rows come sorted by path
                tokens = np.frombuffer(pool, "<u8")
                like = [1.0 if c == x["cid"] else _alike(n, tokens, x["n"], np.frombuffer(x["pool"], "<u8")) for x in leaders]
                reached = sorted({groups[p][k] for k, value in enumerate(like) if value >= REACH})
                link = leaders[reached[0]]["cid"] if reached and leaders[reached[0]]["cid"] != c else None
                for other in reached[1:]:
                    if (reached[0], other) not in joined:
                        joined.add((reached[0], other))
                        out.append((leaders[other]["cid"], leaders[reached[0]]["cid"], None, None, []))
                children = []
                if max(like) < NEAR:
                    chosen = mix(tokens ^ U64(p % 2**64), 1000 + at)
                    children = chosen[mix(chosen, 1) <= _rate(np.array([min(n, POOL)]), DEEP_BRANCH)[0]].view(np.int64).tolist()
                if children:
                    out.append((c, link, n, pool, children))
                elif link is not None:
                    out.append((c, link, None, None, []))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["cid", "leader", "n", "pool", "children"])

    return run


def _near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, first): classes that are near the first leader of children that they are in."""
    for batch in batches:
        rows = zip(*(batch[k].to_pylist() for k in ("cid", "n", "pool", "first", "ln", "lpool")))
        near = [(c, f) for c, n, pool, f, ln, lpool in rows if c == f or _alike(n, np.frombuffer(pool, "<u8"), ln, np.frombuffer(lpool, "<u8")) >= NEAR]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in near], pa.int64()) for k in (0, 1)], names=["cid", "first"])


def _compare_pools(threshold: float):
    """Forest of likely links in each small child."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_key(batches, ["path", "bi", "bj"]):
            t = t.combine_chunks()
            cid, n = np.asarray(t["cid"]), np.asarray(t["n"])
            pools = [np.frombuffer(x, "<u8") for x in t["pool"].to_pylist()]
            ratio = np.minimum(n[:, None], n[None]) / np.maximum(n[:, None], n[None])
            slack = np.where(np.maximum(n[:, None], n[None]) <= POOL, 1e-9, 0.2)  # small sets are whole in their samples
            root = _forest((_likeness(n, pools) >= threshold - slack) & (ratio >= threshold - 1e-9))
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[root[at]])], names=["src", "dst"])

    return run


def _verify(threshold: float):
    """Exact links in each block pair: per class the linked documents in it, and a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bi, bj), t in _by_key(batches, ["comp", "bi", "bj"]):
            t = t.combine_chunks()
            cid, first = np.unique(np.asarray(t["cid"]), return_index=True)
            t = t.take(pa.array(first))
            n, size, own = (np.asarray(t[k]) for k in ("n", "size", "own"))
            common = _common([np.frombuffer(x, "<u8") for x in t["tokens"].to_pylist()])
            linked = common >= threshold * (n[:, None] + n[None] - common) - 1e-9
            np.fill_diagonal(linked, False)
            if bi != bj:
                linked &= own[:, None] != own[None]
            root = _forest(linked)
            at = np.flatnonzero(linked.any(axis=1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[root[at]]), pa.array((linked @ size)[at].astype(np.int64))], names=["cid", "root", "links"])

    return run


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.999, branch: float = 3.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, class_id, n_links, text_hash, kept) for every row of docs.

    Two documents are linked if the Jaccard similarity of their sets of ``width`` consecutive words (words split
    at ASCII white space, unchanged) is at least ``threshold``. ``n_links`` counts the other rows linked directly,
    ``class_id`` is the smallest id reachable by links. A text with fewer words is one shingle; a null text or one
    without words links with nothing and is its own class. Rows that repeat an id are documents of their own; a
    null id never names a class that has another. ``kept`` marks the row of a class with the smallest id and then the
    smallest ``text_hash`` (xxhash64 of the text); rows equal in both are marked alike. An empty table gives an empty
    one; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                doc, h = shingle_sets(split_words(part["text"]), width)
                n, k1, k2 = _keys(doc, h, part.num_rows)
                token = mix(h, 3)
                mask = token <= _rate(n, POOL)[doc]
                order = np.lexsort((token[mask], doc[mask]))
                token, owner = token[mask][order], doc[mask][order]
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                pool = pa.array([token[a:b].astype("<u8").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part["id"], part["h"], pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pool], names=["id", "h", "n", "k1", "k2", "pool"])

    sketches = scratch.keep(texts.mapInArrow(sketch, "id long, h long, n long, k1 long, k2 long, pool binary"), "sketches")
    key = ["k1", "k2", "n"]
    classes = sketches.where("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("rep"), F.count("*").alias("size"), F.first("pool").alias("pool"))
    classes = classes.select(*key, F.col("rep.id").alias("rep"), F.col("rep.h").alias("rep_h"), "size", "pool", F.monotonically_increasing_id().alias("cid"))
    classes = scratch.keep(classes, "classes")  # numbered as it is written
    pools = classes.select("cid", "n", "pool")

    # Levels of the tree: children with one class go, small ones are kept for brute force, large ones are split.
    rows = scratch.keep(pools.mapInArrow(_expand(branch, runs_for(recall, threshold, branch)), "cid long, path long"), "level0")
    small, links, rest, level = [], [], None, 0
    while True:
        first = F.min(F.struct(F.xxhash64("cid", F.lit(9)).alias("h"), "cid"))["cid"].alias("first")
        sized = rows.groupBy("path").agg(F.count("*").alias("size"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("mark"), first)
        few = sized.where(F.col("size").between(2, SMALL)).groupBy("size", "mark").agg(F.min("path").alias("path"))  # equal children count once
        small.append(scratch.keep(rows.select("path", "cid").join(few.select("path"), "path"), f"small{level}"))
        big = scratch.keep(sized.where(F.col("size") > SMALL).select("path", "size", "first"), f"big{level}")
        if big.isEmpty():
            break
        if level == DEPTH:
            rest = scratch.keep(rows.join(big, "path").select("path", "cid", "size"), "rest")
            break
        members = scratch.keep(rows.join(big, "path"), f"members{level}")
        # Children of near copies mostly have the same first leader: a class is held against it once, not in each of them.
        sketch = [] if level == 0 else [F.first("n").alias("n"), F.first("pool").alias("pool")]  # deeper rows carry their samples along
        once = members.groupBy("first", "cid").agg(F.max("size").alias("size"), *sketch)
        once = once.join(pools, "cid") if level == 0 else once
        shares = F.ceil(F.col("size") / SHARE).cast("int")
        firsts = big.groupBy("first").agg(F.max("size").alias("size")).join(pools.select(F.col("cid").alias("first"), F.col("n").alias("ln"), F.col("pool").alias("lpool")), "first")
        copies = firsts.select("first", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "ln", "lpool")
        once = once.join(big.groupBy("first").agg(F.max("size").alias("most")), "first").withColumn("share", F.pmod(F.xxhash64("cid", F.lit(7)), F.ceil(F.col("most") / SHARE).cast("int")).cast("int")).drop("size", "most")
        near = once.repartition(parts, "first", "share").join(copies.repartition(parts, "first", "share").hint("merge"), ["first", "share"])
        near = scratch.keep(near.select("cid", "n", "pool", "first", "ln", "lpool").mapInArrow(_near_first, "cid long, first long"), f"near{level}")
        links.append(near.where("cid <> first").select(F.col("cid").alias("src"), F.col("first").alias("dst")))
        members = members.join(near, ["cid", "first"], "left_anti").drop("first")
        members = scratch.keep(members.join(pools, "cid") if level == 0 else members, f"others{level}")
        lead = members.groupBy("path", "size", F.pmod(F.xxhash64("cid", F.lit(level)), F.lit(LEADERS)).alias("part")).agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "cid", "n", "pool")).alias("l")).drop("part")
        of_first = big.select("path", "size", "first").join(firsts.drop("size"), "first").select("path", "size", F.struct(F.xxhash64("first").alias("h"), F.col("first").alias("cid"), F.col("ln").alias("n"), F.col("lpool").alias("pool")).alias("l"))
        lead = lead.unionByName(of_first).groupBy("path", "size").agg(F.collect_list("l").alias("leaders"))
        # a child is dealt out in shares of its rows, each with a copy of the leaders
        lead = lead.select("path", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "leaders")
        members = members.withColumn("share", F.pmod(F.xxhash64("cid", F.lit(7)), shares).cast("int")).drop("size")
        told = members.repartition(parts, "path", "share").join(lead.repartition(parts, "path", "share").hint("merge"), ["path", "share"]).mapInArrow(_split(level), "cid long, leader long, n long, pool binary, children array<long>")
        told = scratch.keep(told, f"told{level}")
        scratch.drop(f"members{level}", f"others{level}", f"big{level}", f"level{level}")
        links.append(told.where("leader is not null").select(F.col("cid").alias("src"), F.col("leader").alias("dst")))
        rows = told.select("cid", F.explode("children").alias("path"), "n", "pool")
        level += 1
    held = small[0]
    for more in small[1:]:
        held = held.unionByName(more)
    held = held.withColumns({c: F.lit(0) for c in ("bi", "bj")})
    if rest is not None:
        held = held.unionByName(_paired(rest, "size", SMALL).select(*held.columns))
    held = held.join(pools, "cid")
    links.append(held.repartition(parts, "path", "bi", "bj").sortWithinPartitions("path", "bi", "bj").mapInArrow(_compare_pools(threshold), "src long, dst long"))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    candidates = scratch.keep(connected_components(edges), "candidates")

    # Exact comparison inside each candidate component.
    chosen = candidates.select(F.col("node").alias("cid"), F.col("component").alias("comp")).join(classes.select("cid", *key, "rep", "rep_h", "size"), "cid")
    chosen = scratch.keep(chosen, "unsized")
    wide = F.greatest(F.count("*"), F.ceil(F.sum("n") * (BLOCK / BLOCK_TOKENS)))  # long texts count as many members
    sizes = chosen.groupBy("comp").agg(F.count("*").alias("n_members"), wide.alias("members")).where("n_members > 1").drop("n_members")
    chosen = scratch.keep(chosen.join(sizes, "comp"), "chosen")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for batch in batches:
            cid = np.asarray(batch["cid"])
            fresh = np.diff(cid, prepend=last) != 0  # rows equal in id and text come side by side
            last = cid[-1] if len(cid) else last
            batch = batch.filter(pa.array(fresh))
            for part in pieces(batch, "text"):
                doc, h = shingle_sets(split_words(part["text"]), width)
                n, k1, k2 = _keys(doc, h, part.num_rows)
                cut = np.concatenate(([0], np.cumsum(n)))
                same = np.logical_and.reduce([x == np.asarray(part[c]) for x, c in zip((k1, k2, n), key)])  # a repeated id may have another text
                sets = pa.array([h[a:b].astype("<u8").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                names = ["cid", "comp", "members", "n", "size"]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), sets], names=[*names, "tokens"]).filter(pa.array(same))

    with_text = texts.join(chosen.hint("merge"), texts["id"].eqNullSafe(chosen["rep"]) & (texts["h"] == chosen["rep_h"])).select("text", "cid", "comp", "members", *key, "size")
    sets = with_text.mapInArrow(tokens, "cid long, comp long, members long, n long, size long, tokens binary")
    sets = _paired(scratch.keep(sets, "sets"), "members", BLOCK)
    checked = sets.repartition(parts, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj").mapInArrow(_verify(threshold), "cid long, root long, links long")
    checked = scratch.keep(checked, "checked")
    groups = connected_components(checked.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    first = F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), F.col("rep_h").alias("h"))
    groups = groups.join(classes.select(F.col("cid").alias("node"), first.alias("rep")), "node")
    names = groups.groupBy("component").agg(F.min("rep").alias("head"))
    counts = checked.groupBy(F.col("cid").alias("node")).agg(F.sum("links").alias("links"))
    linked = groups.join(names, "component").join(counts, "node", "left").select(F.col("node").alias("cid"), "head", "links")
    known = classes.select("cid", *key, first.alias("rep"), "size").join(linked, "cid", "left").withColumn("head", F.coalesce("head", "rep"))
    known = known.select(*key, F.col("head.id").alias("class_id"), F.col("head.h").alias("class_h"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = scratch.keep(known, "known")
    scratch.drop("classes", "candidates", "unsized", "chosen", "sets", "checked", "rest", *[f"{kind}{k}" for k in range(level + 1) for kind in ("level", "small", "big", "near", "told")])
    ids = sketches.select("id", "h", *key)
    kept = (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))).alias("kept")
    found = ids.where("n > 0").join(known, key).select(F.col("id").alias(id_col), "class_id", "n_links", F.col("h").alias("text_hash"), kept)
    alone = ids.where("n = 0").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("h").alias("text_hash"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, five words, similarity of 0.8 or more."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "kept")
