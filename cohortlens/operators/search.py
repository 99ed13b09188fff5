"""Sequence operators: k-mer tiles, near matches, left alignment, allele names, positional lists."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def kmer_tile(rows: DataFrame, key: str, seq: str, lengths: Sequence[int]) -> DataFrame:
    """(key, k, kmer, first): every k-mer of each length with its first offset from 0."""
    k = F.col("k")
    t = rows.select(key, F.col(seq).alias("__s"), F.explode(F.array(*map(F.lit, lengths))).alias("k")).where(F.length("__s") >= k)
    t = t.select(key, "__s", "k", F.explode(F.sequence(F.lit(0), F.length("__s") - k)).alias("at"))
    return t.select(key, "k", F.substr("__s", F.col("at") + 1, k).alias("kmer"), "at").groupBy(key, "k", "kmer").agg(F.min("at").alias("first"))


#: Letters of sequences that are worked on together; longer ones in pieces of about so many.
PIECE = 1 << 20


def _kmer_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for the k-mer at each place, equal where k-mers are."""
    seen = np.zeros(int(codes.max()) + 1, dtype=np.int64)
    seen[codes] = 1
    letters, n = int(seen.sum()), len(codes) - k + 1
    at = (np.cumsum(seen) - 1)[codes]
    out = at[:n]
    for i in range(1, k):
        if letters ** (i + 1) >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
        out = out * letters + at[i : n + i]
    return out


def _window_entropies(codes: np.ndarray, k: int, window: int) -> np.ndarray:
    """Entropy of the k-mers of each window over its maximum: log2 of their number less the mean log2 of how often each
    place's k-mer occurs. Most windows repeat none; only the others are counted."""
    per = window - k + 1
    kmers, n, most = _kmer_codes(codes, k), len(codes) - window + 1, log2(min(4**k, per))
    repeats = np.zeros(n + 1, dtype=np.int64)  # by window: how many equal pairs begin being inside, less those that end
    for d in range(1, per):
        at = np.flatnonzero(kmers[d:] == kmers[:-d])
        repeats += np.bincount(np.maximum(at + d - per + 1, 0), minlength=n + 1)[: n + 1]
        repeats -= np.bincount(np.minimum(at + 1, n), minlength=n + 1)
    out = np.full(n, log2(per) / most)
    some = np.flatnonzero(np.cumsum(repeats[:n]) > 0)
    for low in range(0, len(some), PIECE // per):
        which = some[low : low + PIECE // per]
        inside = kmers[which[:, None] + np.arange(per)]
        often = np.stack([(inside == inside[:, i : i + 1]).sum(axis=1) for i in range(per)], axis=1)
        out[which] = (log2(per) - np.log2(often).sum(axis=1) / per) / most
    return out


def sequence_entropy(rows: DataFrame, key: str, seq: str, k: int = 5, window: int = 20) -> DataFrame:
    """(key, entropy): mean over all windows of a sequence of their k-mer entropy over its maximum, summed by pieces, so a
    sequence may have any length. Sequences shorter than a window are left out."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, n, total = [], [], []
            parts: list[tuple[int, np.ndarray]] = []

            def told() -> None:
                """Windows of all parts laid end to end, without those that reach into the next part."""
                codes = np.concatenate([c for _, c in parts])
                ends = np.cumsum([len(c) for _, c in parts])
                firsts, windows = ends - [len(c) for _, c in parts], np.array([len(c) - window + 1 for _, c in parts])
                sums = np.add.reduceat(np.append(_window_entropies(codes, k, window), 0.0), np.stack((firsts, firsts + windows), axis=1).ravel())[::2]
                which.extend(i for i, _ in parts)
                n.extend(windows.tolist())
                total.extend(sums.tolist())
                parts.clear()

            held = 0
            for i, text in enumerate(batch["__s"].to_pylist()):
                codes = _codes(text)
                for low in range(0, len(codes) - window + 1, PIECE):
                    parts.append((i, codes[low : low + PIECE + window - 1]))
                    held += len(parts[-1][1])
                    if held >= PIECE:
                        told()
                        held = 0
            if parts:
                told()
            keys = batch[key].take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=[key, "n", "total"])

    kind = dict(rows.dtypes)[key]
    t = rows.where(F.length(seq) >= window).select(key, F.col(seq).alias("__s")).mapInArrow(totals, f"`{key}` {kind}, n long, total double")
    return t.groupBy(key).agg((F.sum("total") / F.sum("n")).alias("entropy"))


def low_complexity_filter(reads: DataFrame, key: str, name: str, seq: str, least: float = 0.7, both: bool = True, k: int = 5, window: int = 20) -> DataFrame:
    """Reads with their ``entropy`` whose pair passes; mates share ``name`` and stay or go together.

    A pair goes if both mates fail, or with ``both`` false if any does. A read shorter than a window has a null
    entropy and passes.
    """
    scored = reads.join(sequence_entropy(reads, key, seq, k, window), key, "left")
    passed = F.coalesce(F.col("entropy") >= least, F.lit(True))
    pairs = scored.groupBy(name).agg((F.bool_or(passed) if both else F.bool_and(passed)).alias("__ok")).where("__ok").select(name)
    return scored.join(pairs, name, "left_semi")


#: Letters of the queries that one automaton is made of; more queries are searched in blocks of about so many.
QUERY_LETTERS = 4_000_000
#: Candidate places that are compared at once.
COMPARED = 1 << 16


class _Automaton:
    """Pieces of queries, each with its place in them."""

    def __init__(self, queries: Sequence[tuple[int, str, int]]):
        """Queries are (number, letters, pieces)."""
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for k, q, pieces in queries:
            cut = [len(q) * i // pieces for i in range(pieces + 1)]
            for low, high in zip(cut, cut[1:]):
                found.setdefault(q[low:high], []).append((k, high - 1))
        for piece, where in found.items():
            self.pieces.add_word(piece, np.array(where, dtype=np.int64))
        if found:
            self.pieces.make_automaton()

    def places(self, text: str) -> list[np.ndarray]:
        """(query, start) for each piece that occurs."""
        return [np.stack((where[:, 0], end - where[:, 1])) for end, where in self.pieces.iter(text)] if len(self.pieces) else []


class _Blocks:
    """Queries of one block: automata of their pieces, and their letters by length.

    A match has at most ``mismatches`` unequal letters, and at most size - ceil(size * fraction) that are not even similar. Where
    the second is less and no letter is in two groups, the query is searched in texts with one letter for each group, in as
    many pieces as that asks for: with a fraction of 1 in one piece, the whole query.
    """

    def __init__(self, queries: Sequence[str], mismatches: int, similar: Sequence[str], fraction: float):
        self.queries = list(queries)
        self.length = np.array([len(q) for q in self.queries], dtype=np.int64)
        self.fold = {ord(x): min(g) for g in similar for x in g}
        apart = len(self.fold) == sum(len(set(g)) for g in similar) and bool(similar)
        plain, folded = [], []
        for k, q in enumerate(self.queries):
            unlike = max(0, len(q) - ceil(len(q) * fraction))
            if apart and unlike < mismatches:
                folded.append((k, q.translate(self.fold), unlike + 1))
            else:
                plain.append((k, q, mismatches + 1))
        self.plain, self.folded = _Automaton(plain), _Automaton(folded)
        self.row = np.zeros(len(self.queries), dtype=np.int64)  # of a query among those of its length
        self.by_length = {}
        for n in np.unique(self.length):
            at = np.flatnonzero(self.length == n)
            self.row[at] = np.arange(len(at))
            self.by_length[int(n)] = np.stack([_codes(self.queries[k]) for k in at])
        self.groups = [np.unique(_codes(g)) for g in similar]

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(query, start) of all places where a piece of the query lies as in the query, without repeats."""
        parts = self.plain.places(text) + (self.folded.places(text.translate(self.fold)) if len(self.folded.pieces) else [])
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, start = np.concatenate(parts, axis=1)
        fits = (start >= 0) & (start + self.length[query] <= len(text))
        both = np.unique(query[fits] * (len(text) + 1) + start[fits])
        return both // (len(text) + 1), both % (len(text) + 1)

    def compare(self, text: str, codes: np.ndarray, which: np.ndarray, start: np.ndarray, mismatches: int, anchors: Sequence[int], fraction: float) -> Iterator[tuple]:
        """(query, start, identities, window, tier) of the places that match, by length."""
        for size in np.unique(self.length[which]).tolist():
            mine = np.flatnonzero(self.length[which] == size)
            want, have = self.by_length[size][self.row[which[mine]]], codes[start[mine][:, None] + np.arange(size)]
            same = want == have
            identities = same.sum(axis=1)
            ok = identities >= size - mismatches
            for a in anchors:
                spot = size if a == -1 else a
                if spot <= size:
                    ok &= same[:, spot - 1]
            if self.groups:
                close = same.copy()
                for g in self.groups:
                    close |= np.isin(want, g) & np.isin(have, g)
                ok &= close.sum(axis=1) >= ceil(size * fraction)
            for i in np.flatnonzero(ok).tolist():
                p = int(start[mine[i]])
                yield self.queries[which[mine[i]]], p, int(identities[i]), text[p : p + size], "exact" if identities[i] == size else "near"


#: One block in each Python worker, so that its tasks share the automaton: (name, block).
_BLOCK: list = [None, None]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def near_matches(queries: DataFrame, db: DataFrame, query: str, db_id: str, seq: str, mismatches: int = 2, anchors: Sequence[int] = (2, -1), similar: Sequence[str] = (), fraction: float = 1.0) -> DataFrame:
    """(query, db_id, at, found, identities, tier): full-length ungapped matches of the queries in the database.

    At most ``mismatches`` letters differ, anchor positions (from 1, -1 the last) do not, and at least ``fraction`` of
    all positions are equal or in one of the groups of ``similar`` letters (none: all count). A window with that few
    mismatches has one of the query's ``mismatches + 1`` pieces in its place, so an automaton of all pieces is run
    over each text once, and only the places it reports are compared. If fewer letters may be unlike than unequal, pieces are
    of letters by group, and fewer and longer. The automaton is made of a block of queries of
    bounded size; more queries are searched block by block. Null texts and queries shorter than the pieces match nothing; repeated
    queries count once, repeated rows of the database each on its own.
    """
    spark, n = db.sparkSession, mismatches + 1
    q = queries.select(F.col(query).alias("query")).distinct().where(F.length("query") >= n)
    letters = q.agg(F.sum(F.length("query")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-letters // QUERY_LETTERS))
    rows = db.select(F.col(db_id), F.col(seq).alias("__s")).where(F.col(seq).isNotNull())
    kind = dict(rows.dtypes)[db_id]
    schema = f"query string, `{db_id}` {kind}, at int, found string, identities int, tier string"

    def search(texts: Sequence[str]):
        shared, name = spark.sparkContext.broadcast(list(texts)), uuid.uuid4().hex  # about QUERY_LETTERS at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if _BLOCK[0] != name:
                _BLOCK[:] = name, _Blocks(shared.value, mismatches, similar, fraction)
            own = _BLOCK[1]
            for batch in batches:
                out: list[tuple] = []
                for k, text in enumerate(batch["__s"].to_pylist()):
                    which, start = own.places(text)
                    codes = _codes(text) if len(which) else None
                    for low in range(0, len(which), COMPARED):
                        out += [(k, *m) for m in own.compare(text, codes, which[low : low + COMPARED], start[low : low + COMPARED], mismatches, anchors, fraction)]
                        if len(out) > COMPARED:
                            yield told(batch, out)
                            out = []
                yield told(batch, out)

        def told(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
            k, which, place, same, found, tier = zip(*out) if out else ((),) * 6
            columns = [pa.array(which, pa.string()), batch[db_id].take(pa.array(k, pa.int64())), pa.array(place, pa.int32()), pa.array(found, pa.string()), pa.array(same, pa.int32()), pa.array(tier, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["query", db_id, "at", "found", "identities", "tier"])

        return rows.mapInArrow(run, schema)

    found = None
    for k in range(blocks):
        texts = [r["query"] for r in q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).collect()]
        found = search(texts) if found is None else found.unionByName(search(texts))
    return found


def hits_by_organism(hits: DataFrame, organism: str, own: str, priority: Sequence[str] = ()) -> DataFrame:
    """Hits and exact hits per organism with flags for the own and for priority organisms."""
    t = hits.groupBy(organism).agg(F.count("*").alias("hits"), F.count_if(F.col("tier") == "exact").alias("exact"))
    return t.withColumn("is_self", F.col(organism) == own).withColumn("is_priority", F.col(organism).isin(*priority) if priority else F.lit(False))


def top_binders(scores: DataFrame, limits: Mapping[str, float], peptide: str, cls: str, rank: str, order: str) -> DataFrame:
    """Peptides whose rank is at or below their class's limit, once each, the first by ``order``."""
    keep = F.lit(False)
    for name, most in limits.items():
        keep = keep | ((F.col(cls) == name) & (F.col(rank) <= most))
    rest = [c for c in scores.columns if c != peptide]
    t = scores.where(keep).groupBy(peptide).agg(F.min(F.struct(F.col(order).alias("__o"), *rest)).alias("r"))
    return t.select(peptide, *[F.col(f"r.{c}").alias(c) for c in rest])


def score_peptides(rows: DataFrame, peptide: str, allele: str, load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]) -> DataFrame:
    """Adds ``rank`` from a caller-supplied model; ``load`` is called once for each task."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for peptides, alleles in batches:
            yield model(peptides, alleles)

    return rows.withColumn("rank", score(peptide, allele))


def left_align(variants: DataFrame, reference: DataFrame, contig: str = "contig", pos: str = "pos", ref: str = "ref", alt: str = "alt", chunk: int = 1024, steps: int = 256) -> DataFrame:
    """Indels shifted left through repeats: while the last bases are equal, drop them and prepend the base before.

    ``reference`` has (contig, k, seq): chunk k from position k * chunk + 1. Each pass shifts by up to ``steps`` bases
    inside the two chunks that it joins; variants that used all steps go through another pass.
    """
    while True:
        k = F.floor((F.col(pos) - 2) / chunk)
        here = reference.select(F.col(contig), F.col("k").alias("__k"), F.col("seq").alias("__here"))
        before = reference.select(F.col(contig), (F.col("k") + 1).alias("__k"), F.col("seq").alias("__before"))
        t = variants.withColumn("__k", F.when(F.col(pos) >= 2, k).otherwise(-1)).join(here, [contig, "__k"], "left").join(before, [contig, "__k"], "left")
        text = F.concat(F.coalesce("__before", F.lit("")), F.coalesce("__here", F.lit("")))
        first = F.when(F.col("__before").isNull(), F.col("__k")).otherwise(F.col("__k") - 1) * chunk + 1  # position of text's first base
        state = F.struct(F.col(pos).cast("long").alias("p"), F.col(ref).alias("r"), F.col(alt).alias("a"), F.lit(0).alias("n"))

        def shift(s: Column, _: Column) -> Column:
            prior = F.substr(text, (s["p"] - first).cast("int"), F.lit(1))
            ends = (F.right(s["r"], F.lit(1)) == F.right(s["a"], F.lit(1))) & (F.length(s["r"]) != F.length(s["a"]))
            can = ends & (s["p"] > first) & (s["p"] > 1) & (F.length(prior) == 1)
            cut = lambda x: F.concat(prior, F.substr(x, F.lit(1), F.length(x) - 1))
            moved = F.struct((s["p"] - 1).alias("p"), cut(s["r"]).alias("r"), cut(s["a"]).alias("a"), (s["n"] + 1).alias("n"))
            return F.when(can, moved).otherwise(s)

        t = t.withColumn("__s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, shift))
        again = t.where(F.col("__s.n") == steps)
        done = t.withColumn(pos, F.col("__s.p")).withColumn(ref, F.col("__s.r")).withColumn(alt, F.col("__s.a")).select(*variants.columns)
        if again.isEmpty():
            return done
        variants = done


def allele_names(pairs: DataFrame, sample: str, gene: str, allele: str) -> DataFrame:
    """(sample, name): DR beta chains alone; DQ and DP as every alpha x beta of the sample; class I as ``HLA-``name without ``*``."""
    short = F.regexp_replace(F.regexp_replace(F.col(allele), r"[*]", ""), ":", "")
    rows = pairs.select(sample, F.col(gene).alias("g"), short.alias("n"), F.col(allele).alias("full")).distinct()
    one = rows.where(F.col("g").isin("A", "B", "C")).select(sample, F.concat(F.lit("HLA-"), F.regexp_replace("full", r"[*]", "")).alias("name"))
    dr = rows.where(F.col("g").startswith("DRB")).select(sample, F.regexp_replace("full", r"[*]", "_").alias("name")).withColumn("name", F.regexp_replace("name", ":", ""))
    chain = rows.where(F.col("g").rlike("^D[QP][AB]1$")).withColumn("locus", F.substring("g", 1, 2))
    a, b = (chain.where(F.substring("g", 3, 1) == x).select(sample, "locus", F.col("n").alias(f"n{x}")) for x in "AB")
    both = a.join(b, [sample, "locus"]).select(sample, F.concat(F.lit("HLA-"), "nA", F.lit("-"), "nB").alias("name"))
    return one.unionByName(dr).unionByName(both).distinct()


def explode_positional(rows: DataFrame, keys: Sequence[str], values: str, ids: Sequence[str], name: str = "donor", value: str = "value") -> DataFrame:
    """One row per named position of a comma list; raises if a list's length differs from the names'."""
    parts = F.split(F.col(values), r",\s*")
    if n := rows.where(F.size(parts) != len(ids)).limit(1).count():
        raise ValueError(f"lists without {len(ids)} values: at least {n}")
    t = rows.select(*keys, F.posexplode(parts).alias("__at", "__v"))
    return t.select(*keys, F.element_at(F.array(*map(F.lit, ids)), F.col("__at") + 1).alias(name), F.col("__v").try_cast("double").alias(value))
