"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

Entries become integers, so counts, sums and products are exact: A = n * sum(x x') - S S' is n * n times the
covariance, whatever the order in which tasks add up. Its characteristic polynomial is computed modulo many primes,
each by reduction to Hessenberg form, and put together by Chinese remaindering. All roots are real, so the sign
changes of the polynomial shifted to a point count the roots above it, which isolates the largest roots exactly,
also close or repeated ones; they are refined to a fixed number of binary places. A component is the null space of
A minus its root: elimination with complete pivoting in the same fixed-point arithmetic, and one step of inverse
iteration by back substitution.

Spark gathers the sums, runs the primes and the roots side by side, and projects the vectors. What reaches the driver has
the size of the matrix, not of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.runtime import with_fields

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this many are refused like non-finite ones: they are no longs of whole precision.
_LARGEST = 2.0**53 / SCALE
#: Binary places behind the point in roots and eliminations.
PLACES = 256
#: Primes lie below this, so that products fit into 64 bits.
_PRIMES_BELOW = 2**31
_EXACT = Context(prec=60)


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty, and each entry is a finite number within the range of exact doubles."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= _LARGEST)
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(F.transform(vector, lambda c: c.cast("double")), sound), F.lit(False))


def _integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(SCALE * c) of each entry, a row a vector."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, d)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y' y without rounding: in doubles as long as all sums stay below 2**53, else in Python's integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T.dot(z)


def scatter(rows: DataFrame, column: str, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of x, and A = n * sum(x x') - S S' over all rows, exact.

    A task gives one row for each pair of dimensions; A does not depend on the shift of x, so smaller numbers are multiplied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            y = _integers(batch[column], d)
            n, sums, products = n + len(y), sums + y.sum(axis=0, dtype=object), products + _exact_products(y)
        i, j = np.triu_indices(d)
        values = [n, *sums.tolist(), *products[i, j].tolist()]
        if n:
            at = np.concatenate(([[-1, -1]], np.stack([np.full(d, -1), np.arange(d)], axis=1), np.stack([i, j], axis=1)))
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["i", "j", "v"])

    found = rows.select(column).mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").cast("string").alias("v")).collect()
    n, sums, products = 0, [0] * d, np.zeros((d, d), dtype=object)
    for r in found:
        if r["j"] < 0:
            n = int(r["v"])
        elif r["i"] < 0:
            sums[r["j"]] = int(r["v"])
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["v"])
    s = np.array(sums, dtype=object)
    return n, [v + SHIFT * n for v in sums], n * products - np.outer(s, s)


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients, the highest first, of det(x I - a) modulo the prime p, by reduction to Hessenberg form."""
    h, d = (a % p).astype(np.int64), len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + int(below[0])
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = [np.array([1], dtype=np.int64)]  # of the leading blocks, the lowest coefficient first
    for m in range(d):
        new = np.zeros(m + 2, dtype=np.int64)
        new[1:] = polys[m]
        new[:-1] = (new[:-1] - int(h[m, m]) * polys[m]) % p
        t = 1
        for i in range(m - 1, -1, -1):
            t = t * int(h[i + 1, i]) % p
            if not t:
                break
            new[: i + 1] = (new[: i + 1] - t * int(h[i, m]) % p * polys[i]) % p
        polys.append(new)
    return [int(c) for c in polys[d][::-1]]


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all n below 2**32."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all((x := pow(b, odd, n)) in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1)) for b in (2, 3, 5, 7))


def primes_for(bound: int) -> list[int]:
    """Primes whose product is above twice the bound."""
    out, product, p = [], 1, _PRIMES_BELOW - 1
    while product <= 2 * bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def coefficient_bound(a: np.ndarray) -> int:
    """No coefficient is above this: a's roots are not negative and add up to its trace t, so the k-th is at most C(d, k) (t / d)**k, or t**k."""
    trace, d = max(1, int(np.trace(a))), len(a)
    return max(math.comb(d, k) * -(-(trace**k) // d**k) for k in range(d + 1))


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Integer coefficients of det(x I - a), the highest first; the primes are dealt to tasks."""
    primes, shared = primes_for(coefficient_bound(a)), spark.sparkContext.broadcast(a)
    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            residues = [polynomial_modulo(shared.value, p) for p in batch["p"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["p"], pa.array(residues, pa.list_(pa.int64()))], names=["p", "residues"])

    found = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, residues array<long>").collect()
    out, product = [0] * (len(a) + 1), 1
    for r in found:  # Garner's form: one more prime at a time
        p = r["p"]
        inverse = pow(product, -1, p)
        out = [c + product * ((x - c) * inverse % p) for c, x in zip(out, r["residues"])]
        product *= p
    return [c - product if c > product // 2 else c for c in out]


def roots_above(poly: list[int], at: int, places: int) -> int:
    """How many roots lie above at / 2**places: sign changes of the polynomial shifted there, exact as all roots are real."""
    c = [v << (places * k) for k, v in enumerate(poly)]  # of roots times 2**places
    d = len(c) - 1
    for k in range(d):
        for i in range(1, d + 1 - k):
            c[i] += at * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, places: int = PLACES) -> list[tuple[int, int]]:
    """The largest ``count`` roots, or more where the last is repeated, as (root * 2**places, how often it occurs), falling.

    An interval holds a root to the last place. Roots that no interval of that width separates count as one repeated root.
    """
    d = len(poly) - 1
    count = min(count, d)
    zeros = next(k for k, v in enumerate(reversed(poly)) if v)  # roots that are exactly 0
    low, high = -1, (abs(poly[1]) if d else 0) + 1  # integers: the roots add up to -poly[1] and are not negative
    found: list[tuple[int, int]] = []
    todo = [(low, high, 0, d, 0)]  # (low, high] at a number of places, roots above high, roots in it
    while todo and sum(m for _, m in found) < count:
        low, high, above, m, at = todo.pop()
        if not m:
            continue
        if m == zeros and above + m == d and low < 0:
            found.append((0, m))
            continue
        if m == 1 or (at == places and high - low == 1):
            found.append((_refined(poly, low, high, at, places) if at < places or high - low > 1 else high, m))
            continue
        if high - low == 1:
            low, high, at = 2 * low, 2 * high, at + 1
        middle = (low + high) // 2
        upper = roots_above(poly, middle, at) - above
        todo += [(low, middle, above + upper, m - upper, at), (middle, high, above, upper, at)]  # the upper half is taken first
    return found


def _refined(poly: list[int], low: int, high: int, at: int, places: int) -> int:
    """The one root in (low, high] to ``places``, by halving at the polynomial's sign."""
    low, high = low << (places - at), high << (places - at)
    top = _sign(poly, high, places)
    if not top:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        s = _sign(poly, middle, places)
        if not s:
            return middle
        low, high = (low, middle) if s == top else (middle, high)
    return high


def _sign(poly: list[int], x: int, places: int) -> int:
    """Sign of the polynomial at x / 2**places."""
    v = 0
    for k, c in enumerate(poly):
        v = v * x + (c << (places * k))
    return (v > 0) - (v < 0)


def null_space(a: np.ndarray, root: int, m: int, places: int = PLACES) -> np.ndarray:
    """m orthonormal vectors (rows) that a maps to the root times themselves, in doubles.

    Elimination of a - root with complete pivoting leaves its m smallest pivots last; each of them gives a vector by
    back substitution, the step of inverse iteration for a matrix that is singular but for the root's rounding. The
    largest entry of a vector is positive.
    """
    d, one = len(a), 1 << places
    t = a * one
    t[np.diag_indices(d)] -= root
    order = np.arange(d)
    for k in range(d - m):
        at = int(np.argmax(np.abs(t[k:, k:])))
        r, c = k + at // (d - k), k + at % (d - k)
        t[[k, r]] = t[[r, k]]
        t[:, [k, c]] = t[:, [c, k]]
        order[[k, c]] = order[[c, k]]
        if not t[k, k]:
            break
        t[k + 1 :, k + 1 :] -= np.outer(t[k + 1 :, k], t[k, k + 1 :]) // t[k, k]
    basis: list[list[int]] = []
    for free in range(d - m, d):
        v = [0] * d
        v[free] = one
        for k in range(d - m - 1, -1, -1):
            if t[k, k]:
                v[k] = -sum(int(t[k, j]) * v[j] for j in range(k + 1, d) if v[j]) // int(t[k, k])
        for u in basis:  # orthogonal to the vectors before it
            inside = sum(x * y for x, y in zip(u, v)) >> places
            v = [y - (inside * x >> places) for x, y in zip(u, v)]
        length = math.isqrt(sum(x * x for x in v))
        basis.append([(x << places) // length for x in v])
    out = np.zeros((m, d))
    out[:, order] = [[math.ldexp(float(x >> max(0, places - 128)), -min(places, 128)) for x in v] for v in basis]
    return out * np.sign(out[np.arange(m), np.abs(out).argmax(axis=1)])[:, None]


def components(spark: SparkSession, a: np.ndarray, count: int) -> list[tuple[int, np.ndarray]]:
    """(root * 2**PLACES, unit vector) of the ``count`` largest roots of a, falling; a task solves for each root."""
    roots = largest_roots(characteristic_polynomial(spark, a), count)
    shared = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [null_space(shared.value, int(root), m).ravel().tolist() for root, m in zip(batch["root"].to_pylist(), batch["m"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["place"], pa.array(vectors, pa.list_(pa.float64()))], names=["place", "vectors"])

    rows = [(k, str(root), m) for k, (root, m) in enumerate(roots)]
    found = spark.createDataFrame(rows, "place int, root string, m int").repartition(len(rows), "place").mapInArrow(run, "place int, vectors array<double>").collect()
    solved = {r["place"]: np.array(r["vectors"]).reshape(-1, len(a)) for r in found}
    return [(root, v) for k, (root, _) in enumerate(roots) for v in solved[k]][:count]


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """n * x - S as doubles, and the exact sum of its squares."""
    if n * int(np.abs(x).max(initial=1)) < 2**62:
        centred = n * x - np.array(sums, dtype=np.int64)
        if int(np.abs(centred).max(initial=0)) ** 2 * x.shape[1] < 2**63:
            return centred.astype(np.float64), (centred * centred).sum(axis=1).tolist()
        centred = centred.astype(object)
    else:
        centred = n * x.astype(object) - np.array(sums, dtype=object)
    return centred.astype(np.float64), (centred * centred).sum(axis=1).tolist()


def whiten(rows: DataFrame, column: str = "embedding", count: int = 8) -> DataFrame:
    """Adds ``n`` (vectors), ``deviation`` (decimal: sum of (n x - S)**2), ``whitened`` (array: a number a component), ``explained`` (array) and ``identity_error``.

    Vectors that are null or empty or hold null, non-finite or huge (above 2**53 / 1024) entries are dropped; so are those that
    have not the commonest length (the longer one of two equally common ones). The first ``count`` components are returned,
    all if there are fewer dimensions. Where the covariance has rank below that, the rest have ``explained`` 0 and
    ``whitened`` null, and are left out of the error; if no vector differs from another, all of the three are null.
    Equal roots share a space, of which any orthonormal basis is taken. Rows are judged one by one, so repeated rows and null
    ids change nothing beyond their weight. An empty table gives an empty one. Columns of the input with the new names are replaced.
    """
    spark = rows.sparkSession
    new = ["n", "deviation", "whitened", "explained", "identity_error"]
    rows = rows.drop(*[c for c in new if c in rows.columns]).where(usable(F.col(f"`{column}`")))
    schema = with_fields(rows.schema, "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    sizes = rows.groupBy(F.size(f"`{column}`").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).head(1)
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0]["d"]
    rows = rows.where(F.size(f"`{column}`") == d)
    n, sums, a = scatter(rows, column, d)
    trace = int(np.trace(a))
    found = components(spark, a, count) if trace else []
    explained = [float(Decimal(root) / Decimal(trace << PLACES)) for root, _ in found] if trace else [None] * min(count, d)
    positive = [k for k, (root, _) in enumerate(found) if root > 0]
    root_of = lambda r: float(_EXACT.sqrt(_EXACT.divide(Decimal(r), Decimal(1 << PLACES))))
    axes = np.array([found[k][1] / root_of(found[k][0]) for k in positive]).reshape(-1, d)  # of n x - S
    model = spark.sparkContext.broadcast((n, sums, axes))

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, list[int]]:
        size, total, along = model.value
        centred, deviation = _deviation(_integers(batch[column], d) + SHIFT, size, total)
        return centred @ along.T, deviation

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, mean, products = 0, np.zeros(len(axes)), np.zeros((len(axes), len(axes)))
        for batch in batches:
            if w := batch.num_rows:
                x, _ = projected(batch)
                own = x.mean(axis=0)
                step = own - mean
                products += (x - own).T @ (x - own) + np.outer(step, step) * (k * w / (k + w))
                mean += step * (w / (k + w))
                k += w
        if k:
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], names=["k", "mean", "products"])

    error = None
    if positive:
        parts = rows.select(column).mapInArrow(moments, "k long, mean array<double>, products array<double>")
        error = float(np.abs(_covariance(parts, len(axes)) - np.eye(len(axes))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, deviation = projected(batch)
            w = np.full((len(x), len(explained)), np.nan)
            w[:, positive] = x
            flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # NaN stands for null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(explained), pa.int32()), flat)
            same = lambda v, kind: pa.array([v] * len(x), kind)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, same(n, pa.int64()), pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)), lists, same(explained, pa.list_(pa.float64())), same(error, pa.float64())],
                names=[*batch.schema.names, *new],
            )

    return rows.mapInArrow(run, schema)


def _covariance(parts: DataFrame, d: int) -> np.ndarray:
    """Covariance of all rows from the (k, mean, products) of each task: means first, then the spread between tasks; summed by Spark."""
    k = F.sum("k").alias("k")
    total = parts.agg(k, *[F.sum(F.col("k") * F.col("mean")[i]).alias(f"m{i}") for i in range(d)]).head()
    mean = [total[f"m{i}"] / total["k"] for i in range(d)]
    centred = lambda i, j: F.col("products")[i * d + j] + F.col("k") * (F.col("mean")[i] - mean[i]) * (F.col("mean")[j] - mean[j])
    sums = parts.agg(*[F.sum(centred(i, j)).alias(f"c{i}_{j}") for i in range(d) for j in range(d)]).head()
    return np.array(sums, dtype=np.float64).reshape(d, d) / total["k"]


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Every usable vector's first 8 whitened components, a row each."""
    done = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = done.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")
