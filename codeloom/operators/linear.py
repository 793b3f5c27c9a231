"""Linear one-versus-rest classifiers of all classes at once over TF-IDF terms.

Terms are hashed to `features` buckets; a row's vector is its bucket counts times the inverse document frequencies, of
length 1. The weights of all classes minimise the mean logistic loss plus l2 / 2 times their squares, by limited-memory
BFGS: one pass over the rows gives the loss and the gradient of every class, as sums of the tasks that are added up by
blocks of classes. So a fit of 245 classes takes as many jobs as one of two.

Classes are problems of their own: each has its own steps, and leaves the passes when it is done. A class begins at
weights of 0 and the bias of its share, where loss, gradient and Hessian need no scores; that Hessian, of the rows'
covariances (or variances, where covariances would cost more than a quarter of the passes), is what BFGS corrects.

Rows are counted by bucket once and dealt in blocks over as many tasks as the session runs together, so what a pass
shuffles (a gradient a task) doesn't grow with the rows. What labels give to loss and gradient is linear in the weights
and summed once. Passes multiply single floats unless the tolerance is below SINGLE; sums are of doubles.

The driver holds classes times features numbers (MOST at most), a few such vectors of the past, and the covariances
(FULL squared at most); rows stay where they are. Rows without terms or with a null label are negative examples of all classes; labels that aren't asked for too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.ordering import settled

#: Classes times features, the rows of a block, and the numbers of its matrices.
MOST, ROWS, CELLS = 1 << 25, 1024, 1 << 21
#: Classes whose sums travel together, and the steps that BFGS remembers.
BLOCK, MEMORY = 32, 8
#: Features that covariances are taken of, and the least tolerance that single floats are good for.
FULL, SINGLE = 1 << 12, 1e-7
#: A class isn't done before its gradient has come down to this share of the first, however rare it is.
SHARE = 1e-3


@dataclass
class Model:
    """weights: classes x features; bias: classes; idf: features."""

    codes: list
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray


def _buckets(text: Column, features: int) -> Column:
    from codeloom.operators.retrieval import terms

    return F.transform(F.coalesce(terms(text), F.array().cast("array<string>")), lambda x: F.pmod(F.xxhash64(x), F.lit(features)).cast("int"))


def _counted(lists: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the distinct buckets of each row, in order."""
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    key = row * features + lists.flatten().to_numpy()
    if len(lists) * features <= 4 * len(key):
        held = np.bincount(key)
        key = np.flatnonzero(held)
        return *divmod(key, features), held[key]
    key, count = np.unique(key, return_counts=True)
    return *divmod(key, features), count


_NAMES = ["n", "sizes", "buckets", "counts", "marks", "ys"]


def _zipped(v: np.ndarray) -> pa.Array:
    return pa.array([pa.compress(np.ascontiguousarray(v, np.int32).tobytes(), "zstd", asbytes=True)], pa.binary())


def _unzipped(v: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(v.as_py(), 4 * n, "zstd", asbytes=True), np.int32)


def _packed(rows: DataFrame, features: int) -> DataFrame:
    """Rows (terms, ys) as blocks of up to ROWS: the sizes of their lists of distinct buckets, the buckets and counts, and the same of ys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                n = part.num_rows
                row, bucket, count = _counted(part.column(0), features)
                ys = part.column(1)
                own = [np.bincount(row, minlength=n), bucket, count, np.diff(ys.offsets.to_numpy()), ys.flatten().to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *map(_zipped, own)], _NAMES)

    return rows.mapInArrow(run, "n int, sizes binary, buckets binary, counts binary, marks binary, ys binary")


class _Block:
    """Vectors of length 1 (0 for rows without terms) of some rows: as they are for few classes, else a matrix of the buckets that occur."""

    def __init__(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray, classes: int | None = None, kind: type = float):
        value = count * idf[bucket]
        value /= np.maximum(np.sqrt(np.bincount(row, value * value, minlength=n)), 1e-300)[row]
        self.row, self.bucket, self.value, self.n = row, bucket, value, n
        self.sparse = classes is not None and 4 * classes * len(bucket) < n * len(idf)
        if not self.sparse:
            held = np.bincount(bucket, minlength=len(idf)) > 0
            self.used = np.flatnonzero(held)
            self.matrix = np.zeros((n, len(self.used)), kind)
            self.matrix[row, (np.cumsum(held) - 1)[bucket]] = value

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """rows x classes."""
        if self.sparse:
            return np.stack([np.bincount(self.row, self.value * w[self.bucket], minlength=self.n) for w in weights], axis=1)
        return self.matrix @ (weights if len(self.used) == weights.shape[1] else weights[:, self.used]).T

    def add(self, shares: np.ndarray, to: np.ndarray) -> None:
        """Adds to each class (row of `to`) the rows' vectors times their shares in it."""
        if self.sparse:
            for k, own in enumerate(to):
                own += np.bincount(self.bucket, self.value * shares[self.row, k], minlength=len(own))
        elif len(self.used) == to.shape[1]:
            to += shares.T @ self.matrix
        else:
            to[:, self.used] += shares.T @ self.matrix


def _dense(lists: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, rows x those buckets): TF-IDF vectors of length 1 (0 for rows without terms)."""
    b = _Block(*_counted(lists, len(idf)), len(lists), idf)
    return b.used, b.matrix


def _height(classes: int, features: int) -> int:
    return max(64, min(ROWS, CELLS // max(classes, features)))


def _parts(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row, bucket, count, row of each y, y) of packed rows, so many at a time."""
    for batch in batches:
        for n, *zipped in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in range(1, 6)], strict=True):
            sizes, marks = _unzipped(zipped[0], n), _unzipped(zipped[3], n)
            ends, to = (np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for v in (sizes, marks))
            bucket, count, y = _unzipped(zipped[1], int(ends[-1])), _unzipped(zipped[2], int(ends[-1])), _unzipped(zipped[4], int(to[-1]))
            for i in range(0, n, height):
                j = min(n, i + height)
                row, of = (np.repeat(np.arange(j - i), v[i:j]) for v in (sizes, marks))
                yield j - i, row, bucket[ends[i] : ends[j]], count[ends[i] : ends[j]], of, y[to[i] : to[j]]


def _added(rows: DataFrame, sums) -> dict[int, np.ndarray]:
    """Sums by number, over all tasks; `sums` gives (number, vector) for the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, own in sums(batches):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["block", "sums"])

    def add(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for g in groups:
            for raw in g.column(1).to_pylist():
                total = total + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    each = rows.mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary")
    return {r["block"]: np.frombuffer(r["sums"]) for r in each.collect()}  # classes times features numbers


def inverse_frequencies(rows: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """log((1 + rows) / (1 + rows with the bucket)) + 1 of each bucket, and the number of packed rows."""

    def sums(batches):
        held = np.zeros(features + 1)
        for n, _, bucket, _, _, _ in _parts(batches, ROWS):
            held[:-1] += np.bincount(bucket, minlength=features)
            held[-1] += n
        yield 0, held

    held = _added(rows, sums).get(0, np.zeros(features + 1))
    return np.log((1 + held[-1]) / (1 + held[:-1])) + 1, int(held[-1])


def _blocks(each: np.ndarray, rows: np.ndarray):
    """Vectors of a number a class, and of a row a class, by blocks of classes."""
    for b in range(0, len(each), BLOCK):
        yield b, np.concatenate([each[b : b + BLOCK].ravel(), rows[b : b + BLOCK].ravel()])


def _unblocked(found: dict[int, np.ndarray], k: int, size: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """The two arrays of _blocks again, the first with `each` numbers a class."""
    first, second = np.zeros((k, each)), np.zeros((k, size))
    for b in range(0, k, BLOCK):
        c = min(BLOCK, k - b)
        own = found.pop(b)
        first[b : b + c], second[b : b + c] = own[: c * each].reshape(c, each), own[c * each :].reshape(c, size)
    return first, second


def _labelled(rows: DataFrame, idf: np.ndarray, k: int, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of each class, sum of their vectors, sum of all vectors, sum of the squares of all: of their outer products if `full`)."""
    size = len(idf)

    def sums(batches):
        number, own, every = np.zeros(k), np.zeros(k * size), np.zeros(size)
        squares = np.zeros((size, size) if full else (1, size), np.float32 if full else float)  # of a start only: single floats will do
        for n, row, bucket, count, of, y in _parts(batches, ROWS):
            b = _Block(row, bucket, count, n, idf, None if full else 0, np.float32)
            value = b.value
            every += np.bincount(bucket, value, minlength=size)
            if not full:
                squares[0] += np.bincount(bucket, value * value, minlength=size)
            elif len(b.used) == size:
                squares += b.matrix.T @ b.matrix
            else:
                squares[np.ix_(b.used, b.used)] += b.matrix.T @ b.matrix
            number += np.bincount(y, minlength=k)
            begin, width = np.searchsorted(row, of), np.bincount(row, minlength=n)[of]
            at = np.repeat(begin - np.cumsum(width) + width, width) + np.arange(width.sum())  # a row's terms, for each of its classes
            np.add.at(own, np.repeat(y.astype(np.int64), width) * size + bucket[at], value[at])
        yield from _blocks(number, own.reshape(k, size))
        yield -1, every
        for i in range(0, len(squares), ROWS):
            yield -2 - i, squares[i : i + ROWS].ravel().astype(float)

    found = _added(rows, sums)
    number, own = _unblocked(found, k, size, 1)
    squares = np.zeros((size, size) if full else (1, size), np.float32 if full else float)
    for i in range(0, len(squares), ROWS):
        squares[i : i + ROWS] = found.pop(-2 - i).reshape(-1, size)
    return number[:, 0], own, found[-1].copy(), squares


def _summed(rows: DataFrame, weights: np.ndarray, bias: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over packed rows for each class, as if no row had it: (loss, gradient of weights, gradient of bias)."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, bias, idf))  # MOST numbers at most
    k, size = weights.shape

    def sums(batches):
        weights, bias, idf = shared.value
        both, gw = np.zeros((k, 2)), np.zeros((k, size))
        for n, row, bucket, count, _, _ in _parts(batches, _height(k, size)):
            b = _Block(row, bucket, count, n, idf, k, weights.dtype)
            s = (b.scores(weights) + bias).astype(weights.dtype, copy=False)
            e = np.exp(-np.abs(s))
            both[:, 0] += (np.maximum(s, 0) + np.log1p(e)).sum(axis=0, dtype=float)
            p = np.where(s >= 0, 1, e) / (1 + e)
            both[:, 1] += p.sum(axis=0, dtype=float)
            b.add(p, gw)
        yield from _blocks(both, gw)

    both, gw = _unblocked(_added(rows, sums), k, size, 2)
    shared.destroy()
    return both[:, 0], gw, both[:, 1]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b, dtype=float)


def minimised(evaluate, solve, x: np.ndarray, value: np.ndarray, g: np.ndarray, passes: int, most: np.ndarray, kind: type = float) -> np.ndarray:
    """The places of the least values of smooth convex functions, one a row of x, by limited-memory BFGS.

    evaluate(rows, x) gives (values, gradients), solve(rows, v) an approximate inverse Hessian times v; value and g are
    those of the start. A row is done when no number of its gradient is over its `most`; it is evaluated `passes` times at most.
    Steps are remembered as floats of a `kind`, and directions made for a few rows at a time: such arrays are what the driver holds.
    """
    past: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def direction(rows: np.ndarray) -> np.ndarray:
        q, steps = g[rows], []  # a copy
        for of, s, y in reversed(past):
            at = np.minimum(np.searchsorted(of, rows), len(of) - 1)
            s, y = np.where((of[at] == rows)[:, None], s[at], 0), y[at]
            sy = _dots(s, y)
            rho = np.divide(1, sy, out=np.zeros(len(rows)), where=sy > 0)
            a = rho * _dots(s, q)
            q -= a[:, None] * y
            steps.append((s, y, rho, a))
        d = solve(rows, q)
        for s, y, rho, a in reversed(steps):
            d += (a - rho * _dots(y, d))[:, None] * s
        return -d

    over = lambda: np.maximum(g.max(axis=1), -g.min(axis=1)) > most
    on = fresh = np.flatnonzero(over())
    d, step = np.zeros(x.shape, kind), np.ones(len(x))
    for _ in range(passes):
        if not len(on):
            break
        step[fresh] = 1
        for i in range(0, len(fresh), 4 * BLOCK):
            d[fresh[i : i + 4 * BLOCK]] = direction(fresh[i : i + 4 * BLOCK])
        new = x[on]
        new += d[on] * step[on, None].astype(kind)
        new_value, new_g = evaluate(on, new)
        slope, new_slope = _dots(g, d)[on], _dots(new_g, d[on])
        # A convex function that still falls at the new place has fallen all the way; near the least value the sums' rounding
        # hides a decrease, and there the slopes tell.
        flat = (np.abs(new_slope) <= 0.8 * np.abs(slope)) & (new_value <= value[on] + 1e-6 * np.abs(value[on]))
        good = (new_slope <= 0) | flat | (new_value <= value[on] + 1e-4 * step[on] * slope)
        rows, at = on[good], np.flatnonzero(good)
        s, y = (np.empty((len(rows), x.shape[1]), kind) for _ in range(2))
        for i in range(0, len(rows), 4 * BLOCK):
            few, r, j = slice(i, i + 4 * BLOCK), rows[i : i + 4 * BLOCK], at[i : i + 4 * BLOCK]
            s[few], y[few] = new[j] - x[r], new_g[j] - g[r]
            x[r], g[r] = new[j], new_g[j]
        value[rows] = new_value[good]
        del new, new_g
        step[on[~good]] *= np.clip(slope / np.minimum(slope - new_slope, -1e-300), 0.1, 0.7)[~good]
        still = over()[on]
        on, fresh = on[still], on[still & good]
        past = [(of[(m := np.isin(of, on))], s[m], y[m]) for of, s, y in ([*past, (rows, s, y)] if len(rows) else past)[-MEMORY:]]
        past = [p for p in past if len(p[0])]
    return x


def fit(train: DataFrame, codes: Sequence, text: str, label: str, features: int = 1 << 12, l2: float = 1e-4, passes: int = 60, tolerance: float = 1e-6) -> Model:
    """All classes' weights from the rows' texts and labels (a code, or an array of codes)."""
    codes = list(dict.fromkeys(codes))
    if not codes or len(codes) * features > MOST:
        raise ValueError(f"classes times features must be 1 to {MOST}")
    own = F.col(label) if isinstance(train.schema[label].dataType, T.ArrayType) else F.array(label)
    number = F.create_map(*[F.lit(x) for i, c in enumerate(codes) for x in (c, i)])
    ys = F.array_distinct(F.array_compact(F.transform(F.coalesce(own, F.array()), lambda c: F.try_element_at(number, c))))
    packed = _packed(train.select(_buckets(F.col(text), features).alias("terms"), ys.alias("ys")), features)
    rows = settled(packed.repartition(train.sparkSession.sparkContext.defaultParallelism))
    idf, n = inverse_frequencies(rows, features)
    k = len(codes)
    if not n:
        return Model(codes, np.zeros((k, features)), np.zeros(k), idf)
    full = features <= min(FULL, passes * k)  # the covariances cost as much as features / (4 k) passes: a quarter of them at most
    number, own, every, squares = _labelled(rows, idf, k, full)
    for v in (number, own, every, squares):
        v /= n
    kind = np.float32 if tolerance >= SINGLE else np.float64
    share = np.clip(number, 0.5 / n, 1 - 0.5 / n)
    curve = (share * (1 - share))[:, None]
    if full:
        squares = squares.astype(kind, copy=False)
        squares -= np.outer(every, every).astype(kind)
        spread, axes = np.linalg.eigh(squares)
    else:
        spread, axes = squares[0] - every * every, None
    spread, squares = np.maximum(spread, 0), None

    def solve(which: np.ndarray, v: np.ndarray) -> np.ndarray:
        # The Hessian at the start is curve * [[spread + every every', every], [every', 1]] + l2; the bias is eliminated.
        w = v[:, :-1] - v[:, -1:] * every
        scale = np.maximum(curve[which] * spread + l2, 1e-12)
        w = w / scale if axes is None else (w.astype(kind) @ axes / scale).astype(kind) @ axes.T
        return np.hstack([w, v[:, -1:] / curve[which] - (w @ every)[:, None]])

    def evaluate(which: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, bias = x[:, :-1], x[:, -1]
        loss, gw, gb = _summed(rows, w.astype(kind), bias.astype(kind), idf)
        out = np.empty_like(x)
        out[:, :-1], out[:, -1] = gw, gb
        del gw
        out /= n
        out[:, :-1] += l2 * w
        labelled = own if len(which) == k else own[which]
        out[:, :-1] -= labelled
        out[:, -1] -= number[which]
        return loss / n - _dots(w, labelled) - bias * number[which] + l2 / 2 * _dots(w, w), out

    x = np.hstack([np.zeros((k, features)), np.log(share / (1 - share))[:, None]])
    g = np.hstack([np.outer(share, every) - own, (share - number)[:, None]])
    some = (number > 0) & (number < 1)
    most = np.where(some, np.minimum(tolerance, SHARE * np.abs(g).max(axis=1)), tolerance)
    value = -number * np.log(share) - (1 - number) * np.log1p(-share)
    found = minimised(evaluate, solve, x, value, g, passes, most, kind)
    return Model(codes, found[:, :-1], found[:, -1], idf)


def topk(test: DataFrame, model: Model, text: str, id_col: str, k: int) -> DataFrame:
    """(id, place, code, score): the k best classes of each row; ties to the code that comes first."""
    shared = test.sparkSession.sparkContext.broadcast(model)
    features = model.weights.shape[1]
    order = sorted(range(len(model.codes)), key=lambda i: model.codes[i])
    schema = T.StructType([T.StructField(id_col, test.schema[id_col].dataType), T.StructField("place", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([str(m.codes[i]) for i in order])
        height = _height(*m.weights.shape)
        for batch in batches:
            for i in range(0, batch.num_rows, height):
                part = batch.slice(i, height)
                b = _Block(*_counted(part.column(1), features), part.num_rows, m.idf, len(m.codes))
                s = np.round((b.scores(m.weights) + m.bias)[:, order], 6)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(part.num_rows), best.shape[1])
                place = np.tile(np.arange(1, best.shape[1] + 1, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(place), names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, 1).ravel())], schema.names)

    return test.select(id_col, _buckets(F.col(text), features).alias("terms")).mapInArrow(run, schema)
