import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds, scale=256):
    """(id, code, error, label_error) of each row and the codebooks, by comparing every part with every entry."""
    fit = [r for r in rows if r[1] and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    fit.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fit = [r for r in fit if len(r[1]) == len(fit[0][1])]
    d = len(fit[0][1]) // parts
    v = [[[math.floor(scale * float(np.float32(x))) for x in r[1][p * d : p * d + d]] for p in range(parts)] for r in fit]
    book = [[list(x[p]) for x in v[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x: [min(range(len(book[p])), key=lambda e: (far(x[p], book[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        codes, sums = [best(x) for x in v], defaultdict(list)
        for x, c in zip(v, codes, strict=True):
            for p in range(parts):
                sums[p, c[p]].append(x[p])
        for (p, e), own in sums.items():
            book[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    codes = [best(x) for x in v]
    errors = [sum(far(x[p], book[p][c[p]]) for p in range(parts)) for x, c in zip(v, codes, strict=True)]
    by = defaultdict(int)
    for r, e in zip(fit, errors, strict=True):
        by[r[2]] += e
    return sorted(((r[0], bytes(c).hex(), e, by[r[2]]) for r, c, e in zip(fit, codes, errors, strict=True)), key=str), book


def rows_of(spark, rows, parts, entries, rounds):
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "vec", "code", "error", "slot", "n", "s0")}).repartition(3)
    codes, book = vector_codes.encode(df, label_col="label", parts=parts, entries=entries, rounds=rounds)
    out = vector_codes.label_errors(codes).select("id", F.lower(F.hex("code")), "error", "label_error")
    return sorted(map(tuple, out.collect()), key=str), book, codes


@pytest.mark.parametrize("parts,entries,rounds", [(4, 8, 2), (2, 64, 3), (8, 3, 1), (1, 5, 0)])
def test_codes_against_plain_kmeans(spark, parts, entries, rounds):
    rng = np.random.default_rng(entries)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + rng.normal(scale=0.2, size=8)).tolist(), int(i % 3) if i % 7 else None) for i in rng.permutation(400)]
    rows += [(i, [float(i % 2), 0.5] * 4, 1) for i in range(400, 430)]  # equal parts, ties
    got, book, _ = rows_of(spark, rows, parts, entries, rounds)
    want, plain_book = plain(rows, parts, entries, rounds)
    assert book.tolist() == plain_book and got == want


def test_odd_rows(spark):
    fine = [0.25, -0.001, 3.0, 1e-9]
    rows = [(3, fine, 1), (3, fine, 1), (1, None, 1), (2, [], 1), (4, [1.0, None, 0.0, 0.0], 1), (5, [1.0, float("nan"), 0.0, 0.0], 1), (6, [1.0, float("inf"), 0.0, 0.0], 1), (7, [1.0, 2.0], None), (0, [1.0, 2.0, 3.0], 2), (None, [0.0] * 4, None), (8, [0.5] * 4, None)]
    want, plain_book = plain([r for r in rows if r[0] != 7], 4, 64, 2)  # of another width than the first fit row
    got, book, codes = rows_of(spark, rows, 4, 64, 2)
    assert got == want and book.tolist() == plain_book and len(got) == 4
    assert {r.id: r.vec for r in vector_codes.decode(codes, book).collect()}[8] == [0.5] * 4
    none, nothing, _ = rows_of(spark, [(1, None, 1)], 4, 64, 2)
    assert none == [] and nothing.size == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.encode(spark.createDataFrame([(1, [1e12] * 4, 1)], VECTORS), parts=4)


def test_balls_skip_nothing_that_could_be_nearer():
    rng = np.random.default_rng(0)
    for spread in (1, 3, 40, 10**6):
        book = rng.integers(-spread, spread + 1, (64, 4))
        x = rng.integers(-spread, spread + 1, (3000, 4))
        balls = vector_codes.Balls(book)
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        want = d.argmin(axis=1)
        assert (vector_codes.nearest(x, book) == want).all()
        for code in (want, rng.integers(0, 64, 3000), np.zeros(3000, np.int64)):
            assert (balls.reassign(x, code) == want).all()
