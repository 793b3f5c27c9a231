import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import periodic
from codeloom.llm.common import text_view
from codeloom.llm.wavelet import Names, WaveletMatrix


def plain_runs(w, least, times):
    """All maximal stretches, period by period."""
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, times * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def plain_left(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made_up(rng):
    letters, w = rng.choice([1, 2, 2, 3, 5, 50]), []
    while rng.random() < 0.85 and len(w) < 500:
        kind = rng.random()
        if kind < 0.3:
            w += [rng.randrange(letters) for _ in range(rng.randrange(30))]
        elif kind < 0.8:
            pattern = [0] * (rng.random() < 0.4) * rng.randrange(1, 30) + [rng.randrange(letters) for _ in range(rng.randrange(1, rng.choice([3, 8, 20, 70])))]
            w += (pattern * 12)[: int(len(pattern) * rng.uniform(1, 7))]
        elif w:
            at = rng.randrange(len(w))
            w += w[at : at + rng.randrange(60)] * rng.randrange(1, 4)
    return [f"w{x}" for x in w]


@pytest.mark.parametrize("least,times", [(24, 3), (10, 3), (3, 3), (24, 4), (50, 3)])
def test_runs_against_plain_search(least, times):
    rng, seen = random.Random(least), 0
    for _ in range(60):
        docs = [made_up(rng) for _ in range(rng.randrange(1, 12))]
        f = periodic.Found(*text_view(pa.array([rng.choice(["", " \n"]) + rng.choice([" ", " \t"]).join(w) + rng.choice(["", " "]) for w in docs])), least, times)
        for d, w in enumerate(docs):
            got = [tuple(int(x[i]) for x in f.runs) for i in range(f.offsets[d], f.offsets[d + 1])]
            assert got == plain_runs(w, least, times)
            assert f.left[d].as_py() == plain_left(w, got)
            seen += len(got)
    assert seen > 100


def test_wavelet_matrix_and_names():
    rng = np.random.default_rng(3)
    values = rng.permutation(300)
    matrix = WaveletMatrix(values)
    low = rng.integers(0, 299, 200)
    high = low + 1 + rng.integers(0, 300 - low)
    bound = rng.integers(0, 400, 200)
    assert matrix.below(low, high, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound, strict=True)]
    k = rng.integers(0, high - low)
    assert matrix.least(low, high, k).tolist() == [sorted(values[a:b])[i] for a, b, i in zip(low, high, k, strict=True)]
    text = np.append(rng.integers(0, 2, 200), [7])
    names = Names(text, 5)
    for level, name in enumerate(names.levels):
        own = [tuple(text[i : i + (1 << level)]) for i in range(len(text))]
        assert all((name[i] == name[j]) == (own[i] == own[j]) for i in range(len(text)) for j in range(0, len(text), 7))
    for i, j in ((0, 9), (50, 51), (199, 3)):
        same = text[i:] if len(text) - i < len(text) - j else text[j:]
        assert names.after(np.array([i]), np.array([j]))[0] == next(n for n in range(len(same) + 1) if n == len(same) or text[i + n] != text[j + n])


def test_odd_rows(spark):
    long = "la " * 50_000 + " ".join(f"x{i}" for i in range(3000))
    rows = [(1, "a b " * 20), (1, "a b " * 20), (2, None), (3, ""), (4, " \n\t "), (None, "é " * 30), (5, long), (6, "one"), (7, "tick tock " * 11 + "tick")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "runs", "left", "start", "period", "n_words")})
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.left) for r in periodic.periodic_runs(docs).collect()), key=str)
    want = []
    for i, t in rows:
        w = (t or "").split()
        found = [(0, 50_000, 1)] if i == 5 else plain_runs(w, 24, 3)
        want.append((i, len(w), found, plain_left(w, found)))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, times=2)


def test_ties_between_runs(spark):
    spans = "array<struct<start:long,length:long,period:long>>"
    rows = [([(0, 30, 3), (40, 20, 2), (90, 10, 1)],), ([(5, 31, 10), (9, 32, 10), (20, 64, 20)],), ([],)]
    got = [r.b for r in spark.createDataFrame(rows, f"runs {spans}").select(periodic.strongest("runs").alias("b")).collect()]
    assert [x and tuple(x) for x in got] == [(0, 30, 3), (9, 32, 10), None]
