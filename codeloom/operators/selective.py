"""Selective prediction: risk-coverage curves, calibration, and report tables.

Scores are oriented so that more is surer; ties are ordered by id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.metrics import ratio
from codeloom.operators.ordering import on_slices, ranked, settled, written

#: Slices whose grids are broadcast; beyond them they are joined.
SLICES = 10_000
#: Temperatures tried in a round: few enough sums for one generated method.
GRID = 12


def orient(signal: str, c: Column) -> Column:
    """Log-probabilities as they are, entropies negated."""
    return -c if "entropy" in signal else c


def curve(df: DataFrame, score: str, correct: str, id_col: str, by: Sequence[str] = (), ids: bool = True) -> DataFrame:
    """(by, id, score, rank, n, coverage, accuracy, risk) at every rank, surest first; without `ids` no id and score, which then aren't settled.

    `correct` may be any figure of a record (a match, a record's F1): `accuracy` is its mean so far.
    """
    slim = df.select(*by, F.col(id_col).alias("_id"), F.col(score).alias("_score"), F.col(correct).cast("double").alias("_hit"))
    # A slice's rows are counted with its ranks: a join by slice would bring all rows of a slice to one task.
    r = ranked(slim, [F.col("_score").desc(), F.col("_id").asc()], {"hits": F.col("_hit")}, by, count="n", keep=["_id", "_score"] if ids else [])
    accuracy = F.col("hits") / F.col("rank")
    own = [F.col("_id").alias(id_col), F.col("_score").alias("score")] if ids else []
    return r.select(*by, *own, "rank", "n", (F.col("rank") / F.col("n")).alias("coverage"), accuracy.alias("accuracy"), (1 - accuracy).alias("risk"))


def _area() -> Column:
    """Trapezoids of the risk over coverage; with steps of 1/n that is the mean risk less half the ends."""
    n = F.max("n")
    ends = F.sum(F.when((F.col("rank") == 1) | (F.col("rank") == F.col("n")), F.col("risk") / 2).otherwise(0.0)) + F.when(n == 1, F.max("risk") / 2).otherwise(0.0)
    return F.round((F.sum("risk") - ends) / n, 9).alias("aurc")


def aurc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(_area())


def rc_curve(points: DataFrame, coverages: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """For each wanted coverage: records kept (floor, one at least), the threshold (null beyond the ends) and the accuracy."""
    wanted = F.explode(F.array(*[F.lit(float(c)) for c in coverages]))
    d = points.withColumn("wanted", wanted)
    keep = F.when(F.col("wanted") >= 1, F.col("n")).when(F.col("wanted") <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("wanted") * F.col("n"))))
    at = d.withColumn("n_kept", keep.cast("long"))
    last = F.max(F.when(F.col("rank") == F.col("n_kept"), F.col("score")))
    return at.groupBy(*by, "wanted").agg(
        F.max("n_kept").alias("n_kept"), F.when(F.col("wanted") < 1, last).alias("threshold"), F.max(F.when(F.col("rank") == F.col("n_kept"), F.col("accuracy"))).alias("value")
    ).withColumnRenamed("wanted", "coverage")


def rc_table(df: DataFrame, signals: Sequence[str], metrics: Sequence[str], coverages: Sequence[float], id_col: str) -> DataFrame:
    """(metric, signal, coverage, n_kept, value): every metric column against every signal, ranked in one job."""
    figures = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("figure")) for m in metrics]))
    d = stacked(df, signals, [id_col, *metrics]).withColumn("_m", figures)
    points = curve(d.select(id_col, "signal", "score", "_m.metric", "_m.figure"), "score", "figure", id_col, ["metric", "signal"])
    return rc_curve(points, coverages, ["metric", "signal"])


def rc_metric(df: DataFrame, score: str, id_col: str, metric: Column, coverages: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, coverage, n_kept, value): any aggregate expression over the records kept at each coverage.

    Ranks are made without gathering the rows; each kept row is then counted once for each coverage.
    """
    r = ranked(df, [F.col(score).desc(), F.col(id_col).asc()], by=by, count="_n")
    r = r.withColumn("coverage", F.explode(F.array(*[F.lit(float(c)) for c in coverages])))
    keep = F.when(F.col("coverage") >= 1, F.col("_n")).when(F.col("coverage") <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("coverage") * F.col("_n"))))
    return r.where(F.col("rank") <= keep).groupBy(*by, "coverage").agg(F.count(F.lit(1)).alias("n_kept"), metric.alias("value"))


def coverage_at_threshold(df: DataFrame, score: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(score) >= threshold).cast("int")).alias("coverage"))


def _coverages_at(targets: Sequence[float]) -> list[Column]:
    return [F.coalesce(F.max(F.when(F.col("accuracy") >= t, F.col("coverage"))), F.lit(0.0)).alias(f"coverage_at_{round(t * 100)}") for t in targets]


def _accuracies_at(coverages: Sequence[float]) -> list[Column]:
    return [F.max_by("accuracy", F.when(F.col("coverage") <= c + 1e-12, F.col("rank"))).alias(f"accuracy_at_{round(c * 100)}") for c in coverages]


def coverage_at_accuracy(points: DataFrame, targets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The largest coverage at which the accuracy is still the target, 0 if there is none."""
    return points.groupBy(*by).agg(*_coverages_at(targets))


def accuracy_at_coverage(points: DataFrame, coverages: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(*_accuracies_at(coverages))


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """(bin, n, confidence, accuracy) of equal bins that are open to the left."""
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.col(confidence) * bins)))
    return df.groupBy(*by, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("int")).alias("accuracy"))


def ece(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n"), 9).alias("ece"))


def _search(evaluate, low: float, high: float, rounds: int, width: int) -> float:
    """The least of a function with one dip, by a grid of temperatures evaluated in one job a round."""
    for _ in range(rounds):
        grid = [math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (width - 1)) for i in range(width)]
        values = evaluate(grid)
        if values is None:
            return 1.0
        best = min(range(width), key=lambda i: values[i])
        low, high = grid[max(0, best - 1)], grid[min(width - 1, best + 1)]
    return math.sqrt(low * high)


def fit_temperatures(df: DataFrame, score: str, correct: str, by: Sequence[str] = (), low: float = 0.05, high: float = 50.0, tolerance: float = 2e-7) -> dict[tuple, float]:
    """For each slice the temperature at which sigmoid(score / T) has the least cross-entropy.

    That is where the gradient changes sign, which it does once at most: it only grows with 1 / T. A few temperatures
    are tried in one job a round, and the next ones lie between the neighbours with other signs, until those are within
    the tolerance. If the ends have the same sign, the temperature is 1. The rows are written once and a round reads
    only those. The driver holds some numbers a slice, as its result does.
    """
    slim = df.select(*by, F.col(score).cast("double").alias("_x"), F.col(correct).cast("double").alias("_y"))
    return _fitted(written(slim), by, low, high, tolerance)


def _fitted(slim: DataFrame, by: Sequence[str], low: float = 0.05, high: float = 50.0, tolerance: float = 2e-7) -> dict[tuple, float]:
    """fit_temperatures for rows (by, _x, _y) that are cheap to read again."""
    x, y = F.col("_x"), F.col("_y")
    sums = [F.sum((1 / (1 + F.exp(-x / F.col("_grid")[i])) - y) * x).alias(f"_{i}") for i in range(GRID)]

    first = [low, *[low * (high / low) ** (i / (GRID - 1)) for i in range(1, GRID - 1)], high]
    rows = slim.withColumn("_grid", F.array(*map(F.lit, first))).groupBy(*by).agg(*sums).collect()
    slices = [tuple(r[: len(by)]) for r in rows]
    known = [dict(zip(first, r[len(by) :], strict=True)) for r in rows]

    def gradients(grid: dict[int, list[float]]) -> dict[int, list[float]]:
        """Gradients of slices (by their places in `slices`) at temperatures of their own."""
        if not by:
            d = slim.select("*", F.lit(0).alias("_slice"), F.array(*map(F.lit, grid[0])).alias("_grid"))
        else:
            schema = T.StructType([*slim.select(*by).schema.fields, T.StructField("_slice", T.IntegerType()), T.StructField("_grid", T.ArrayType(T.DoubleType()))])
            table = slim.sparkSession.createDataFrame([(*slices[i], i, v) for i, v in grid.items()], schema)
            d = on_slices(slim, F.broadcast(table) if len(grid) <= SLICES else table, by)
        return {r[0]: r[1:] for r in d.groupBy("_slice").agg(*sums).collect()}

    found: dict[int, float] = {}
    for i, g in enumerate(known):
        if g[low] is None or not g[low] * g[high] <= 0:
            found[i] = 1.0
        elif g[low] == 0:
            found[i] = low + tolerance / 2
    while len(found) < len(slices):
        grid = {}
        for i, g in enumerate(known):
            if i in found:
                continue
            a = max((t for t, v in g.items() if g[low] * v > 0), default=low)
            b = min(t for t in g if t > a)
            tries = _between(g, a, b) if b - a > tolerance else []
            if tries:
                grid[i] = [*tries, *[b] * (GRID - len(tries))]
            else:
                found[i] = (a + b) / 2
        for i, g in (gradients(grid) if grid else {}).items():
            known[i] |= {t: v for t, v in zip(grid[i], g, strict=True) if t not in known[i]}
    return {slices[i]: t for i, t in found.items()}


def _between(known: dict[float, float], a: float, b: float) -> list[float]:
    """GRID temperatures at most within (a, b): three in even steps, the others about where a cubic through the nearest gradients is zero."""
    u, w = math.log(a), math.log(b) - math.log(a)
    near = {g: math.log(t) for t, g in sorted(known.items(), key=lambda p: abs(math.log(p[0]) - u - w / 2))[:4]}
    guess = sum(v * math.prod(h / (h - g) for h in near if h != g) for g, v in near.items())
    if not u < guess < u + w:
        guess = u + w / 2
    steps = [guess, *[guess + s * w * k for s in (-1, 1) for k in (1e-1, 1e-2, 1e-3, 1e-5)], *[u + w * i / 4 for i in (1, 2, 3)]]
    return sorted({t for t in map(math.exp, steps) if a < t < b and t not in known})[:GRID]


def fit_temperature_binary(df: DataFrame, score: str, correct: str, **kw) -> float:
    """The temperature of all rows together (see fit_temperatures)."""
    return fit_temperatures(df, score, correct, **kw)[()]


def fit_temperature_tokens(df: DataFrame, logits: str, gold: str, low: float = 0.05, high: float = 50.0, rounds: int = 5, width: int = 16) -> tuple[float, float, float]:
    """(T, mean loss before, after) for rows of logits and the gold position (from 0); (1, 0, 0) without rows."""

    def nll(t):
        scaled = F.struct(F.transform(F.col(logits), lambda v: v.cast("double") / t).alias("x"), (F.array_max(logits).cast("double") / t).alias("top"))
        # The array of one binds its value, which would be worked out again for each logit otherwise.
        loss = F.transform(F.array(scaled), lambda s: F.log(F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + F.exp(v - s["top"]))) + s["top"] - F.element_at(s["x"], (F.col(gold) + 1).cast("int")))
        return F.avg(loss[0])

    def evaluate(grid):
        each = df.select(logits, gold, F.posexplode(F.array(*map(F.lit, grid))).alias("_i", "_t"))
        found = {r["_i"]: r["loss"] for r in each.groupBy("_i").agg(nll(F.col("_t")).alias("loss")).collect()}
        return [found[i] for i in range(len(grid))] if found and found[0] is not None else None

    t = _search(evaluate, low, high, rounds, width)
    ends = evaluate([1.0, t])
    return (t, ends[0], ends[1]) if ends else (1.0, 0.0, 0.0)


def sequence_signals(df: DataFrame, logprobs: str, entropies: str) -> DataFrame:
    """Adds sum, mean and least log-probability, mean and first entropy; empty sequences get +-1e9."""
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    none = (F.size(logprobs) <= 0) | F.col(logprobs).isNull()
    bad = F.lit(-1e9)
    return df.withColumns({
        "sum_logprob": F.when(none, bad).otherwise(total(logprobs)), "mean_logprob": F.when(none, bad).otherwise(ratio(total(logprobs), F.size(logprobs))),
        "min_logprob": F.when(none, bad).otherwise(F.array_min(logprobs)), "mean_entropy": F.when(none, -bad).otherwise(ratio(total(entropies), F.size(entropies))),
        "first_entropy": F.when(none, -bad).otherwise(F.try_element_at(F.col(entropies), F.lit(1))),
    })


def stacked(df: DataFrame, signals: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row for each record and signal, oriented."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), orient(s, F.col(s)).cast("double").alias("score")) for s in signals])
    return df.select(*keep, F.explode(pairs).alias("_s")).select(*keep, "_s.signal", "_s.score")


def signal_report(df: DataFrame, signals: Sequence[str], correct: str, id_col: str, bins: int = 15) -> DataFrame:
    """AURC, coverage at 95 and 99 % accuracy, calibration error before and after scaling, and the temperature of each signal, best first."""
    slim = written(df.select(F.col(id_col).alias("_id"), F.col(correct).cast("double").alias("_y"), *[F.col(s).cast("double").alias(s) for s in signals]))
    both = stacked(slim, signals, ["_id", "_y"])  # read by the curve, the temperatures and the calibration errors
    points = curve(both, "score", "_y", "_id", ["signal"], ids=False)
    fitted = _fitted(both.select("signal", F.col("score").alias("_x"), "_y"), ["signal"])
    t = F.element_at(F.create_map(*[F.lit(x) for k, v in fitted.items() for x in (k[0], v)]), F.col("signal"))
    stages = F.explode(F.array(F.struct(F.lit("ece_raw").alias("stage"), F.lit(1.0).alias("t")), F.struct(F.lit("ece_calibrated").alias("stage"), t.alias("t"))))
    d = both.withColumn("_s", stages).select("signal", "_y", F.col("_s.stage").alias("stage"), (1 / (1 + F.exp(-F.col("score") / F.col("_s.t")))).alias("_p"))
    errors = ece(reliability(d, "_p", "_y", bins, ["signal", "stage"]), ["signal", "stage"]).groupBy("signal").pivot("stage", ["ece_raw", "ece_calibrated"]).agg(F.max("ece"))
    out = points.groupBy("signal").agg(_area(), *_coverages_at((0.95, 0.99))).join(errors, "signal")
    return out.withColumn("temperature", t).orderBy("aurc", "signal")


def loso_report(df: DataFrame, source: str, score: str, correct: str, id_col: str, expected: dict[str, float] | None = None) -> DataFrame:
    """Accuracy, AURC, retained accuracy and coverages of each source and pooled; with expected accuracies, the difference and a verdict."""
    both = settled(df.select(F.explode(F.array(F.col(source), F.lit("pooled"))).alias("slice"), score, correct, id_col))
    points = curve(both, score, correct, id_col, ["slice"], ids=False)
    head = both.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy"))
    out = on_slices(head, points.groupBy("slice").agg(_area(), *_accuracies_at((0.8, 0.9)), *_coverages_at((0.95, 0.99))), ["slice"])
    if not expected:
        return out
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]), F.col("slice"))
    return out.withColumns({"delta": F.col("accuracy") - known, "verdict": verdict(F.col("accuracy"), known)})


def verdict(value: Column, expected: Column, close: float = 0.02, match: float = 0.005) -> Column:
    """MATCH, CLOSE or DIFFER by the difference; null without an expected value."""
    d = F.abs(value - expected)
    return F.when(d < match, "MATCH").when(d < close, "CLOSE").when(d >= close, "DIFFER")


def defer_or_accept(df: DataFrame, score: str, threshold: float | None = None, coverage: float | None = None, id_col: str = "record_id") -> DataFrame:
    """Adds `decision`: accepted are scores from the threshold on, or the surest share of records (one at least, ties by id)."""
    if (threshold is None) == (coverage is None):
        raise ValueError("give a threshold or a coverage")
    if threshold is not None:
        return df.withColumn("decision", F.when(F.col(score) >= threshold, "accept").otherwise("review"))
    n = F.col("_n")
    keep = n if coverage >= 1 else F.lit(0) if coverage <= 0 else F.greatest(F.lit(1), F.floor(F.lit(float(coverage)) * n))
    return ranked(df, [F.col(score).desc(), F.col(id_col).asc()], count="_n").withColumn("decision", F.when(F.col("rank") <= keep, "accept").otherwise("review")).drop("rank", "_n")
