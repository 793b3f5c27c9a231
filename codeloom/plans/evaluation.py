"""Queries on predictions: metrics, slices, error tables, selective prediction."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from codeloom.functions import scalars as S
from codeloom.operators import intervals as V
from codeloom.operators import leakage as L
from codeloom.operators import metrics as M
from codeloom.operators import selective as P
from codeloom.operators.ordering import on_slices, settled
from codeloom.plans.views import ctes, pairs, table, view

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


LONG = ctes("eval_long")
RECORDS = ctes("eval_records")
# A long frame with every source and the total.
BOTH = LONG + ", long AS (SELECT record_id, source_id AS slice, code, is_gold, is_pred FROM eval_long UNION ALL SELECT record_id, 'overall', code, is_gold, is_pred FROM eval_long)\n"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("multilabel_micro", LONG + """SELECT CAST(tp AS BIGINT) AS tp, CAST(p - tp AS BIGINT) AS fp, CAST(g - tp AS BIGINT) AS fn, tp / p AS precision, tp / g AS recall, 2 * tp / (p + g) AS f1, tp / (p + g - tp) AS jaccard
FROM (SELECT CAST(sum(is_gold * is_pred) AS DOUBLE) AS tp, CAST(sum(is_pred) AS DOUBLE) AS p, CAST(sum(is_gold) AS DOUBLE) AS g FROM eval_long) s""")
def multilabel_micro(spark, sf):
    return M.micro(pairs(spark, sf))


@query("multilabel_sample", RECORDS + """SELECT round(avg(CASE WHEN n_pred = 0 AND n_gold = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp * 1.0::DOUBLE / n_pred END), 9) AS sample_precision,
 round(avg(CASE WHEN n_gold = 0 THEN (CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END) ELSE tp * 1.0::DOUBLE / n_gold END), 9) AS sample_recall,
 round(avg(2.0::DOUBLE * tp / (n_gold + n_pred)), 9) AS sample_f1, round(avg(1.0::DOUBLE * tp / (n_gold + n_pred - tp)), 9) AS sample_jaccard FROM eval_records""")
def multilabel_sample(spark, sf):
    return rounded(M.sample(pairs(spark, sf)), "sample_precision", "sample_recall", "sample_f1", "sample_jaccard")


@query("multilabel_diagnostics", RECORDS + """, c AS (SELECT count(DISTINCT code) AS classes FROM eval_long)
SELECT count(*) AS n, max(classes) AS classes, round(sum(n_gold + n_pred - 2 * tp)::DOUBLE / (count(*) * max(classes)), 9) AS hamming_loss, round(1 - sum(n_gold + n_pred - 2 * tp)::DOUBLE / (count(*) * max(classes)), 9) AS hamming_score,
 round(avg(n_gold), 9) AS avg_gold, round(avg(n_pred), 9) AS avg_pred, round(avg(abs(n_gold - n_pred)), 9) AS count_mae, round(avg(n_pred - tp), 9) AS avg_fp, round(avg(n_gold - tp), 9) AS avg_fn, round(avg(CASE WHEN n_pred = 0 THEN 1 ELSE 0 END), 9) AS empty_rate FROM eval_records, c""")
def multilabel_diagnostics(spark, sf):
    return rounded(M.diagnostics(pairs(spark, sf)), "hamming_loss", "hamming_score", "avg_gold", "avg_pred", "count_mae", "avg_fp", "avg_fn", "empty_rate")


@query("class_stats", LONG + "SELECT code, CAST(sum(is_gold * is_pred) AS BIGINT) AS tp, CAST(sum(is_gold) AS BIGINT) AS gold_total, CAST(sum(is_pred) AS BIGINT) AS pred_total FROM eval_long GROUP BY code")
def class_stats(spark, sf):
    return M.class_stats(pairs(spark, sf))


_PER = "SELECT {0}code, CAST(sum(is_gold * is_pred) AS DOUBLE) AS tp, CAST(sum(is_gold) AS DOUBLE) AS g, CAST(sum(is_pred) AS DOUBLE) AS p FROM {1} GROUP BY {0}code"
_MACRO = "count(*) AS classes, round(avg(CASE WHEN p = 0 THEN 0 ELSE tp / p END), 9) AS macro_precision, round(avg(CASE WHEN g = 0 THEN 0 ELSE tp / g END), 9) AS macro_recall, round(avg(2 * tp / (g + p)), 9) AS macro_f1"


@query("multilabel_macro", LONG + f"SELECT {_MACRO} FROM ({_PER.format('', 'eval_long')}) c")
def multilabel_macro(spark, sf):
    return rounded(M.macro(pairs(spark, sf)), "macro_precision", "macro_recall", "macro_f1")


_SET = """SELECT a.{0}, a.n, a.accuracy, a.micro_precision, a.micro_recall, a.micro_f1, m.classes, m.macro_precision, m.macro_recall, m.macro_f1
FROM (SELECT {0}, count(*) AS n, round(avg(CASE WHEN tp = g AND tp = p THEN 1 ELSE 0 END), 9) AS accuracy, round(CASE WHEN sum(p) = 0 THEN 0 ELSE sum(tp)::DOUBLE / sum(p) END, 9) AS micro_precision,
  round(CASE WHEN sum(g) = 0 THEN 0 ELSE sum(tp)::DOUBLE / sum(g) END, 9) AS micro_recall, round(2.0::DOUBLE * sum(tp) / (sum(p) + sum(g)), 9) AS micro_f1
  FROM (SELECT {0}, record_id, sum(is_gold * is_pred) AS tp, sum(is_pred) AS p, sum(is_gold) AS g FROM {1} GROUP BY {0}, record_id) r GROUP BY {0}) a
JOIN (SELECT {0}, """ + _MACRO + " FROM (" + _PER.format("{0}, ", "{1}") + ") c GROUP BY {0}) m ON a.{0} = m.{0}"
_FIGURES = ("accuracy", "micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1")


def _core(figures, key):
    return rounded(figures.select(key, "n", "classes", *_FIGURES), *_FIGURES)


@query("metrics_by_source", BOTH + _SET.format("slice", "long"))
def metrics_by_source(spark, sf):
    d = M.with_total(pairs(spark, sf).withColumnRenamed("source_id", "slice"), "slice")
    return _core(M.metric_set(d, ["slice"]), "slice")


_LEVELS = LONG + ", long AS (SELECT record_id, level, substr(code, 1, len) AS code, max(is_gold) AS is_gold, max(is_pred) AS is_pred FROM eval_long CROSS JOIN (SELECT * FROM (VALUES ('chapter', 1), ('block', 3), ('category', 5)) t(level, len)) t GROUP BY record_id, level, substr(code, 1, len))\n"


@query("metrics_by_level", _LEVELS + _SET.format("level", "long"))
def metrics_by_level(spark, sf):
    d = M.by_level(pairs(spark, sf), {"chapter": 1, "block": 3, "category": 5})
    return _core(M.metric_set(d, ["level"]), "level")


def _full(key: str, long: str) -> str:
    """SELECT of the whole metric set of each `key` of a long table (key, record_id, code, is_gold, is_pred)."""
    share = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"
    row = f"(SELECT {key}, record_id, CAST(sum(is_gold * is_pred) AS BIGINT) AS tp, CAST(sum(is_pred) AS BIGINT) AS p, CAST(sum(is_gold) AS BIGINT) AS g FROM {long} GROUP BY {key}, record_id)"
    figures = {
        "accuracy": "avg(CASE WHEN tp = g AND tp = p THEN 1 ELSE 0 END)", "exact_match": "avg(CASE WHEN tp = g AND tp = p THEN 1 ELSE 0 END)",
        "micro_precision": share("sum(tp)", "sum(p)"), "micro_recall": share("sum(tp)", "sum(g)"), "micro_f1": share("2 * sum(tp)", "sum(p) + sum(g)"), "micro_jaccard": share("sum(tp)", "sum(p) + sum(g) - sum(tp)"),
        "sample_precision": f"avg({share('tp', 'p')})", "sample_recall": f"avg({share('tp', 'g')})", "sample_f1": f"avg({share('2 * tp', 'g + p')})", "sample_jaccard": f"avg({share('tp', 'g + p - tp')})",
        "avg_predicted_label_count": "avg(p)", "avg_true_label_count": "avg(g)", "label_count_mae": "avg(abs(p - g))", "avg_false_positives": "avg(p - tp)", "avg_false_negatives": "avg(g - tp)",
        "empty_prediction_rate": "avg(CASE WHEN p = 0 THEN 1 ELSE 0 END)", "hamming_loss": "sum(g + p - 2 * tp)::DOUBLE / (count(*) * max(u.k))", "hamming_score": "1 - sum(g + p - 2 * tp)::DOUBLE / (count(*) * max(u.k))",
    }
    base = ", ".join(f"round({v}, 9) AS {k}" for k, v in figures.items())
    return f"""SELECT a.*, m.classes, m.macro_precision, m.macro_recall, m.macro_f1 FROM (SELECT r.{key}, count(*) AS n, {base} FROM {row} r JOIN (SELECT {key}, count(DISTINCT code) AS k FROM {long} GROUP BY {key}) u ON r.{key} = u.{key} GROUP BY r.{key}) a
JOIN (SELECT {key}, {_MACRO} FROM ({_PER.format(key + ", ", long)}) c GROUP BY {key}) m ON a.{key} = m.{key}"""


FULL_NAMES = ["n", "accuracy", "exact_match", *[f"micro_{x}" for x in ("precision", "recall", "f1", "jaccard")], *[f"sample_{x}" for x in ("precision", "recall", "f1", "jaccard")], "avg_predicted_label_count", "avg_true_label_count", "label_count_mae", "avg_false_positives", "avg_false_negatives", "empty_prediction_rate", "hamming_loss", "hamming_score", "classes", "macro_precision", "macro_recall", "macro_f1"]


def _with_blocks(key: str, long: str) -> str:
    """_full of the codes and, as chapter_block_*, of their first three characters."""
    cut = f"(SELECT {key}, record_id, substr(code, 1, 3) AS code, max(is_gold) AS is_gold, max(is_pred) AS is_pred FROM {long} GROUP BY 1, 2, 3) cut"
    return f"SELECT w.*, {', '.join(f'b.{x} AS chapter_block_{x}' for x in FULL_NAMES if x != 'n')} FROM ({_full(key, long)}) w JOIN ({_full(key, cut)}) b ON w.{key} = b.{key}"


def allround(df, *but):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


@query("metrics_long_core", BOTH + ", s AS (" + _full("slice", "long") + ") " + " UNION ALL ".join(f"SELECT slice, '{x}' AS metric, CAST({x} AS DOUBLE) AS value FROM s" for x in FULL_NAMES if x in M.CORE or x == "micro_f1"))
def metrics_long_core(spark, sf):
    d = M.with_total(pairs(spark, sf).withColumnRenamed("source_id", "slice"), "slice")
    return allround(M.filter_metrics(M.to_long(M.metric_set(d, ["slice"]), ["slice"]), "core", save_metric=" Micro_F1 "))


@query("per_source_metrics", LONG + ", long AS (SELECT record_id, regexp_replace(source_id, '[^A-Za-z0-9_-]', '_', 'g') AS source_id, code, is_gold, is_pred FROM eval_long WHERE source_id <> '5-LOW' UNION ALL SELECT record_id, 'overall', code, is_gold, is_pred FROM eval_long)\n" + _with_blocks("source_id", "long"))
def per_source_metrics(spark, sf):
    return allround(M.per_source_metrics(pairs(spark, sf), excluded=["5-LOW"], block=3))


@query("single_label_metrics", LONG + """, o AS (SELECT record_id, source_id, string_agg(code, ',' ORDER BY code) FILTER (WHERE is_gold = 1) AS g, string_agg(code, ',' ORDER BY code DESC) FILTER (WHERE is_pred = 1) AS p FROM eval_long GROUP BY 1, 2),
a AS (SELECT source_id, count(*) AS n, round(avg(CASE WHEN g = p THEN 1 ELSE 0 END), 9) AS accuracy, round(avg(CASE WHEN g = p THEN 1 ELSE 0 END), 9) AS exact_match FROM o GROUP BY source_id)
SELECT a.*, m.classes, m.macro_precision, m.macro_recall, m.macro_f1 FROM a JOIN (SELECT source_id, """ + _MACRO + " FROM (" + _PER.format("source_id, ", "eval_long") + ") c GROUP BY source_id) m ON a.source_id = m.source_id")
def single_label_metrics(spark, sf):
    d = pairs(spark, sf).withColumn("pred", F.sort_array("pred", asc=False))  # another order is another string
    return allround(M.metric_set(d, ["source_id"], multi_label=False))


@query("metrics_excluding", LONG + ", long AS (SELECT record_id, 'all' AS slice, code, is_gold, is_pred FROM eval_long UNION ALL SELECT record_id, 'without', code, is_gold, is_pred FROM eval_long WHERE source_id <> '5-LOW')\n" + _SET.format("slice", "long"))
def metrics_excluding(spark, sf):
    return _core(M.metrics_excluding(pairs(spark, sf), "source_id", "5-LOW"), "slice")


@query("aliasing_check", LONG + "SELECT concat(least(s, concat('copy of ', s)), ';', greatest(s, concat('copy of ', s))) AS slices FROM (SELECT DISTINCT source_id AS s FROM eval_long UNION SELECT 'overall') x")
def aliasing_check(spark, sf):
    m = M.metric_set(M.with_total(pairs(spark, sf).withColumnRenamed("source_id", "slice"), "slice"), ["slice"])
    return M.aliasing_check(m.unionByName(m.withColumn("slice", F.concat(F.lit("copy of "), "slice"))), "slice").select(F.array_join(F.array_sort("slices"), ";").alias("slices"))


_BLOCKSETS = LONG + """, b AS (SELECT record_id, string_agg(DISTINCT CASE WHEN is_gold = 1 THEN substr(code, 1, 3) END, ',' ORDER BY CASE WHEN is_gold = 1 THEN substr(code, 1, 3) END) AS t,
 string_agg(DISTINCT CASE WHEN is_pred = 1 THEN substr(code, 1, 3) END, ',' ORDER BY CASE WHEN is_pred = 1 THEN substr(code, 1, 3) END) AS p FROM eval_long GROUP BY record_id)
"""


@query("block_error_pairs", _BLOCKSETS + "SELECT coalesce(t, '') AS true_blocks, coalesce(p, '') AS pred_blocks, count(*) AS n, min(record_id) AS example, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM b WHERE coalesce(t, '') <> coalesce(p, '') GROUP BY 1, 2")
def block_error_pairs(spark, sf):
    return rounded(M.error_pairs(pairs(spark, sf), "record_id"), "share")


_BLOCKS = LONG + ", b AS (SELECT record_id, substr(code, 1, 3) AS block, max(is_gold) AS is_gold, max(is_pred) AS is_pred FROM eval_long GROUP BY 1, 2), s AS (SELECT block, CAST(sum(is_gold) AS BIGINT) AS g, CAST(sum(is_pred) AS BIGINT) AS p, CAST(sum(is_gold * is_pred) AS BIGINT) AS tp FROM b GROUP BY block)\n"


@query("block_misses", _BLOCKS + "SELECT block, g AS gold_total, g - tp AS misses, round(tp::DOUBLE / g, 9) AS recall FROM s WHERE g > 0")
def block_misses(spark, sf):
    return rounded(M.block_misses(pairs(spark, sf)).where("gold_total > 0").select("block", "gold_total", "misses", "recall"), "recall")


@query("block_false_positives", _BLOCKS + "SELECT block, p AS pred_total, p - tp AS false_positives, round(tp::DOUBLE / p, 9) AS precision FROM s WHERE p > 0")
def block_false_positives(spark, sf):
    return rounded(M.block_misses(pairs(spark, sf)).where("pred_total > 0").select("block", "pred_total", "false_positives", "precision"), "precision")


_CONF = ctes("eval_pred") + ", f AS (SELECT substr(gold_code, 1, 1) AS gold, coalesce(substr(pred_code, 1, 1), '(none)') AS pred, count(*) AS n FROM eval_pred GROUP BY 1, 2)\n"


def _confusion(spark, sf):
    e = view(spark, sf, "eval_pred").select(F.substring("gold_code", 1, 1).alias("g"), F.substring("pred_code", 1, 1).alias("p"))
    return M.confusion(e, "g", "p")


@query("confusion", _CONF + "SELECT * FROM f")
def confusion(spark, sf):
    return _confusion(spark, sf)


@query("top_confusions", _CONF + "SELECT * FROM f WHERE gold <> pred ORDER BY n DESC, gold, pred LIMIT 10")
def top_confusions(spark, sf):
    return M.top_confusions(_confusion(spark, sf), 10)


@query("per_class_accuracy", _CONF + "SELECT gold, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS BIGINT) AS correct, round(sum(CASE WHEN gold = pred THEN n ELSE 0 END)::DOUBLE / sum(n), 9) AS accuracy FROM f GROUP BY gold")
def per_class_accuracy(spark, sf):
    return rounded(M.per_class_accuracy(_confusion(spark, sf)), "accuracy")


@query("confusion_matrix", _CONF + "SELECT gold, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN pred = '{x}' THEN n END), 0) AS BIGINT) AS {x}" for x in "ABCDE") + " FROM f GROUP BY gold")
def confusion_matrix(spark, sf):
    e = view(spark, sf, "eval_pred").select(F.substring("gold_code", 1, 1).alias("g"), F.substring("pred_code", 1, 1).alias("p"))
    return M.confusion_matrix(e, "g", "p", list("ABCDE"))


@query("prefix_accuracy", ctes("eval_pred") + "SELECT source_id, count(*) AS n, round(avg(CASE WHEN substr(gold_code, 1, 1) = substr(pred_code, 1, 1) THEN 1 ELSE 0 END), 9) AS chapter_accuracy, round(avg(CASE WHEN substr(gold_code, 1, 5) = substr(pred_code, 1, 5) THEN 1 ELSE 0 END), 9) AS category_accuracy FROM eval_pred WHERE pred_code IS NOT NULL GROUP BY source_id")
def prefix_accuracy(spark, sf):
    return rounded(M.prefix_accuracy(view(spark, sf, "eval_pred"), "gold_code", "pred_code", ["source_id"]), "chapter_accuracy", "category_accuracy")


@query("cardinality_breakdown", RECORDS + "SELECT CAST(n_gold AS INTEGER) AS gold_size, count(*) AS n, round(avg(correct), 9) AS exact, round(avg(2.0::DOUBLE * tp / (n_gold + n_pred)), 9) AS mean_f1, count(*) FILTER (WHERE n_pred > n_gold) AS over, count(*) FILTER (WHERE n_pred < n_gold) AS under FROM eval_records GROUP BY n_gold")
def cardinality_breakdown(spark, sf):
    return rounded(M.cardinality_breakdown(pairs(spark, sf)), "exact")


@query("confidence_buckets", RECORDS + """, s AS (SELECT CASE WHEN score >= -5 THEN 'high' WHEN score >= -12 THEN 'medium' ELSE 'low' END AS bucket, correct, 2.0::DOUBLE * tp / (n_gold + n_pred) AS f FROM eval_records)
SELECT b.bucket, count(s.bucket) AS n, round(avg(correct), 9) AS exact_rate, round(avg(f), 9) AS mean_f1 FROM (VALUES ('high'), ('medium'), ('low'), ('other')) b(bucket) LEFT JOIN s ON b.bucket = s.bucket GROUP BY b.bucket""")
def confidence_buckets(spark, sf):
    r = view(spark, sf, "eval_records")
    bucket = F.when(F.col("score") >= -5, "high").when(F.col("score") >= -12, "medium").otherwise("low")
    return rounded(M.bucketed(r, bucket, ["high", "medium", "low", "other"], F.col("correct"), 2.0 * F.col("tp") / (F.col("n_gold") + F.col("n_pred"))), "exact_rate")


# A result log with costs, repeats and errors derived from the records.
_LOG = """SELECT record_id, source_id, correct, n_pred, record_id % 97 / 8.0 AS cost, record_id % 7 AS turns, record_id % 61 / 4.0 AS latency,
  CASE WHEN record_id % 13 = 0 THEN concat('request ', record_id % 3, ' failed after some time with code ', record_id) END AS error FROM {eval_records}"""
_LOGSQL = ctes("eval_records") + ", score_log AS (" + _LOG.replace("{", "").replace("}", "") + ")\n"


def score_log(spark, sf):
    return spark.sql(_LOG, eval_records=view(spark, sf, "eval_records"))


@query("error_breakdown", _LOGSQL + "SELECT array_to_string(list_slice(string_split(error, ' '), 1, 6), ' ') AS error, count(*) AS n FROM score_log WHERE error IS NOT NULL GROUP BY 1")
def error_breakdown(spark, sf):
    return M.error_breakdown(score_log(spark, sf), "error")


@query("cost_latency", _LOGSQL + "SELECT round(CAST(sum(cost) AS DOUBLE), 9) AS cost_total, round(CAST(avg(cost) AS DOUBLE), 9) AS cost_mean, CAST(max(cost) AS DOUBLE) AS cost_max, round(CAST(avg(latency) AS DOUBLE), 9) AS latency_mean, CAST(max(latency) AS DOUBLE) AS latency_max FROM score_log")
def cost_latency(spark, sf):
    log = score_log(spark, sf).withColumns({"cost": F.col("cost").cast("double"), "latency": F.col("latency").cast("double")})
    return rounded(M.cost_latency(log, "cost", "latency"), "cost_total", "cost_mean", "latency_mean")


@query("baseline_summary", _LOGSQL + ", long AS (SELECT record_id, source_id, code, is_gold, is_pred FROM eval_long UNION ALL SELECT record_id, 'overall', code, is_gold, is_pred FROM eval_long), f AS (" + _full("source_id", "long") + """), both_log AS (SELECT * FROM score_log UNION ALL SELECT * REPLACE ('overall' AS source_id) FROM score_log),
c AS (SELECT source_id, count(DISTINCT code) AS k FROM long WHERE is_pred = 1 GROUP BY source_id), l AS (
SELECT l.source_id, CAST(sum(correct) AS BIGINT) AS exact_matches, count(*) FILTER (WHERE n_pred = 0) AS no_answer, round(avg(CASE WHEN n_pred = 0 THEN 1 ELSE 0 END), 9) AS no_answer_rate, count(error) AS errors, round(avg(CASE WHEN error IS NULL THEN 0 ELSE 1 END), 9) AS error_rate,
 CAST(sum(record_id % 3) AS BIGINT) AS invalid_codes, round(avg(CASE WHEN record_id % 3 > 0 THEN 1 ELSE 0 END), 9) AS invalid_rate, round(CAST(sum(cost) AS DOUBLE), 6) AS cost_total, round(CAST(avg(cost) AS DOUBLE), 6) AS cost_mean, round(CAST(sum(latency) AS DOUBLE), 6) AS elapsed_total, round(CAST(avg(latency) AS DOUBLE), 6) AS elapsed_mean
FROM both_log l GROUP BY l.source_id) SELECT f.*, l.* EXCLUDE (source_id), c.k AS predicted_classes FROM f JOIN l ON f.source_id = l.source_id JOIN c ON f.source_id = c.source_id""")
def baseline_summary(spark, sf):
    log = score_log(spark, sf).select("record_id", F.col("cost").cast("double").alias("cost"), F.col("latency").cast("double").alias("latency"), "error")
    d = pairs(spark, sf).join(log, "record_id").withColumn("n_invalid", F.col("record_id") % 3)
    totals = ("cost_total", "cost_mean", "elapsed_total", "elapsed_mean")
    return allround(M.baseline_summary(d), *totals).withColumns({c: F.round(c, 6) for c in totals})


@query("per_source_accuracy", BOTH + """, r AS (SELECT slice, record_id, CASE WHEN sum(is_gold * is_pred) = sum(is_gold) AND sum(is_gold * is_pred) = sum(is_pred) THEN 1 ELSE 0 END AS hit FROM long GROUP BY 1, 2), a AS (SELECT slice, count(*) AS n, CAST(sum(hit) AS BIGINT) AS correct, round(avg(hit), 9) AS accuracy FROM r GROUP BY slice)
SELECT a.slice AS source_id, n, correct, accuracy, macro_f1 FROM a JOIN (SELECT slice, """ + _MACRO + " FROM (" + _PER.format("slice, ", "long") + ") c GROUP BY slice) m ON a.slice = m.slice")
def per_source_accuracy(spark, sf):
    return rounded(M.per_source_accuracy(pairs(spark, sf), "source_id"), "accuracy", "macro_f1")


@query("sample_failures", _LOGSQL + "SELECT record_id, source_id FROM score_log WHERE correct = 0 AND error IS NULL ORDER BY record_id LIMIT 20")
def sample_failures(spark, sf):
    return M.sample_failures(score_log(spark, sf), (F.col("correct") == 0) & F.col("error").isNull(), "record_id", 20).select("record_id", "source_id")


_TWO = _LOGSQL + """, two AS (SELECT record_id, source_id, 1 AS line, n_pred, CASE WHEN record_id % 26 = 0 THEN 1 ELSE 0 END AS n_invalid, cost, turns, error FROM score_log UNION ALL SELECT record_id, source_id, 2, 0, 0, cost + 1, turns, NULL FROM score_log WHERE record_id % 5 = 0
  UNION ALL SELECT record_id, source_id, 3, 0, CASE WHEN record_id % 2 = 0 THEN 1 ELSE 0 END, 0, 0, CASE WHEN record_id % 4 = 0 THEN 'Timeout' WHEN record_id % 4 = 1 THEN 'no JSON' ELSE 'gone' END FROM score_log WHERE record_id % 3 = 0),
k AS (SELECT *, error IS NOT NULL AND n_pred = 0 AND n_invalid = 0 AND cost <= 0 AND turns <= 0 AS gone FROM two)
"""


def _attempts(spark, sf):
    """A result log in which records occur again, later with no codes, and last with an error and nothing else."""
    none, bad = F.array().cast("array<string>"), F.array(F.lit("zz"))
    k = F.col("record_id") % 4
    own = {"codes": F.array_repeat(F.lit("x"), F.col("n_pred").cast("int")), "invalid_codes": F.when(F.col("record_id") % 26 == 0, bad).otherwise(none), "cost": F.col("cost").cast("double"), "turns": F.col("turns").cast("int"), "error": F.col("error"), "line": F.lit(1)}
    again = own | {"codes": none, "invalid_codes": none, "cost": own["cost"] + 1, "error": F.lit(None).cast("string"), "line": F.lit(2)}
    lost = own | {"codes": none, "invalid_codes": F.when(F.col("record_id") % 2 == 0, bad).otherwise(none), "cost": F.lit(0.0), "turns": F.lit(0), "error": F.when(k == 0, "Timeout").when(k == 1, "no JSON").otherwise("gone"), "line": F.lit(3)}
    row = lambda fields: F.struct(*[v.alias(c) for c, v in fields.items()])
    rows = F.array_compact(F.array(row(own), F.when(F.col("record_id") % 5 == 0, row(again)), F.when(F.col("record_id") % 3 == 0, row(lost))))
    log = score_log(spark, sf).select("record_id", "source_id", "correct", "n_pred", "latency", F.lit("").alias("raw"), F.explode(rows).alias("x"))
    return log.select("*", "x.*").drop("x")


@query("scrub_predictions", _TWO + ", r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN n_pred > 0 THEN 1 ELSE 0 END DESC, cost DESC, line) AS rn FROM k WHERE NOT gone) SELECT record_id, line FROM r WHERE rn = 1")
def scrub_predictions(spark, sf):
    return M.scrub(_attempts(spark, sf), "record_id", "line").select("record_id", "line")


@query("scrub_audit", _TWO + """, g AS (SELECT *, CASE WHEN lower(error) LIKE '%timeout%' THEN 'timeout' WHEN lower(error) LIKE '%json%' THEN 'unparseable_response' ELSE 'other' END AS reason FROM k WHERE gone),
t AS (SELECT count(*) AS lines, count(DISTINCT record_id) AS ids, count(DISTINCT CASE WHEN NOT gone THEN record_id END) AS kept FROM k)
SELECT 'total' AS kind, 'lines' AS key, lines AS n FROM t UNION ALL SELECT 'total', 'kept', kept FROM t UNION ALL SELECT 'total', 'dropped', lines - kept FROM t UNION ALL SELECT 'total', 'repeated', lines - ids FROM t
UNION ALL SELECT 'reason', reason, count(*) FROM g GROUP BY reason UNION ALL SELECT 'source', source_id, count(*) FROM g GROUP BY source_id""")
def scrub_audit(spark, sf):
    return M.scrub_audit(_attempts(spark, sf), "record_id")


@query("pending_only", _LOGSQL + "SELECT record_id FROM score_log WHERE error IS NOT NULL")
def pending_only(spark, sf):
    log = score_log(spark, sf)
    return L.pending(log.select("record_id"), log.where("error IS NULL"), "record_id")


# --- slices -----------------------------------------------------------------------------------------------------------
_SPLIT = LONG + ", rec AS (SELECT DISTINCT record_id, source_id, CASE WHEN record_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM eval_long), lg AS (SELECT e.*, rec.split FROM eval_long e JOIN rec ON e.record_id = rec.record_id)\n"


def _split(spark, sf):
    d = pairs(spark, sf)
    return d.where("record_id % 5 <> 0"), d.where("record_id % 5 = 0")


@query("source_transfer", _SPLIT + """, idx AS (SELECT DISTINCT code, source_id FROM lg WHERE split = 'train' AND is_gold = 1),
b AS (SELECT t.record_id, t.code, CASE WHEN NOT EXISTS (SELECT 1 FROM idx WHERE idx.code = t.code) THEN 'never' WHEN EXISTS (SELECT 1 FROM idx WHERE idx.code = t.code AND idx.source_id = t.source_id) THEN 'same_source' ELSE 'other_source' END AS bucket, t.is_pred
  FROM lg t WHERE split = 'test' AND is_gold = 1)
SELECT bucket, count(*) AS labels, count(DISTINCT record_id) AS records, round(avg(is_pred), 9) AS label_recall FROM b GROUP BY bucket""")
def source_transfer(spark, sf):
    train, test = _split(spark, sf)
    b = L.transfer_buckets(test, L.label_sources(train), "record_id").join(test.select("record_id", "pred"), "record_id")
    hit = F.array_contains("pred", F.col("code")).cast("int")
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.countDistinct("record_id").alias("records"), F.round(F.avg(hit), 9).alias("label_recall"))


_TESTLONG = ", tl AS (SELECT record_id, source_id, code, is_gold, is_pred FROM lg WHERE split = 'test')"


@query("source_transfer_metrics", _SPLIT + _TESTLONG + """, idx AS (SELECT DISTINCT code, source_id FROM lg WHERE split = 'train' AND is_gold = 1 AND NOT (source_id = '1-URGENT' AND code >= 'C') AND code < 'E'),
b AS (SELECT t.record_id, t.code, CASE WHEN NOT EXISTS (SELECT 1 FROM idx WHERE idx.code = t.code) THEN 'never' WHEN EXISTS (SELECT 1 FROM idx WHERE idx.code = t.code AND idx.source_id = t.source_id) THEN 'same_source' ELSE 'other_source' END AS bucket, t.is_pred FROM tl t WHERE is_gold = 1),
long AS (SELECT bucket, tl.record_id, tl.code, is_gold, is_pred FROM tl JOIN (SELECT DISTINCT record_id, bucket FROM b) d ON tl.record_id = d.record_id), f AS (""" + _with_blocks("bucket", "long") + """),
h AS (SELECT bucket, count(*) AS true_count, round(avg(is_pred), 9) AS recall FROM b GROUP BY bucket)
SELECT f.*, true_count, recall, round(n::DOUBLE / (SELECT count(DISTINCT record_id) FROM tl), 9) AS sample_rate FROM f JOIN h ON f.bucket = h.bucket""")
def source_transfer_metrics(spark, sf):
    train, test = _split(spark, sf)
    own = F.filter("gold", lambda c: ~((F.col("source_id") == "1-URGENT") & (c >= "C")) & (c < "E"))  # so that every bucket has rows
    return allround(L.source_transfer_metrics(test, train.withColumn("gold", own), "record_id", block=3))


@query("seen_unseen_metrics", _SPLIT + """, keys AS (SELECT record_id, split, min(code) FILTER (WHERE is_gold = 1) || ',' || max(code) FILTER (WHERE is_gold = 1) AS k FROM lg GROUP BY 1, 2),
m AS (SELECT record_id, EXISTS (SELECT 1 FROM keys t WHERE t.split = 'train' AND t.k = keys.k) AS seen FROM keys WHERE split = 'test'),
long AS (SELECT seen, lg.record_id, code, is_gold, is_pred FROM lg JOIN m ON lg.record_id = m.record_id), f AS (""" + _full("seen", "long") + ") SELECT f.*, round(n::DOUBLE / sum(n) OVER (), 9) AS string_rate FROM f")
def seen_unseen_metrics(spark, sf):
    train, test = _split(spark, sf)
    return allround(L.seen_unseen_metrics(test, train, F.concat_ws(",", F.array_min("gold"), F.array_max("gold"))))


@query("rare_slice", _SPLIT + """, c AS (SELECT code, count(*) AS n FROM lg WHERE split = 'train' AND is_gold = 1 GROUP BY code), k AS (SELECT CAST(floor(avg(n)) AS BIGINT) AS least FROM c),
r AS (SELECT DISTINCT record_id FROM lg LEFT JOIN c ON lg.code = c.code WHERE split = 'test' AND is_gold = 1 AND coalesce(n, 0) < (SELECT least FROM k)) SELECT record_id FROM r""")
def rare_slice(spark, sf):
    train, test = _split(spark, sf)
    least = train.select(F.explode("gold").alias("c")).agg(F.floor(F.count(F.lit(1)) / F.countDistinct("c"))).first()[0]
    return L.rare_slice(test, train, int(least), "record_id").select("record_id")


_DOC = ctes("doc_records")
_SEEN = _DOC + ", k AS (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS key FROM doc_records)\n"


@query("seen_unseen", _SEEN + "SELECT seen, count(*) AS n, count(DISTINCT label) AS labels, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS rate FROM (SELECT k.*, EXISTS (SELECT 1 FROM k t WHERE t.split = 'train' AND t.key = k.key) AS seen FROM k WHERE split = 'test') s GROUP BY seen")
def seen_unseen(spark, sf):
    d = view(spark, sf, "doc_records")
    m = L.mark_seen(d.where("split = 'test'"), d.where("split = 'train'"), S.squash_ws("text"))
    g = m.groupBy("seen").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))
    from pyspark.sql.window import Window

    return g.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@query("never_in_train", _DOC + "SELECT record_id FROM doc_records d WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM doc_records t WHERE t.split = 'train' AND lower(t.text) = lower(d.text))")
def never_in_train(spark, sf):
    d = view(spark, sf, "doc_records")
    return L.never_in(d.where("split = 'test'"), d.where("split = 'train'"), F.lower("text")).select("record_id")


@query("never_in_train_or_val", _DOC + "SELECT record_id FROM doc_records d WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM doc_records t WHERE t.split IN ('train', 'val') AND t.label = d.label)")
def never_in_train_or_val(spark, sf):
    d = view(spark, sf, "doc_records")
    return L.never_in(d.where("split = 'test'"), d.where("split = 'train'").unionByName(d.where("split = 'val'")), F.col("label")).select("record_id")


@query("holdout_leakage", _DOC + """, t AS (SELECT * FROM doc_records WHERE split = 'train'), h AS (SELECT * FROM doc_records WHERE split = 'test'),
m AS (SELECT h.*, EXISTS (SELECT 1 FROM t WHERE t.text = h.text) AS a, EXISTS (SELECT 1 FROM t WHERE t.text = h.text AND t.label = h.label) AS b, EXISTS (SELECT 1 FROM t WHERE t.label = h.label) AS c FROM h)
SELECT count(*) AS rows, count(*) FILTER (WHERE a) AS inputs_seen, count(*) FILTER (WHERE b) AS pairs_seen, count(*) AS labels, count(*) FILTER (WHERE c) AS labels_seen, count(DISTINCT label) AS classes, count(DISTINCT CASE WHEN c THEN label END) AS classes_seen,
 round(count(*) FILTER (WHERE a)::DOUBLE / count(*), 9) AS inputs_seen_rate, round(count(*) FILTER (WHERE b)::DOUBLE / count(*), 9) AS pairs_seen_rate, round(count(*) FILTER (WHERE c)::DOUBLE / count(*), 9) AS labels_seen_rate, round(count(DISTINCT CASE WHEN c THEN label END)::DOUBLE / count(DISTINCT label), 9) AS classes_seen_rate FROM m""")
def holdout_leakage(spark, sf):
    d = view(spark, sf, "doc_records").withColumn("y", F.array("label"))
    out = L.holdout_leakage(d.where("split = 'train'"), d.where("split = 'test'"), "text", "y")
    return rounded(out, "inputs_seen_rate", "pairs_seen_rate", "labels_seen_rate", "classes_seen_rate")


@query("string_leakage", _DOC + "SELECT count(DISTINCT text) AS test_strings, count(DISTINCT CASE WHEN s THEN text END) AS shared, round(count(DISTINCT CASE WHEN s THEN text END)::DOUBLE / count(DISTINCT text), 9) AS rate FROM (SELECT text, EXISTS (SELECT 1 FROM doc_records t WHERE t.split = 'train' AND t.text = d.text) AS s FROM doc_records d WHERE split = 'test') x")
def string_leakage(spark, sf):
    d = view(spark, sf, "doc_records")
    return rounded(L.string_leakage(d.where("split = 'train'"), d.where("split = 'test'"), "text"), "rate")


@query("unknown_labels", LONG + "SELECT code, count(*) AS n FROM eval_long WHERE is_gold = 1 AND substr(code, 7, 1) = '2' GROUP BY code")
def unknown_labels(spark, sf):
    return L.unknown_labels(pairs(spark, sf), "gold", view(spark, sf, "codebook"))


# --- selective prediction ----------------------------------------------------------------------------------------------
_CURVE = RECORDS + """, c AS (SELECT record_id, source_id, score, row_number() OVER (ORDER BY score DESC, record_id) AS rank, count(*) OVER () AS n, sum(correct) OVER (ORDER BY score DESC, record_id ROWS UNBOUNDED PRECEDING) AS hits FROM eval_records),
p AS (SELECT record_id, score, rank, n, rank::DOUBLE / n AS coverage, hits::DOUBLE / rank AS accuracy, 1 - hits::DOUBLE / rank AS risk FROM c)
"""


def _curve(spark, sf, by=()):
    return P.curve(view(spark, sf, "eval_records"), "score", "correct", "record_id", by)


@query("risk_coverage_full", _CURVE + "SELECT record_id, rank, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy, round(risk, 9) AS risk FROM p")
def risk_coverage_full(spark, sf):
    return rounded(_curve(spark, sf).select("record_id", "rank", "coverage", "accuracy", "risk"), "coverage", "accuracy", "risk")


@query("aurc", _CURVE + ", t AS (SELECT (risk + lag(risk) OVER (ORDER BY rank)) / 2 / n AS a FROM p) SELECT round(sum(a), 9) AS aurc FROM t")
def aurc(spark, sf):
    return P.aurc(_curve(spark, sf))


_COVER = (0.2, 0.5, 0.8, 0.9, 1.0)


@query("rc_curve", _CURVE + ", w AS (SELECT CAST(unnest([0.2, 0.5, 0.8, 0.9, 1.0]) AS DOUBLE) AS coverage), k AS (SELECT w.coverage, CASE WHEN w.coverage >= 1 THEN max(n) ELSE greatest(1, CAST(floor(w.coverage * max(n)) AS BIGINT)) END AS n_kept FROM w, p GROUP BY w.coverage) SELECT k.coverage, k.n_kept, CASE WHEN k.coverage < 1 THEN round(p.score, 9) END AS threshold, round(p.accuracy, 9) AS value FROM k JOIN p ON p.rank = k.n_kept")
def rc_curve(spark, sf):
    return rounded(P.rc_curve(_curve(spark, sf), _COVER), "threshold", "value")


@query("coverage_at_accuracy", _CURVE + "SELECT round(coalesce(max(CASE WHEN accuracy >= 0.5 THEN coverage END), 0), 9) AS coverage_at_50, round(coalesce(max(CASE WHEN accuracy >= 0.75 THEN coverage END), 0), 9) AS coverage_at_75 FROM p")
def coverage_at_accuracy(spark, sf):
    return rounded(P.coverage_at_accuracy(_curve(spark, sf), (0.5, 0.75)), "coverage_at_50", "coverage_at_75")


@query("accuracy_at_coverage", _CURVE + "SELECT round(arg_max(accuracy, CASE WHEN coverage <= 0.8 + 1e-12 THEN rank END), 9) AS accuracy_at_80, round(arg_max(accuracy, CASE WHEN coverage <= 0.9 + 1e-12 THEN rank END), 9) AS accuracy_at_90 FROM p")
def accuracy_at_coverage(spark, sf):
    return rounded(P.accuracy_at_coverage(_curve(spark, sf), (0.8, 0.9)), "accuracy_at_80", "accuracy_at_90")


@query("coverage_at_threshold", RECORDS + "SELECT source_id, round(avg(CASE WHEN score >= -10 THEN 1 ELSE 0 END), 9) AS coverage FROM eval_records GROUP BY source_id")
def coverage_at_threshold(spark, sf):
    return rounded(P.coverage_at_threshold(view(spark, sf, "eval_records"), "score", -10.0, ["source_id"]), "coverage")


_ECE = RECORDS + ", e AS (SELECT source_id, correct, 1 / (1 + exp(-(score + 10) / 4)) AS conf FROM eval_records), b AS (SELECT CAST(least(15, greatest(1, ceil(conf * 15))) AS INTEGER) AS bin, count(*) AS n, avg(conf) AS confidence, avg(correct) AS accuracy FROM e GROUP BY 1)\n"


def _confidence(spark, sf):
    return view(spark, sf, "eval_records").withColumn("conf", 1 / (1 + F.exp(-(F.col("score") + 10) / 4)))


@query("reliability", _ECE + "SELECT bin, n, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy FROM b")
def reliability(spark, sf):
    return rounded(P.reliability(_confidence(spark, sf), "conf", "correct"), "confidence", "accuracy")


@query("ece", _ECE + "SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 9) AS ece FROM b")
def ece(spark, sf):
    return P.ece(P.reliability(_confidence(spark, sf), "conf", "correct"))


def _grids(scores: str, by: str = "") -> str:
    """CTEs that narrow the temperature of table `scores` (by, s, y) in four grids of 100 steps; the last is `temps` (by, t)."""
    key, on = (f"{by}, ", f"e.{by} = b.{by}") if by else ("", "true")
    out = [f"b0 AS (SELECT DISTINCT {key}0.05::DOUBLE AS lo, 50.0::DOUBLE AS hi, true AS ok FROM {scores})"]
    for r in range(1, 5):
        prev = f"b{r - 1}"
        out.append(f"""v{r} AS (SELECT {key.replace(by, 'e.' + by) if by else ''}i, any_value(lo + (hi - lo) * i / 100) AS t, avg((1 / (1 + exp(least(700, -s / (lo + (hi - lo) * i / 100)))) - y) * s) AS g FROM {scores} e JOIN {prev} b ON {on} CROSS JOIN (SELECT unnest(range(101)) AS i) r WHERE ok GROUP BY {key.replace(by, 'e.' + by) if by else ''}i)""")
        part = f"PARTITION BY {by}" if by else ""
        out.append(f"f{r} AS (SELECT *, first_value(g) OVER ({part} ORDER BY i) AS g0, last_value(g) OVER ({part} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g1 FROM v{r})")
        out.append(f"a{r} AS (SELECT {key}max(i) AS spot FROM f{r} WHERE i < 100 AND g0 * g1 <= 0 AND (g0 * g > 0 OR i = 0) GROUP BY {by or 'ALL'})")
        same = f"f.{by} = a.{by} AND " if by else ""
        out.append(f"b{r} AS (SELECT {'a.' + by + ', ' if by else ''}max(CASE WHEN f.i = spot THEN t END) AS lo, max(CASE WHEN f.i = spot + 1 THEN t END) AS hi, true AS ok FROM a{r} a JOIN f{r} f ON {same}f.i IN (spot, spot + 1) GROUP BY {'a.' + by if by else 'ALL'})")
    out.append(f"temps AS (SELECT {'b0.' + by + ', ' if by else ''}coalesce(b4.lo + (b4.hi - b4.lo) / 2, 1.0) AS t FROM b0 LEFT JOIN b4 ON {'b0.' + by + ' = b4.' + by if by else 'true'})")
    return ", ".join(out)


@query("temperature_binary", RECORDS + ", e AS (SELECT CAST(score + 10 AS DOUBLE) AS s, correct AS y FROM eval_records), " + _grids("e") + " SELECT (SELECT count(*) FROM e) AS n, round(t, 3) AS temperature FROM temps")
def temperature_binary(spark, sf):
    d = view(spark, sf, "eval_records").withColumn("s", (F.col("score") + 10).cast("double"))
    t = P.fit_temperature_binary(d, "s", "correct")
    return d.agg(F.count(F.lit(1)).alias("n")).withColumn("temperature", F.round(F.lit(t), 3))


def _token_grids() -> str:
    """CTEs of five geometric grids of 16 temperatures; the loss is the mean negative log-likelihood of the gold place."""
    nll = "avg(ln(list_sum(list_transform(x, lambda v: exp(v / {t} - list_max(x) / {t})))) + list_max(x) / {t} - x[y + 1] / {t})"
    out = ["z0 AS (SELECT 0.05::DOUBLE AS lo, 50.0::DOUBLE AS hi)"]
    for r in range(1, 6):
        grid = "exp(ln(lo) + (ln(hi) - ln(lo)) * i / 15)"
        out.append(f"n{r} AS (SELECT i, t, {nll.format(t='t')} AS loss FROM e CROSS JOIN (SELECT i, {grid} AS t FROM z{r - 1}, (SELECT unnest(range(16)) AS i) r) g GROUP BY i, t)")
        out.append(f"m{r} AS (SELECT arg_min(i, (loss, i)) AS spot FROM n{r})")
        out.append(f"z{r} AS (SELECT max(CASE WHEN i = greatest(0, spot - 1) THEN t END) AS lo, max(CASE WHEN i = least(15, spot + 1) THEN t END) AS hi FROM n{r}, m{r})")
    out.append("best AS (SELECT sqrt(lo * hi) AS t FROM z5)")
    return ", ".join(out) + f" SELECT (SELECT count(*) FROM e) AS n, round(t, 3) AS temperature, (SELECT round({nll.format(t='1.0')}, 6) FROM e) AS before, (SELECT round({nll.format(t='b.t')}, 6) FROM e, best b) AS after FROM best"


@query("temperature_tokens", "WITH e AS (SELECT list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 10) AS x, label AS y FROM embeddings), " + _token_grids())
def temperature_tokens(spark, sf):
    d = table(spark, sf, "embeddings").withColumn("logits", F.transform("embedding", lambda x: x.cast("double") * 10))
    t, before, after = P.fit_temperature_tokens(d, "logits", "label")
    return d.agg(F.count(F.lit(1)).alias("n")).withColumns({"temperature": F.round(F.lit(t), 3), "before": F.round(F.lit(before), 6), "after": F.round(F.lit(after), 6)})


@query("sequence_signals", """SELECT vec_id, round(list_sum(lp), 6) AS sum_logprob, round(list_sum(lp) / len(lp), 6) AS mean_logprob, round(list_min(lp), 6) AS min_logprob, round(list_sum(e) / len(e), 6) AS mean_entropy, round(e[1], 6) AS first_entropy
FROM (SELECT vec_id, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))) AS lp, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS e FROM embeddings) s""")
def sequence_signals(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("lp"), F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("e"))
    names = ["sum_logprob", "mean_logprob", "min_logprob", "mean_entropy", "first_entropy"]
    return P.sequence_signals(d, "lp", "e").select("vec_id", *[F.round(c, 6).alias(c) for c in names])


_SIG = RECORDS + """, sig AS (SELECT record_id, correct, 'score' AS signal, CAST(score AS DOUBLE) AS s FROM eval_records UNION ALL SELECT record_id, correct, 'size_entropy', -CAST(n_pred AS DOUBLE) FROM eval_records),
c AS (SELECT signal, row_number() OVER w AS rank, count(*) OVER (PARTITION BY signal) AS n, sum(correct) OVER (PARTITION BY signal ORDER BY s DESC, record_id ROWS UNBOUNDED PRECEDING) AS hits FROM sig WINDOW w AS (PARTITION BY signal ORDER BY s DESC, record_id)),
p AS (SELECT signal, rank, n, rank::DOUBLE / n AS coverage, hits::DOUBLE / rank AS accuracy, 1 - hits::DOUBLE / rank AS risk FROM c)
"""


def _signals(spark, sf):
    return view(spark, sf, "eval_records").select("record_id", "correct", F.col("score").cast("double").alias("score"), F.col("n_pred").cast("double").alias("size_entropy"))


@query("rc_table", RECORDS + """, er AS (SELECT *, 2.0::DOUBLE * tp / (n_gold + n_pred) AS f FROM eval_records),
sig AS (SELECT record_id, correct, f, 'score' AS signal, CAST(score AS DOUBLE) AS s FROM er UNION ALL SELECT record_id, correct, f, 'size_entropy', -CAST(n_pred AS DOUBLE) FROM er),
m AS (SELECT record_id, signal, s, 'correct' AS metric, CAST(correct AS DOUBLE) AS x FROM sig UNION ALL SELECT record_id, signal, s, 'sample_f1', f FROM sig),
c AS (SELECT metric, signal, s, row_number() OVER w AS rank, count(*) OVER (PARTITION BY metric, signal) AS n, sum(x) OVER (PARTITION BY metric, signal ORDER BY s DESC, record_id ROWS UNBOUNDED PRECEDING) AS hits FROM m WINDOW w AS (PARTITION BY metric, signal ORDER BY s DESC, record_id))
SELECT metric, signal, CAST(k.cov AS DOUBLE) AS coverage, c.rank AS n_kept, round(hits / rank, 9) AS value, round(c.s, 9) AS threshold FROM c, (SELECT unnest([0.5, 0.8]) AS cov) k WHERE c.rank = greatest(1, CAST(floor(k.cov * c.n) AS BIGINT))""")
def rc_table(spark, sf):
    d = view(spark, sf, "eval_records")
    d = d.select("record_id", "correct", F.col("score").cast("double").alias("score"), F.col("n_pred").cast("double").alias("size_entropy"), (2.0 * F.col("tp") / (F.col("n_gold") + F.col("n_pred"))).alias("sample_f1"))
    return rounded(P.rc_table(d, ["score", "size_entropy"], ["correct", "sample_f1"], (0.5, 0.8), "record_id"), "value", "threshold")


@query("rc_metric", RECORDS + ", c AS (SELECT *, row_number() OVER (ORDER BY score DESC, record_id) AS rank, count(*) OVER () AS k FROM eval_records) SELECT CAST(cov AS DOUBLE) AS coverage, count(*) AS n_kept, round(2.0::DOUBLE * sum(tp) / (sum(n_gold) + sum(n_pred)), 9) AS value FROM c, (SELECT unnest([0.25, 0.5, 1.0]) AS cov) w WHERE rank <= CASE WHEN cov >= 1 THEN k ELSE greatest(1, CAST(floor(cov * k) AS BIGINT)) END GROUP BY cov")
def rc_metric(spark, sf):
    micro = 2.0 * F.sum("tp") / (F.sum("n_gold") + F.sum("n_pred"))
    return rounded(P.rc_metric(view(spark, sf, "eval_records"), "score", "record_id", micro, (0.25, 0.5, 1.0)), "value")


@query("signal_report", _SIG + ", t AS (SELECT signal, (risk + lag(risk) OVER (PARTITION BY signal ORDER BY rank)) / 2 / n AS a, coverage, accuracy FROM p), base AS (SELECT signal, round(sum(a), 9) AS aurc, round(coalesce(max(CASE WHEN accuracy >= 0.95 THEN coverage END), 0), 9) AS coverage_at_95, round(coalesce(max(CASE WHEN accuracy >= 0.99 THEN coverage END), 0), 9) AS coverage_at_99 FROM t GROUP BY signal), e AS (SELECT signal, s, correct AS y FROM sig), " + _grids("e", "signal") + """,
pr AS (SELECT e.signal, st.stage, 1 / (1 + exp(least(700, -s / CASE WHEN st.stage = 'raw' THEN 1.0 ELSE temps.t END))) AS p, y FROM e JOIN temps ON e.signal = temps.signal CROSS JOIN (VALUES ('raw'), ('cal')) st(stage)),
bins AS (SELECT signal, stage, least(15, greatest(1, ceil(p * 15))) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM pr GROUP BY 1, 2, 3), ec AS (SELECT signal, stage, sum(n * abs(acc - conf)) / sum(n) AS ece FROM bins GROUP BY 1, 2)
SELECT base.*, round((SELECT ece FROM ec WHERE ec.signal = base.signal AND stage = 'raw'), 6) AS ece_raw, round((SELECT ece FROM ec WHERE ec.signal = base.signal AND stage = 'cal'), 6) AS ece_calibrated, round(temps.t, 3) AS temperature FROM base JOIN temps ON base.signal = temps.signal""")
def signal_report(spark, sf):
    out = rounded(P.signal_report(_signals(spark, sf), ["score", "size_entropy"], "correct", "record_id"), "coverage_at_95", "coverage_at_99")
    return out.withColumns({"ece_raw": F.round("ece_raw", 6), "ece_calibrated": F.round("ece_calibrated", 6), "temperature": F.round("temperature", 3)})


@query("loso_report", RECORDS + """, sl AS (SELECT record_id, correct, source_id AS slice, score FROM eval_records UNION ALL SELECT record_id, correct, 'pooled', score FROM eval_records),
c AS (SELECT slice, correct, row_number() OVER w AS rank, count(*) OVER (PARTITION BY slice) AS n, sum(correct) OVER (PARTITION BY slice ORDER BY score DESC, record_id ROWS UNBOUNDED PRECEDING) AS hits FROM sl WINDOW w AS (PARTITION BY slice ORDER BY score DESC, record_id)),
p AS (SELECT slice, correct, rank, n, rank::DOUBLE / n AS coverage, hits::DOUBLE / rank AS accuracy, 1 - hits::DOUBLE / rank AS risk FROM c),
t AS (SELECT *, (risk + lag(risk) OVER (PARTITION BY slice ORDER BY rank)) / 2 / n AS a FROM p)
SELECT slice, count(*) AS n, round(avg(correct), 9) AS accuracy, round(sum(a), 9) AS aurc, round(arg_max(accuracy, CASE WHEN coverage <= 0.8 + 1e-12 THEN rank END), 9) AS accuracy_at_80, round(arg_max(accuracy, CASE WHEN coverage <= 0.9 + 1e-12 THEN rank END), 9) AS accuracy_at_90,
 round(coalesce(max(CASE WHEN accuracy >= 0.95 THEN coverage END), 0), 9) AS coverage_at_95, round(coalesce(max(CASE WHEN accuracy >= 0.99 THEN coverage END), 0), 9) AS coverage_at_99, round(avg(correct) - max(CASE slice WHEN '1-URGENT' THEN 0.2 WHEN '5-LOW' THEN 0.5 END::DOUBLE), 9) AS delta,
 CASE WHEN max(slice) NOT IN ('1-URGENT', '5-LOW') THEN NULL WHEN abs(avg(correct) - max(CASE slice WHEN '1-URGENT' THEN 0.2 WHEN '5-LOW' THEN 0.5 END::DOUBLE)) < 0.005 THEN 'MATCH' WHEN abs(avg(correct) - max(CASE slice WHEN '1-URGENT' THEN 0.2 WHEN '5-LOW' THEN 0.5 END::DOUBLE)) < 0.02 THEN 'CLOSE' ELSE 'DIFFER' END AS verdict FROM t GROUP BY slice""")
def loso_report(spark, sf):
    out = P.loso_report(view(spark, sf, "eval_records"), "source_id", "score", "correct", "record_id", {"1-URGENT": 0.2, "5-LOW": 0.5})
    return rounded(out, "accuracy", "accuracy_at_80", "accuracy_at_90", "coverage_at_95", "coverage_at_99", "delta")


# --- intervals -----------------------------------------------------------------------------------------------------------
_DRAW = "(CAST(('0x' || substr(md5(concat('333:', gkey, ':', r)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _poisson() -> str:
    """Poisson(1) by inversion, as the operator has it."""
    edge, out = 0.0, "CASE "
    for n in range(9):
        edge += math.exp(-1) / math.factorial(n)
        out += f"WHEN u < {edge!r} THEN {n} "
    return out + "ELSE 9 END"


@query("metric_intervals", RECORDS + f""", q AS (SELECT record_id, source_id, CAST(record_id % 97 AS VARCHAR) AS gkey, correct, n_gold, n_pred, tp, 2.0::DOUBLE * tp / (n_gold + n_pred) AS f FROM eval_records),
sg AS (SELECT source_id, gkey, sum(tp) AS tp, sum(n_gold) AS g, sum(n_pred) AS p, sum(correct) AS hits, sum(f) AS f, count(*) AS n FROM q GROUP BY source_id, gkey),
cg AS (SELECT source_id, CAST(record_id % 97 AS VARCHAR) AS gkey, code, sum(is_gold * is_pred) AS tp, sum(is_gold) AS g, sum(is_pred) AS p FROM eval_long GROUP BY 1, 2, 3),
u AS (SELECT gkey, r, CASE WHEN r = 0 THEN -1.0 ELSE {_DRAW} END AS u FROM (SELECT DISTINCT gkey FROM sg), (SELECT unnest(range(41)) AS r)),
w AS (SELECT gkey, r, CASE WHEN r = 0 THEN 1 ELSE {_poisson()} END AS w FROM u),
v AS (SELECT source_id, r, sum(w * hits) / sum(w * n) AS accuracy, 2 * sum(w * tp) / sum(w * (g + p)) AS micro_f1, sum(w * f) / sum(w * n) AS sample_f1 FROM (SELECT * REPLACE (CAST(hits AS DOUBLE) AS hits, CAST(tp AS DOUBLE) AS tp) FROM sg) JOIN w USING (gkey) WHERE w > 0 GROUP BY source_id, r),
m AS (SELECT source_id, r, avg(f) AS macro_f1 FROM (SELECT source_id, r, code, 2.0::DOUBLE * sum(w * tp) / sum(w * (g + p)) AS f FROM cg JOIN w USING (gkey) WHERE w > 0 GROUP BY source_id, r, code) GROUP BY source_id, r),
l AS (SELECT source_id, r, 'accuracy' AS figure, accuracy AS v FROM v UNION ALL SELECT source_id, r, 'micro_f1', micro_f1 FROM v UNION ALL SELECT source_id, r, 'sample_f1', sample_f1 FROM v UNION ALL SELECT source_id, r, 'macro_f1', macro_f1 FROM m)
SELECT source_id, figure, round(max(CASE WHEN r = 0 THEN v END), 9) AS value, round(quantile_cont(v, 0.025) FILTER (WHERE r > 0), 9) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE r > 0), 9) AS high FROM l GROUP BY source_id, figure""")
def metric_intervals(spark, sf):
    out = V.metric_intervals(pairs(spark, sf), F.col("record_id") % 97, 40, by=["source_id"])
    return rounded(out, "value", "low", "high")


@query("aurc_intervals", RECORDS + f""", q AS (SELECT record_id, nullif(source_id, '5-LOW') AS slice, CAST(record_id % 97 AS VARCHAR) AS gkey, correct, score FROM eval_records),
u AS (SELECT gkey, r, CASE WHEN r = 0 THEN -1.0 ELSE {_DRAW} END AS u FROM (SELECT DISTINCT gkey FROM q), (SELECT unnest(range(41)) AS r)),
w AS (SELECT gkey, r, CASE WHEN r = 0 THEN 1 ELSE {_poisson()} END AS w FROM u),
d AS (SELECT slice, r, record_id, correct, score, unnest(range(w)) AS copy FROM q JOIN w USING (gkey)),
c AS (SELECT slice, r, row_number() OVER k AS rank, count(*) OVER (PARTITION BY slice, r) AS n, sum(correct) OVER (PARTITION BY slice, r ORDER BY score DESC, record_id, copy ROWS UNBOUNDED PRECEDING) AS hits FROM d WINDOW k AS (PARTITION BY slice, r ORDER BY score DESC, record_id, copy)),
p AS (SELECT slice, r, rank, n, 1 - hits::DOUBLE / rank AS risk FROM c),
t AS (SELECT slice, r, (risk + lag(risk) OVER (PARTITION BY slice, r ORDER BY rank)) / 2 / n AS a FROM p),
v AS (SELECT slice, r, round(sum(a), 9) AS v FROM t GROUP BY slice, r)
SELECT slice, round(max(CASE WHEN r = 0 THEN v END), 7) AS value, round(quantile_cont(v, 0.025) FILTER (WHERE r > 0), 7) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE r > 0), 7) AS high FROM v GROUP BY slice""")
def aurc_intervals(spark, sf):
    out = V.aurc_intervals(_nulled(view(spark, sf, "eval_records")), "score", "correct", "record_id", F.col("record_id") % 97, 40, by=["slice"])
    return out.select("slice", *[F.round(c, 7).alias(c) for c in ("value", "low", "high")])


# --- slices of null ------------------------------------------------------------------------------------------------------
_NULLED = RECORDS + """, nl AS (SELECT record_id, nullif(source_id, '5-LOW') AS slice, code, is_gold, is_pred FROM eval_long),
nr AS (SELECT record_id, nullif(source_id, '5-LOW') AS slice, score, correct, n_gold, n_pred, tp FROM eval_records)
"""


def _nulled(d):
    return d.withColumn("slice", F.nullif("source_id", F.lit("5-LOW"))).drop("source_id")


@query("null_slice_metrics", _NULLED + """, k AS (SELECT slice, code, sum(is_gold * is_pred) AS tp, sum(is_gold) AS g, sum(is_pred) AS p FROM nl GROUP BY slice, code),
m AS (SELECT slice, count(*) AS classes, round(avg(2.0::DOUBLE * tp / (g + p)), 9) AS macro_f1 FROM k GROUP BY slice)
SELECT r.slice, count(*) AS n, round(avg(correct), 9) AS accuracy, round(2.0::DOUBLE * sum(tp) / (sum(n_gold) + sum(n_pred)), 9) AS micro_f1, max(classes) AS classes, max(macro_f1) AS macro_f1,
 round(sum(n_gold + n_pred - 2 * tp)::DOUBLE / count(*) / max(classes), 9) AS hamming_loss, round(avg(abs(n_gold - n_pred)), 9) AS count_mae, CAST(sum(correct) AS BIGINT) AS correct FROM nr r JOIN m ON r.slice IS NOT DISTINCT FROM m.slice GROUP BY r.slice""")
def null_slice_metrics(spark, sf):
    d = settled(_nulled(pairs(spark, sf)).select("slice", "gold", "pred"))  # read by all three
    figures = M.metric_set(d, ["slice"]).select("slice", "n", "accuracy", "micro_f1", "classes", "macro_f1")
    more = M.diagnostics(d, ["slice"]).select("slice", "hamming_loss", "count_mae")
    hits = M.per_source_accuracy(d, "slice").where("coalesce(slice, '') <> 'overall'").select("slice", "correct")
    return rounded(on_slices(on_slices(figures, more, ["slice"]), hits, ["slice"]), "accuracy", "micro_f1", "macro_f1", "hamming_loss", "count_mae")


@query("null_slice_curves", _NULLED + """, c AS (SELECT slice, row_number() OVER w AS rank, count(*) OVER (PARTITION BY slice) AS n, sum(correct) OVER (PARTITION BY slice ORDER BY score DESC, record_id ROWS UNBOUNDED PRECEDING) AS hits FROM nr WINDOW w AS (PARTITION BY slice ORDER BY score DESC, record_id)),
q AS (SELECT slice, rank, n, rank::DOUBLE / n AS coverage, hits::DOUBLE / rank AS accuracy, 1 - hits::DOUBLE / rank AS risk FROM c),
t AS (SELECT *, (risk + lag(risk) OVER (PARTITION BY slice ORDER BY rank)) / 2 / n AS a FROM q)
SELECT slice, round(sum(a), 9) AS aurc, round(arg_max(accuracy, CASE WHEN coverage <= 0.8 + 1e-12 THEN rank END), 9) AS accuracy_at_80, round(coalesce(max(CASE WHEN accuracy >= 0.5 THEN coverage END), 0), 9) AS coverage_at_50 FROM t GROUP BY slice""")
def null_slice_curves(spark, sf):
    points = P.curve(_nulled(view(spark, sf, "eval_records")), "score", "correct", "record_id", ["slice"])
    out = on_slices(P.aurc(points, ["slice"]), P.accuracy_at_coverage(points, (0.8,), ["slice"]), ["slice"])
    return rounded(on_slices(out, P.coverage_at_accuracy(points, (0.5,), ["slice"]), ["slice"]), "accuracy_at_80", "coverage_at_50")


@query("defer_or_accept", RECORDS + "SELECT record_id, CASE WHEN score >= -10 THEN 'accept' ELSE 'review' END AS decision FROM eval_records")
def defer_or_accept(spark, sf):
    return P.defer_or_accept(view(spark, sf, "eval_records"), "score", -10.0).select("record_id", "decision")


@query("defer_by_coverage", RECORDS + "SELECT record_id, CASE WHEN row_number() OVER (ORDER BY score DESC, record_id) <= greatest(1, CAST(floor(0.8 * count(*) OVER ()) AS BIGINT)) THEN 'accept' ELSE 'review' END AS decision FROM eval_records")
def defer_by_coverage(spark, sf):
    return P.defer_or_accept(view(spark, sf, "eval_records"), "score", coverage=0.8).select("record_id", "decision")
