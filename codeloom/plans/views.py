"""Derived views over the given tables, as portable SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "eval_lines": """SELECT o.o_orderkey AS record_id, o.o_orderpriority AS source_id, l.l_partkey AS pk, l.l_discount, l.l_tax, l.l_extendedprice,
  concat(substr('ABCDE', CAST(l.l_partkey % 5 AS INT) + 1, 1), lpad(CAST(CAST(floor(l.l_partkey / 5.0) AS BIGINT) % 7 AS STRING), 2, '0'), '.',
    CAST(CAST(floor(l.l_partkey / 35.0) AS BIGINT) % 2 AS STRING), lpad(CAST(CAST(floor(l.l_partkey / 70.0) AS BIGINT) % 3 AS STRING), 2, '0')) AS gold_code
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "eval_pred": """SELECT *, CASE WHEN l_tax >= 0.07 THEN NULL
    WHEN l_discount >= 0.08 THEN concat(substr('BCDEA', CAST(pk % 5 AS INT) + 1, 1), substr(gold_code, 2, 6))
    WHEN l_discount >= 0.06 THEN concat(substr(gold_code, 1, 4), '900') ELSE gold_code END AS pred_code FROM {eval_lines}""",
    "eval_long": """SELECT record_id, source_id, code, max(is_gold) AS is_gold, max(is_pred) AS is_pred FROM (
    SELECT record_id, source_id, gold_code AS code, 1 AS is_gold, 0 AS is_pred FROM {eval_pred}
    UNION ALL SELECT record_id, source_id, pred_code AS code, 0 AS is_gold, 1 AS is_pred FROM {eval_pred} WHERE pred_code IS NOT NULL) u GROUP BY record_id, source_id, code""",
    "eval_records": """SELECT r.record_id, r.source_id, r.n_gold, r.n_pred, r.tp, CASE WHEN r.tp = r.n_gold AND r.tp = r.n_pred THEN 1 ELSE 0 END AS correct, s.score
  FROM (SELECT record_id, source_id, sum(is_gold) AS n_gold, sum(is_pred) AS n_pred, sum(is_gold * is_pred) AS tp FROM {eval_long} GROUP BY record_id, source_id) r
  JOIN (SELECT record_id, -sum(CAST(round(l_discount * 100) AS BIGINT)) - max(l_extendedprice) / 1000000.0 AS score FROM {eval_pred} GROUP BY record_id) s ON r.record_id = s.record_id""",
    "doc_records": """SELECT CAST(d.doc_id AS STRING) AS record_id, d.source AS source_id, d.lang, d.text,
  concat(upper(substr(d.lang, 1, 1)), lpad(CAST(CAST(floor(d.n_chars / 250.0) AS BIGINT) % 100 AS STRING), 2, '0'), '.', CAST(coalesce(l.quality, 9) AS STRING), CAST(coalesce(l.toxic, 9) AS STRING), '0') AS label,
  CASE WHEN substr(md5(concat('333:', CAST(d.doc_id AS STRING))), 1, 2) < 'cd' THEN 'train' WHEN substr(md5(concat('333:', CAST(d.doc_id AS STRING))), 1, 2) < 'e6' THEN 'val' ELSE 'test' END AS split
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    # The code book: codes that don't end in 2; its first row of a code is the least record.
    "codebook": """SELECT code, min(record_id) AS "row", concat('cat ', substr(code, 1, 3)) AS category, concat('cause ', substr(code, 1, 5)) AS cause, concat('code ', code) AS description, concat('history ', substr(code, 1, 1)) AS histcat
  FROM {eval_long} WHERE substr(code, 7, 1) <> '2' GROUP BY code""",
    "transfer": """SELECT code AS old_code, concat(substr(code, 1, 6), '0') AS new_code FROM {eval_long} WHERE substr(code, 7, 1) = '2' AND substr(code, 1, 1) IN ('A', 'B', 'C') GROUP BY code""",
}
NEEDS = {"eval_lines": [], "eval_pred": ["eval_lines"], "eval_long": ["eval_lines", "eval_pred"], "eval_records": ["eval_lines", "eval_pred", "eval_long"], "doc_records": [], "codebook": ["eval_lines", "eval_pred", "eval_long"], "transfer": ["eval_lines", "eval_pred", "eval_long"]}
#: Tasks for each range that lines are read in: so a task of the join, and of what follows it by record, holds a bounded
#: part whatever the input. Without a number, small shuffled rows are put together into few tasks, whose lists are large.
TASKS = 4
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, wide: DataFrame | None = None, **given: DataFrame) -> DataFrame:
    """A derived view as a DataFrame; `wide` are the pairs to derive it from, if the caller has settled them, `given` frames in place of tables."""
    if name in WIDE:
        return WIDE[name](pairs(spark, sf_dir) if wide is None else wide)
    sql = VIEWS[name]
    names = {n for n in [*TABLES, *VIEWS] if "{" + n + "}" in sql}
    frames = {n: view(spark, sf_dir, n, wide, **given) if n in VIEWS else given[n] if n in given else table(spark, sf_dir, n) for n in names}
    if name == "eval_lines":
        n = TASKS * frames["lineitem"].select("l_orderkey").rdd.getNumPartitions()
        frames |= {t: frames[t].repartition(n, k) for t, k in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
    # DuckDB divides doubles; Spark would take 5.0 for a decimal, whose divisions take most of the time that codes take.
    sql = re.sub(r"(/ \d+\.0)\b", r"\1D", sql)
    return spark.sql(sql.replace('AS "row"', "AS `row`"), **frames)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, source_id, gold, pred, score): distinct sorted codes of each record, in one aggregation."""
    e = view(spark, sf_dir, "eval_pred")
    score = F.expr("-sum(CAST(round(l_discount * 100) AS BIGINT)) - max(l_extendedprice) / 1000000.0")
    return e.groupBy("record_id", "source_id").agg(F.sort_array(F.collect_set("gold_code")).alias("gold"), F.sort_array(F.collect_set("pred_code")).alias("pred"), score.alias("score"))


def _long(wide: DataFrame) -> DataFrame:
    flag = lambda c: F.array_contains(c, F.col("code")).cast("int")
    each = wide.select("record_id", "source_id", "gold", "pred", F.explode(F.array_union("gold", "pred")).alias("code"))
    return each.select("record_id", "source_id", "code", flag("gold").alias("is_gold"), flag("pred").alias("is_pred"))


def _records(wide: DataFrame) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    d = wide.withColumns({"n_gold": size("gold"), "n_pred": size("pred"), "tp": size(F.array_intersect("gold", "pred"))})
    correct = ((F.col("tp") == F.col("n_gold")) & (F.col("tp") == F.col("n_pred"))).cast("int")
    return d.select("record_id", "source_id", "n_gold", "n_pred", "tp", correct.alias("correct"), "score")


#: Views that Spark takes from the wide record frame, so that the join below them is made once.
WIDE = {"eval_long": _long, "eval_records": _records}


def ctes(*names: str) -> str:
    """WITH clause for DuckDB that defines the views and what they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS[n], n] if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{', '').replace('}', '')})" for n in order) + "\n"
