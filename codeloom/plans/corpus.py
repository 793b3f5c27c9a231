"""Queries on records and codes: canonicalisation, curation, splits, balancing, profiles, hierarchy, retrieval."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from codeloom.functions import scalars as S
from codeloom.operators import augment as A
from codeloom.operators import curate as C
from codeloom.operators import hierarchy as H
from codeloom.operators import profile as R
from codeloom.operators import retrieval as T
from codeloom.operators import scoring as O
from codeloom.operators import selective as P2
from codeloom.operators import splits as E
from codeloom.operators.ordering import settled, shared_folder
from codeloom.plans import prepare as P
from codeloom.plans.prepare import Plan, split_counts
from codeloom.plans.views import ctes, pairs, table, view
from codeloom.sources import files as I
from codeloom.sources import store
from codeloom.streaming.incremental import read_log, score_batch, score_stream

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


LONG, DOC = ctes("eval_long"), ctes("doc_records")
BOOK = ctes("codebook", "transfer")


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


# --- scalars -------------------------------------------------------------------------------------------------------------


@query("null_if_missing", "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 5 = 3 THEN NULL ELSE trim(event_type) END AS value FROM events")
def null_if_missing(spark, sf):
    v = F.when(F.col("event_id") % 5 == 0, " NaN ").when(F.col("event_id") % 5 == 3, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return table(spark, sf, "events").select("event_id", S.null_if_missing(v).alias("value"))


@query("format_age", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'unknown' WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', v), '0+$', '') END AS age FROM (SELECT event_id, (event_id % 1000) / 4.0::DOUBLE AS v FROM events) e""")
def format_age(spark, sf):
    v = F.when(F.col("event_id") % 4 == 0, F.lit("old")).otherwise(((F.col("event_id") % 1000) / 4).cast("string"))
    return table(spark, sf, "events").select("event_id", S.format_age(v).alias("age"))


@query("map_category", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' WHEN c_mktsegment = 'MACHINERY' THEN 'm' ELSE 'unknown' END AS value FROM customer")
def map_category(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.map_category("c_mktsegment", {"BUILDING": "b", "MACHINERY": "m"}).alias("value"))


@query("dots_to_spaces", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '([\p{L}\p{M}\p{N}_])\.([\p{L}\p{M}\p{N}_])', '\1 \2', 'g'), '([\p{L}\p{M}\p{N}_])\.([\p{L}\p{M}\p{N}_])', '\1 \2', 'g')) AS digest FROM documents")
def dots_to_spaces(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.dots_to_spaces("text").cast("binary"), 256).alias("digest"))


@query("build_text", "SELECT c_custkey, concat('cod: ', c_name, ' | age: ', CAST(c_nationkey AS VARCHAR), ' | sex: unknown') AS text FROM customer")
def build_text(spark, sf):
    fields = [("cod", F.col("c_name")), ("age", S.format_age(F.col("c_nationkey").cast("string"))), ("sex", F.lit(None).cast("string"))]
    return table(spark, sf, "customer").select("c_custkey", S.build_text(fields, "cod").alias("text"))


@query("render_request", "SELECT c_custkey, concat('cod: ', c_name, CASE WHEN c_nationkey > 10 THEN concat(' | age: ', CAST(c_nationkey AS VARCHAR)) ELSE '' END) AS text FROM customer")
def render_request(spark, sf):
    age = F.when(F.col("c_nationkey") > 10, F.col("c_nationkey").cast("string")).otherwise(S.UNKNOWN)
    return table(spark, sf, "customer").select("c_custkey", S.render_request([("cod", F.col("c_name")), ("age", age)]).alias("text"))


_RAW = "CASE WHEN pk % 7 = 0 THEN substr(gold_code, 1, 5) WHEN pk % 7 = 1 THEN concat(gold_code, '9') WHEN pk % 7 = 2 THEN lower(gold_code) ELSE gold_code END"


@query("normalise_code_shape", ctes("eval_lines") + f", r AS (SELECT record_id, pk, {_RAW} AS raw FROM eval_lines) SELECT record_id, pk, raw, CASE WHEN regexp_full_match(raw, '[A-Z][0-9]{{2}}\\.[0-9]+') THEN concat(substr(raw, 1, 4), rpad(substr(raw, 5, 3), 3, '0')) ELSE raw END AS code FROM r")
def normalise_code_shape(spark, sf):
    return view(spark, sf, "eval_lines").select("record_id", "pk", F.expr(_RAW).alias("raw")).withColumn("code", S.normalise_shape("raw"))


@query("coerce_codes", ctes("eval_lines") + """SELECT record_id, pk, concat(gold_code, ';', gold_code) AS codes FROM eval_lines""")
def coerce_codes(spark, sf):
    raw = F.when(F.col("pk") % 2 == 0, F.concat(F.lit("['"), "gold_code", F.lit("', '"), F.lower("gold_code"), F.lit("', 'none']"))).otherwise(F.concat(F.lit(" "), "gold_code", F.lit(", ,"), F.lower("gold_code"), F.lit(" ,NaN")))
    return view(spark, sf, "eval_lines").select("record_id", "pk", F.array_join(S.coerce_codes(raw), ";").alias("codes"))


@query("collect_codes", ctes("eval_pred") + "SELECT record_id, pk, CASE WHEN pred_code IS NULL THEN gold_code ELSE pred_code END AS codes FROM eval_pred")
def collect_codes(spark, sf):
    return view(spark, sf, "eval_pred").select("record_id", "pk", S.join_label(S.collect_codes([F.col("pred_code"), F.col("pred_code")], F.col("gold_code"))).alias("codes"))


@query("parse_predictions", ctes("eval_pred") + "SELECT record_id, pk, gold_code AS valid, 'bad' AS invalid, CAST(1 AS INTEGER) AS n_codes FROM eval_pred")
def parse_predictions(spark, sf):
    d = view(spark, sf, "eval_pred").withColumn("raw_output", F.concat(F.lit(" bad, "), "gold_code", F.lit(",")))
    d = O.decoded(d)
    return d.select("record_id", "pk", F.col("label").alias("valid"), F.from_json("invalid_codes", "array<string>")[0].alias("invalid"), "n_codes")


@query("extract_field", "SELECT c_custkey, c_name AS cod, c_mktsegment AS segment FROM customer")
def extract_field(spark, sf):
    t = F.concat(F.lit("cod: "), "c_name", F.lit(" | seg: "), "c_mktsegment", F.lit(" | seg: x"))
    return table(spark, sf, "customer").select("c_custkey", S.extract_field(t, "cod: ").alias("cod"), S.all_fields(t)["seg"].alias("segment"))


@query("group_key", "SELECT p_partkey, concat(lower(p_name), ' strasse fin e angstrom σ ss ø') AS key FROM part")
def group_key(spark, sf):
    accented = F.translate(F.translate("p_name", " ", "-"), "aeioun", "áèîöůñ")
    return table(spark, sf, "part").select("p_partkey", S.group_key(F.concat(F.lit("cod: "), accented, F.lit("; Straße ﬁn E\u0301__ÅNGSTRO\u0308M ς ẞ Ø | age: 3"))).alias("key"))


@query("filter_cardinality", LONG + "SELECT record_id, string_agg(code, ',' ORDER BY code) AS label FROM eval_long WHERE is_gold = 1 GROUP BY record_id HAVING count(*) <= 3")
def filter_cardinality(spark, sf):
    d = I.filter_cardinality(pairs(spark, sf).withColumnRenamed("gold", "y_codes"), 3)
    return d.select("record_id", S.join_label("y_codes").alias("label"))


@query("single_label_value", LONG + "SELECT record_id, CASE WHEN count(*) = 1 THEN min(code) END AS value FROM eval_long WHERE is_gold = 1 GROUP BY record_id")
def single_label_value(spark, sf):
    return pairs(spark, sf).select("record_id", S.single_label("gold").alias("value"))


@query("parent_codes", LONG + "SELECT code, substr(code, 1, 5) AS parent FROM eval_long WHERE is_gold = 1 GROUP BY code")
def parent_codes(spark, sf):
    return R.class_counts(pairs(spark, sf), F.col("gold")).select("code", S.parent_code("code").alias("parent"))


@query("parse_predictions_registry", BOOK + """SELECT record_id, string_agg(e.code, ',' ORDER BY e.code) FILTER (WHERE b.code IS NOT NULL) AS label, count(b.code) AS n_codes, count(*) - count(b.code) + 1 AS n_invalid
FROM eval_long e LEFT JOIN codebook b ON e.code = b.code WHERE is_gold = 1 GROUP BY record_id""")
def parse_predictions_registry(spark, sf):
    d = pairs(spark, sf).select("record_id", F.concat(F.array_join("gold", " , "), F.lit(",nonsense, ")).alias("raw_output"))
    d = O.decoded_in_registry(d, view(spark, sf, "codebook"), "record_id")
    return d.select("record_id", F.nullif("label", F.lit("")).alias("label"), F.col("n_codes").cast("long").alias("n_codes"), F.col("n_invalid").cast("long").alias("n_invalid"))


@query("batch_scores", "SELECT c_custkey, upper(c_name) AS raw_output FROM customer")
def batch_scores(spark, sf):
    return O.score(table(spark, sf, "customer").select("c_custkey", "c_name"), lambda texts: [t.upper() for t in texts], "c_name", 7).select("c_custkey", "raw_output")


@query("squash_ws", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM documents")
def squash_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.squash_ws("text").cast("binary"), 256).alias("digest"))


@query("expand_digraphs", "SELECT doc_id, sha256(" + "replace(" * 8 + "text, " + ", ".join(f"'{k}', '{v}')" for k, v in S.DIGRAPHS.items()) + ") AS digest FROM documents")
def expand_digraphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.expand_digraphs("text").cast("binary"), 256).alias("digest"))


@query("sanitise_key", "SELECT o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]', '_', 'g') AS key FROM orders")
def sanitise_key(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.sanitise_key(F.concat(F.lit(" "), "o_orderpriority", F.lit("!"))).alias("key"))


@query("preview", r"SELECT doc_id, CASE WHEN length(t) > 60 THEN concat(substr(t, 1, 57), '...') ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents) d")
def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.preview("text", 60).alias("preview"))


@query("parse_json_answers", "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN '' WHEN (conv_id + turn) % 11 = 0 THEN 'B00.100' ELSE concat('A01.', lpad(CAST(turn % 10 AS VARCHAR), 3, '0'), ',', 'C02.000') END AS codes FROM conversations")
def parse_json_answers(spark, sf):
    k = F.col("conv_id") + F.col("turn")
    code = F.concat(F.lit("A01."), F.lpad((F.col("turn") % 10).cast("string"), 3, "0"))
    fence = lambda body: F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```\ndone"))
    good = F.concat(fence(F.lit('{"codes": ["X00.000"]}')), F.lit(" and "), fence(F.concat(F.lit('{"codes": ["'), code, F.lit('", " C02.000"]}'))))
    raw = F.when(k % 7 == 0, fence(F.lit('{"codes": [broken'))).when(k % 11 == 0, F.lit('I say {"code": "B00.100"} then')).otherwise(good)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(S.parse_json_answers(raw), ",").alias("codes"))


@query("nested_answers", """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 4 THEN '' ELSE concat('A01.', lpad(CAST(turn % 10 AS VARCHAR), 3, '0')) END AS codes FROM conversations""")
def nested_answers(spark, sf):
    """Objects three deep, braces and quotes in strings, whole turns as strings, unclosed braces and quotes around."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    code = F.concat(F.lit("A01."), F.lpad((F.col("turn") % 10).cast("string"), 3, "0"))
    said = F.to_json(F.struct(F.repeat("text", 20).alias("why"), F.lit('a } " { b').alias("note")))
    deep = F.concat(F.lit('I think " that {"of": {"x": {"y": '), said, F.lit('}}, "codes": ["'), code, F.lit('"]} or {"code": "Z99.999"}'))
    loose = F.concat(F.lit('open { and "so" {"why": '), said, F.lit(', "code": "'), code, F.lit('"}'))
    escaped = F.concat(F.lit('{"t": "\\\\", "u": "\\"}", "codes": ["'), code, F.lit('"], "v": {"w": {}}}'))
    broken = F.lit('{"codes": [} {"code": {"a": ]}} {"nothing": {"codes": {}}')
    raw = F.when(k == 0, deep).when(k == 1, loose).when(k == 2, escaped).when(k == 3, F.concat(F.lit("}} "), deep)).otherwise(broken)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(S.parse_json_answers(raw), ",").alias("codes"))


@query("answers_by_shape", "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'C02.000' WHEN (conv_id + turn) % 3 = 1 THEN 'A01.000,B02.000' ELSE 'L09.100' END AS valid, CASE WHEN (conv_id + turn) % 3 = 1 THEN 'x1' ELSE '' END AS invalid FROM conversations")
def answers_by_shape(spark, sf):
    k = (F.col("conv_id") + F.col("turn")) % 3
    nested = F.lit('first {"codes": ["C02.000"], "why": {"of": 1}} then {"codes": ["Z99.999"]}')  # the first literal counts
    four = F.lit('```json\n{"codes": ["A01.000", " x1", "B02.000", "D04.000"], "code": "Z99.999"}\n```')  # three at most
    legacy = F.lit('```\n{"codes": [], "code": " L09.100 "}\n``` and ```json\n{"codes": [oops}\n```')
    d = table(spark, sf, "conversations").select("conv_id", "turn", S.by_shape(S.parse_json_answers(F.when(k == 0, nested).when(k == 1, four).otherwise(legacy))).alias("x"))
    return d.select("conv_id", "turn", F.array_join("x.valid", ",").alias("valid"), F.array_join("x.invalid", ",").alias("invalid"))


@query("is_real_source", "SELECT doc_id, source <> 'src0' AND source <> 'src1' AS is_real FROM documents")
def is_real_source(spark, sf):
    s = F.when(F.col("source") == "src0", "synthetic_x_multicod").when(F.col("source") == "src1", "masterlist_1").otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", S.is_real_source(s).alias("is_real"))


# --- curation ------------------------------------------------------------------------------------------------------------


@query("harmonise", BOOK + """, g AS (SELECT record_id, code FROM eval_long WHERE is_gold = 1), m AS (SELECT g.record_id, coalesce(t.new_code, g.code) AS code FROM g LEFT JOIN transfer t ON g.code = t.old_code),
k AS (SELECT m.*, c.code IS NOT NULL AS known FROM m LEFT JOIN codebook c ON m.code = c.code)
SELECT record_id, string_agg(DISTINCT code, ',' ORDER BY code) AS label FROM k GROUP BY record_id HAVING bool_and(known)""")
def harmonise(spark, sf):
    wide = settled(pairs(spark, sf).select("record_id", "source_id", "gold", "pred"))  # read for the records, the code book and the transfers
    transfer = C.assert_functional(settled(view(spark, sf, "transfer", wide)))
    d = wide.select("record_id", F.col("gold").alias("y_codes"))
    return C.harmonise(d, view(spark, sf, "codebook", wide), transfer).select("record_id", F.array_join(F.array_sort("y_codes"), ",").alias("label"))


@query("ambiguous_transfer", BOOK + ", t AS (SELECT * FROM transfer UNION ALL SELECT min(old_code), 'Z99.999' FROM transfer) SELECT old_code, string_agg(DISTINCT new_code, ',' ORDER BY new_code) AS targets FROM t GROUP BY old_code HAVING count(DISTINCT new_code) > 1")
def ambiguous_transfer(spark, sf):
    t = view(spark, sf, "transfer")
    both = t.unionByName(t.agg(F.min("old_code").alias("old_code")).withColumn("new_code", F.lit("Z99.999")))
    return C.ambiguous(both).select("old_code", F.array_join("targets", ",").alias("targets"))


SELECTING = (C.Rule("by_text", ("S04.000",), text="^[Dd]"), C.Rule("by_record", ("S05.000",), records=("1", "3", "7"), sources=("src1", "src3", "src7")), C.Rule("same", ("S06.000",), text="never there"))


@query("apply_rules_by_text", DOC + "SELECT record_id, CASE WHEN regexp_matches(substr(text, 1, 1), '[Dd]') THEN 'S04.000' WHEN record_id IN ('1', '3', '7') AND source_id IN ('src1', 'src3', 'src7') THEN 'S05.000' ELSE label END AS label FROM doc_records")
def apply_rules_by_text(spark, sf):
    d = view(spark, sf, "doc_records").select("record_id", "source_id", F.concat(F.lit("age: 3 | cod: "), F.translate("text", "|", "/"), F.lit(" | sex: D")).alias("text"), F.array("label").alias("y_codes"))
    return C.apply_rules(d, SELECTING).select("record_id", F.array_join("y_codes", ",").alias("label"))


RULES = (C.Rule("by_source", ("S01.000",), sources=("1-URGENT",), blocks=("A00", "A01")), C.Rule("by_code", ("S02.000", "S02.100"), old_codes=("B00.000",)), C.Rule("by_block", ("S03.000",), blocks=("A00", "B00")))


@query("apply_rules", LONG + """, r AS (SELECT record_id, source_id, string_agg(code, ',' ORDER BY code) AS label, bool_or(substr(code, 1, 3) IN ('A00', 'A01')) AS a, bool_or(code = 'B00.000') AS b, bool_or(substr(code, 1, 3) IN ('A00', 'B00')) AS c FROM eval_long WHERE is_gold = 1 GROUP BY record_id, source_id)
SELECT record_id, CASE WHEN source_id = '1-URGENT' AND a THEN 'S01.000' WHEN b THEN 'S02.000,S02.100' WHEN c THEN 'S03.000' ELSE label END AS label, CASE WHEN source_id = '1-URGENT' AND a THEN 'by_source' WHEN b THEN 'by_code' WHEN c THEN 'by_block' END AS rule FROM r""")
def apply_rules(spark, sf):
    d = pairs(spark, sf).select("record_id", "source_id", F.col("gold").alias("y_codes"))
    return C.apply_rules(d, RULES).select("record_id", F.array_join("y_codes", ",").alias("label"), "rule")


@query("apply_overrides", DOC + "SELECT record_id, CASE WHEN CAST(record_id AS BIGINT) % 50 = 0 THEN 'Z00.000,Y11.100' ELSE label END AS label, CASE WHEN CAST(record_id AS BIGINT) % 50 = 0 THEN 'Z00.000;Y11.100' ELSE label END AS codes FROM doc_records")
def apply_overrides(spark, sf):
    d = view(spark, sf, "doc_records").select("source_id", "record_id", "label", F.array("label").alias("y_codes"))
    o = d.where("CAST(record_id AS BIGINT) % 50 = 0").select("source_id", "record_id", F.col("label").alias("old_label"), F.lit("Z00.000,Y11.100").alias("new_label"))
    return C.apply_overrides(d, o).select("record_id", "label", F.array_join("y_codes", ";").alias("codes"))


@query("override_mismatches", DOC + "SELECT record_id, label FROM doc_records WHERE CAST(record_id AS BIGINT) % 100 = 0")
def override_mismatches(spark, sf):
    d = view(spark, sf, "doc_records").select("source_id", "record_id", "label")
    o = d.where("CAST(record_id AS BIGINT) % 50 = 0").withColumn("old_label", F.when(F.col("record_id").cast("long") % 100 == 0, "wrong").otherwise(F.col("label")))
    return C.override_mismatches(d, o.drop("label")).select("record_id", "label")


# --- splits --------------------------------------------------------------------------------------------------------------
_U = "(CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
_SIZES = {"train": 0.8, "val": 0.1, "test": 0.1}


@query("hash_split", f"SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {_U.format("concat('333:', doc_id)")} AS u FROM documents) d")
def hash_split(spark, sf):
    return E.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", _SIZES)


@query("grouped_split", f"SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {_U.format("concat('333:', lower(text))")} AS u FROM documents) d")
def grouped_split(spark, sf):
    return E.grouped_split(table(spark, sf, "documents"), F.lower("text"), _SIZES).select("doc_id", "split")


@query("group_leak_check", DOC + "SELECT md5(text) AS \"group\" FROM doc_records GROUP BY text HAVING bool_or(split = 'train') AND bool_or(split <> 'train')")
def group_leak_check(spark, sf):
    return E.group_leaks(view(spark, sf, "doc_records"), F.md5(F.col("text").cast("binary")))


@query("fraction_sample", "SELECT doc_id FROM documents ORDER BY md5(concat('333:', doc_id)), doc_id LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) FROM documents)")
def fraction_sample(spark, sf):
    return E.sample_fraction(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1)


@query("single_label_sample", LONG + ", r AS (SELECT record_id FROM eval_long WHERE is_gold = 1 GROUP BY record_id HAVING count(*) = 1) SELECT record_id FROM r ORDER BY md5(concat('333:', record_id)), record_id LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.05, 0) AS BIGINT)) FROM r)")
def single_label_sample(spark, sf):
    return E.single_label_sample(pairs(spark, sf), "record_id", "gold", 0.05).select("record_id")


@query("stable_batch", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('333:', doc_id)), doc_id) AS r FROM documents) d WHERE r > 50 AND r <= 150")
def stable_batch(spark, sf):
    return E.stable_batch(table(spark, sf, "documents").select("doc_id"), "doc_id", 50, 100)


@query("null_stratum_sample", "SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY md5(concat('333:', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY s) AS n FROM (SELECT doc_id, nullif(nullif(source, 'src0'), 'src1') AS s FROM documents) e) d WHERE r <= round_even(n * 0.3, 0)")
def null_stratum_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.nullif(F.nullif("source", F.lit("src0")), F.lit("src1")).alias("s"))
    return E.stratified_sample(d, "s", "doc_id", 0.3)


@query("stratified_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('333:', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) d WHERE r <= round_even(n * 0.1, 0)")
def stratified_sample(spark, sf):
    return E.stratified_sample(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 0.1)


@query("split_source_check", DOC + ", s AS (SELECT source_id, CASE WHEN source_id IN ('src1', 'src2') AND split = 'test' THEN 'holdout' ELSE split END AS split FROM doc_records) SELECT split, source_id, count(*) AS n FROM s WHERE (split <> 'holdout' AND source_id IN ('src1', 'src3')) OR (split = 'holdout' AND source_id <> 'src1') GROUP BY 1, 2")
def split_source_check(spark, sf):
    d = view(spark, sf, "doc_records").withColumn("split", F.when(F.col("source_id").isin("src1", "src2") & (F.col("split") == "test"), "holdout").otherwise(F.col("split")))
    return E.source_violations(d, ["src3"], "src1")


@query("min_frequency", DOC + "SELECT record_id FROM doc_records WHERE label IN (SELECT label FROM doc_records WHERE split = 'train' GROUP BY label HAVING count(*) >= 5)")
def min_frequency(spark, sf):
    d = view(spark, sf, "doc_records").withColumn("y", F.array("label"))
    return E.min_frequency(d, "record_id", "y", 5, F.col("split") == "train").select("record_id")


@query("min_frequency_codes", LONG + """, c AS (SELECT code, count(*) AS n FROM eval_long WHERE is_gold = 1 AND record_id % 5 <> 0 GROUP BY code), k AS (SELECT code FROM c WHERE n >= (SELECT floor(avg(n)) FROM c))
SELECT record_id, string_agg(code, ',' ORDER BY code) AS label FROM eval_long WHERE is_gold = 1 AND code IN (SELECT code FROM k) GROUP BY record_id""")
def min_frequency_codes(spark, sf):
    d, train = pairs(spark, sf), F.expr("record_id % 5 <> 0")
    least = R.class_counts(d.where(train), F.col("gold")).agg(F.floor(F.avg("n"))).first()[0]
    return E.min_frequency(d, "record_id", "gold", int(least), train).select("record_id", F.array_join("gold", ",").alias("label"))


@query("holdout_eval_sample", "SELECT doc_id FROM documents WHERE source = 'src5' ORDER BY md5(concat('333:', doc_id)), doc_id LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.25, 0) AS BIGINT)) FROM documents WHERE source = 'src5')")
def holdout_eval_sample(spark, sf):
    _, held = E.partition_holdout(table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id")), "src5")
    return E.holdout_eval_sample(held, "doc_id", 0.25).select("doc_id")


@query("batch_ledger", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('333:', doc_id)), doc_id) AS r FROM documents) d WHERE r <= 150")
def batch_ledger(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    first = E.ledger(d.limit(0), E.stable_batch(d, "doc_id", 0, 100), "doc_id")
    return E.ledger(first, E.stable_batch(d, "doc_id", 50, 100), "doc_id")


@query("select_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 3, 1, 5)")
def select_ids(spark, sf):
    return E.select_ids(table(spark, sf, "orders"), [7, 3, 1, 5, -1], "o_orderkey").select("o_orderkey", "o_totalprice")


_POISSON = "CASE " + " ".join(f"WHEN u < {sum(math.exp(-1) / math.factorial(j) for j in range(n + 1))!r} THEN {n}" for n in range(9)) + " ELSE 9 END"


@query("bootstrap", f"""WITH g AS (SELECT source AS g, CAST(sum(n_chars) AS DOUBLE) AS s, count(n_chars) AS n FROM documents GROUP BY source), e AS (SELECT g, s, n, r, {{u}} AS u FROM g CROSS JOIN (SELECT unnest(range(1, 41)) AS r) k),
m AS (SELECT r, sum(({_POISSON}) * s) / sum(({_POISSON}) * n) AS m FROM e GROUP BY r) SELECT round((SELECT sum(s) / sum(n) FROM g), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""".replace("{u}", _U.format("concat('333:', g, ':', r)")))
def bootstrap(spark, sf):
    out = E.bootstrap(table(spark, sf, "documents"), F.col("source"), F.col("n_chars"), 40)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("take_reference_order", "SELECT doc_id FROM documents WHERE source <> 'src0' ORDER BY CASE WHEN doc_id % 3 = 0 THEN 1000000000 - doc_id END NULLS LAST, doc_id LIMIT 100")
def take_reference_order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").withColumn("line", F.col("doc_id"))
    order = d.where("doc_id % 3 = 0").select("doc_id", (F.lit(1000000000) - F.col("doc_id")).alias("position"))
    return E.take_by_reference(d.unionByName(d.withColumn("line", F.col("line") + 1)), order, "doc_id", "line", 100, "src0", "source").select("doc_id")


@query("kfold", f"SELECT doc_id, CAST(floor({_U.format("concat('333:', source)")} * 5) AS INTEGER) AS fold FROM documents")
def kfold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.kfold(F.col("source"), 5).alias("fold"))


@query("holdout_partition", "SELECT doc_id, source = 'src5' AS held FROM documents WHERE source <> 'src6'")
def holdout_partition(spark, sf):
    d = E.exclude_sources(table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id")), ["src6"])
    rest, held = E.partition_holdout(d, "src5")
    return rest.select("doc_id", F.lit(False).alias("held")).unionByName(held.select("doc_id", F.lit(True).alias("held")))


# --- balancing -----------------------------------------------------------------------------------------------------------
_TARGETS = DOC + """, c AS (SELECT label, count(*) AS n FROM doc_records GROUP BY label), f AS (SELECT label, n, greatest(n, CAST(round_even(10 * (1 - 0.3 * ln(1 + (1 - (least(n, 10) - 1) / 9.0::DOUBLE)) / ln(2.0::DOUBLE)), 0) AS BIGINT)) AS target FROM c WHERE n < 10), g AS (SELECT * FROM f WHERE target > n)
"""


def _targets(spark, sf):
    d = view(spark, sf, "doc_records")
    return d, A.floor_targets(d.groupBy("label").agg(F.count(F.lit(1)).alias("n")), 10, 0.3)


@query("floor_targets", _TARGETS + "SELECT label, n, target FROM g")
def floor_targets(spark, sf):
    return _targets(spark, sf)[1]


@query("upsample_counts", _TARGETS + """, r AS (SELECT record_id, g.label, n, target - n AS need, row_number() OVER (PARTITION BY g.label ORDER BY md5(concat('333:', record_id)), record_id) AS k FROM doc_records d JOIN g ON d.label = g.label)
SELECT record_id, label, CAST(need // n + CASE WHEN k <= need % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r WHERE need // n + CASE WHEN k <= need % n THEN 1 ELSE 0 END > 0""")
def upsample_counts(spark, sf):
    d, t = _targets(spark, sf)
    return A.copies(d, t, "label", "record_id").groupBy("record_id", "label").agg(F.count(F.lit(1)).alias("copies"))


# Copies with their numbers, and whether a copy is perturbed.
_COPIES = _TARGETS + """, r AS (SELECT record_id, g.label, n, target, target - n AS need, row_number() OVER (PARTITION BY g.label ORDER BY md5(concat('333:', record_id)), record_id) AS k FROM doc_records d JOIN g ON d.label = g.label),
x AS (SELECT record_id, label, n, target, unnest(range(1, need // n + CASE WHEN k <= need % n THEN 1 ELSE 0 END + 1)) AS copy FROM r), y AS (SELECT *, """ + _U.format("concat('333:p:', record_id, ':', copy)") + """ < 1 - n / target::DOUBLE AS perturbed FROM x)
"""


@query("upsample", _COPIES + "SELECT label, count(*) AS n, count(*) FILTER (WHERE synthetic) AS synthetic, count(*) FILTER (WHERE perturbed) AS perturbed FROM (SELECT label, true AS synthetic, perturbed FROM y UNION ALL SELECT label, false, false FROM doc_records) u GROUP BY label")
def upsample(spark, sf):
    d, t = _targets(spark, sf)
    return A.upsample(d, t, "label", "record_id", "text").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("synthetic"), F.count_if("perturbed").alias("perturbed"))


@query("before_after_counts", _TARGETS + "SELECT c.label, c.n AS before, coalesce(g.target, c.n) AS after, coalesce(g.target, c.n) - c.n AS delta FROM c LEFT JOIN g ON c.label = g.label")
def before_after_counts(spark, sf):
    d, t = _targets(spark, sf)
    return R.before_after(d, d.select("label").unionByName(A.copies(d, t, "label", "record_id").select("label")), "label")


@query("balance_report", _TARGETS + """, a AS (SELECT 'before' AS stage, n FROM c UNION ALL SELECT 'after', coalesce(g.target, c.n) FROM c LEFT JOIN g ON c.label = g.label)
SELECT stage, CAST(sum(n) AS BIGINT) AS rows, count(*) AS classes, min(n) AS least, median(n) AS median, max(n) AS most FROM a GROUP BY stage""")
def balance_report(spark, sf):
    d, t = _targets(spark, sf)
    return P.balance_report(d.select("label"), d.select("label").unionByName(A.copies(d, t, "label", "record_id").select("label")))


@query("prep_summary", _COPIES + "SELECT (SELECT count(*) FROM doc_records) + count(*) AS rows, count(*) AS synthetic, count(*) FILTER (WHERE perturbed) AS perturbed, CAST(0 AS BIGINT) AS injected, (SELECT count(*) FROM doc_records) AS real FROM y")
def prep_summary(spark, sf):
    d, t = _targets(spark, sf)
    return R.prep_summary(A.upsample(d, t, "label", "record_id", "text").withColumn("injected", F.lit(False)))


@query("analytic_upsample", LONG + ", r AS (SELECT record_id, string_agg(code, ',' ORDER BY code) AS label, count(*) AS k FROM eval_long WHERE is_gold = 1 GROUP BY record_id), c AS (SELECT label, k, count(*) AS n FROM r GROUP BY label, k) SELECT CAST(k AS INTEGER) AS labels, CAST(sum(n) AS BIGINT) AS before, CAST(sum(greatest(n, 20)) AS BIGINT) AS after, count(*) FILTER (WHERE n < 20) AS classes_below FROM c GROUP BY k")
def analytic_upsample(spark, sf):
    return R.analytic_upsample(pairs(spark, sf).select(F.array_join("gold", ",").alias("label")), "label", ",", 20)


@query("shuffle_label_order", LONG + "SELECT record_id, string_agg(code, ',' ORDER BY md5(concat('333:', record_id, ':', code))) AS label FROM eval_long WHERE is_gold = 1 GROUP BY record_id")
def shuffle_label_order(spark, sf):
    return A.shuffle_labels(pairs(spark, sf).withColumnRenamed("gold", "y_codes"), "record_id", "y_codes").select("record_id", "label")


@query("perturb_fraction")
def perturb_fraction(spark, sf):
    return A.perturb_fraction(view(spark, sf, "doc_records"), "record_id", "text", 0.2, mean=0.02).select("record_id", "perturbed", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _step_sql() -> str:
    """One perturbation of acc in SQL; z is the step's number, k the row's key."""
    u = lambda tag: _U.format(f"concat(k, ':', z, ':{tag}')")
    at = lambda n: f"CAST(floor({u('p')} * ({n})) AS BIGINT)"
    swap = f"CASE WHEN length(acc) < 2 THEN acc ELSE concat(substr(acc, 1, {at('length(acc) - 1')}), substr(acc, {at('length(acc) - 1')} + 2, 1), substr(acc, {at('length(acc) - 1')} + 1, 1), substr(acc, {at('length(acc) - 1')} + 3)) END"
    delete = f"concat(substr(acc, 1, {at('length(acc)')}), substr(acc, {at('length(acc)')} + 2))"
    space = f"concat(substr(acc, 1, {at('length(acc) + 1')}), ' ', substr(acc, {at('length(acc) + 1')} + 1))"

    def exchange(kinds: dict[str, str]) -> str:
        names = "[" + ", ".join(f"'{c}'" for c in kinds) + "]"
        places = f"list_filter(range(1, length(acc) + 1), lambda i: list_contains({names}, substr(acc, i, 1)))"
        place = f"({places})[{at('len(' + places + ')')} + 1]"
        new = f"map([{', '.join(repr(c) for c in kinds)}], [{', '.join(repr(v) for v in kinds.values())}])[substr(acc, {place}, 1)]"
        return f"CASE WHEN len({places}) = 0 THEN acc ELSE concat(substr(acc, 1, {place} - 1), substr({new}, CAST(floor({u('c')} * length({new})) AS BIGINT) + 1, 1), substr(acc, {place} + 1)) END"

    keys = A.NEIGHBOURS | {a.upper(): b.upper() for a, b in A.NEIGHBOURS.items()}
    forms = [swap, delete, space, exchange(A.ACCENTS), exchange(keys)]
    pick = f"CAST(floor({u('f')} * {len(forms)}) AS BIGINT)"
    return f"CASE {pick} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " ELSE acc END"


@query("perturbed_names", f"""WITH RECURSIVE p AS (SELECT p_partkey, p_name AS t, concat('333:', p_partkey) AS k, {_U.format("concat('333:f:', p_partkey)")} < 0.5 AS chosen FROM part),
n AS (SELECT *, CASE WHEN chosen THEN greatest(1, least(length(t), CAST(round_even(length(t) * 0.2, 0) AS INTEGER))) ELSE 0 END AS steps FROM p),
r AS (SELECT p_partkey, k, chosen, steps, 0 AS z0, t AS acc FROM n UNION ALL SELECT p_partkey, k, chosen, steps, z, {_step_sql()} FROM (SELECT *, z0 + 1 AS z FROM r WHERE z0 < steps) q)
SELECT p_partkey, chosen AS perturbed, acc AS name FROM r WHERE z0 = steps""")
def perturbed_names(spark, sf):
    return A.perturb_fraction(table(spark, sf, "part"), "p_partkey", "p_name", 0.5, mean=0.2).select("p_partkey", "perturbed", F.col("p_name").alias("name"))


_V = lambda key: _U.format(f"concat('333:{key}')")
_SYNTH = DOC + f""", s AS (SELECT record_id, source_id AS g, label AS l, text AS t, md5(concat('333:', record_id)) AS h FROM doc_records),
l0 AS (SELECT g, l, count(*) AS of FROM s GROUP BY g, l), l1 AS (SELECT g, l, of, count(*) OVER (PARTITION BY g) AS labels, row_number() OVER (PARTITION BY g ORDER BY md5(concat('333:', l)), l) - 1 AS no FROM l0), lab AS (SELECT * FROM l1 WHERE labels > 1),
able AS (SELECT row_number() OVER (ORDER BY h, record_id) AS row, s.g, x.labels FROM s JOIN (SELECT DISTINCT g, labels FROM lab) x ON s.g = x.g),
n AS (SELECT greatest(1, CAST(round_even(count(*) * 0.5, 0) AS BIGINT)) AS n FROM s), d0 AS (SELECT unnest(range(n)) AS draw FROM n),
d1 AS (SELECT draw, g, labels, least(3, labels) AS most FROM d0 JOIN able ON able.row = CAST(floor({_V("g:', draw, '")} * (SELECT count(*) FROM able)) AS BIGINT) + 1),
d2 AS (SELECT *, 2 + CAST(floor({_V("n:', draw, '")} * (most - 1)) AS BIGINT) AS want FROM d1),
d3 AS (SELECT *, CAST(floor({_V("l:', draw, ':1")} * (labels - want + 1)) AS BIGINT) AS a, CAST(floor({_V("l:', draw, ':2")} * (labels - want + 2)) AS BIGINT) AS b0, CAST(floor({_V("l:', draw, ':3")} * (labels - want + 3)) AS BIGINT) AS c0 FROM d2),
d4 AS (SELECT *, CASE WHEN b0 = a THEN labels - want + 1 ELSE b0 END AS b FROM d3), d5 AS (SELECT *, CASE WHEN c0 = a OR c0 = b THEN labels - want + 2 ELSE c0 END AS c FROM d4),
pk AS (SELECT draw, g, a AS no FROM d5 UNION ALL SELECT draw, g, b FROM d5 UNION ALL SELECT draw, g, c FROM d5 WHERE want > 2),
ch AS (SELECT draw, pk.g, l, CAST(floor({_V("r:', draw, ':', pk.no, '")} * of) AS BIGINT) + 1 AS rank, md5(concat('333:o:', draw, ':', pk.no)) AS slot FROM pk JOIN lab ON pk.g = lab.g AND pk.no = lab.no),
rk AS (SELECT g, l, record_id, t, row_number() OVER (PARTITION BY g, l ORDER BY h, record_id) AS rank FROM s)
SELECT concat('synthetic_multicod:', ch.g, ':', lpad(CAST(draw AS VARCHAR), CAST(greatest(6, length(CAST(draw AS VARCHAR))) AS INTEGER), '0')) AS record_id, concat('synthetic_multicod:', ch.g) AS source_id, string_agg(ch.l, ',' ORDER BY slot) AS label, string_agg(t, ', ' ORDER BY slot) AS text, ch.g AS synthetic_source_ids, string_agg(record_id, ',' ORDER BY slot) AS synthetic_record_ids
FROM ch JOIN rk ON ch.g = rk.g AND ch.l = rk.l AND ch.rank = rk.rank GROUP BY draw, ch.g"""


@query("synthetic_multilabel", _SYNTH)
def synthetic_multilabel(spark, sf):
    docs = table(spark, sf, "documents")

    def made(change):
        # Below the view's join, which would move all texts where labels are too many to be broadcast.
        return view(spark, sf, "doc_records", documents=docs.withColumn("text", change(F.col("text")))).select("record_id", "source_id", "label", "text")

    n = max(1, round(view(spark, sf, "doc_records").count() * 0.5))
    return A.synthesise(made, n, "label", "record_id", "text", texts=docs.select(F.col("doc_id").alias("record_id"), "text")).drop("y_codes")


@query("inject_codebook", ctes("codebook", "doc_records") + "SELECT false AS injected, count(*) AS n, count(DISTINCT label) AS labels FROM doc_records UNION ALL SELECT true, 4 * count(*), count(*) FROM codebook")
def inject_codebook(spark, sf):
    d = view(spark, sf, "doc_records").select("record_id", "label", "text")
    return A.inject_codebook(d, _book(spark, sf), "text", "label", "record_id", 4).groupBy("injected").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))


def _book(spark, sf):
    return view(spark, sf, "codebook").select(F.concat(F.lit("book:"), "code").alias("record_id"), F.lit("masterlist_1").alias("source_id"), F.col("code").alias("label"), F.col("description").alias("text"))


@query("upsample_codebook", ctes("codebook") + "SELECT code AS label, CAST(1 AS BIGINT) AS before, CAST(3 AS BIGINT) AS after, CAST(2 AS BIGINT) AS delta FROM codebook")
def upsample_codebook(spark, sf):
    return A.upsample_codebook(_book(spark, sf), "text", "label", "record_id", 3, k=2)[1]


@query("multilabel_codebook", ctes("codebook") + f"""SELECT CAST(want AS INTEGER) AS labels, count(*) AS n FROM (SELECT 2 + CAST(floor({_V("n:', draw, '")} * (least(3, (SELECT count(*) FROM codebook)) - 1)) AS BIGINT) AS want FROM (SELECT unnest(range(500)) AS draw) d) x GROUP BY want""")
def multilabel_codebook(spark, sf):
    return A.multilabel_codebook(_book(spark, sf), 500, "label", "record_id", "text")[1]


_PREPARED = DOC + f""", d AS (SELECT record_id, label, CASE WHEN source_id = 'src5' THEN 'holdout' WHEN u < 0.9 THEN 'train' WHEN u < 0.9 + 0.05 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {_U.format("concat('333:', lower(text))")} AS u FROM doc_records WHERE source_id <> 'src6') z),
tr AS (SELECT * FROM d WHERE split = 'train'), c AS (SELECT label, count(*) AS n FROM tr GROUP BY label), g AS (SELECT label, n, CAST(round_even(4 * (1 - 0.2 * ln(1 + (1 - (n - 1) / 3.0::DOUBLE)) / ln(2.0::DOUBLE)), 0) AS BIGINT) AS target FROM c WHERE n < 4),
r AS (SELECT record_id, n, target, target - n AS need, row_number() OVER (PARTITION BY tr.label ORDER BY md5(concat('333:', record_id)), record_id) AS k FROM tr JOIN g ON tr.label = g.label WHERE target > n),
x AS (SELECT record_id, n, target, unnest(range(1, need // n + CASE WHEN k <= need % n THEN 1 ELSE 0 END + 1)) AS copy FROM r),
a AS (SELECT split, false AS synthetic, split = 'train' AND {_U.format("concat('333:f:', record_id)")} < 0.1 AS perturbed FROM d UNION ALL SELECT 'train', true, {_U.format("concat('333:p:', record_id, ':', copy)")} < 1 - n / target::DOUBLE FROM x
  UNION ALL SELECT 'train', true, false FROM (SELECT unnest(range(greatest(1, CAST(round_even(count(*) * 0.2, 0) AS BIGINT)))) FROM tr) s UNION ALL SELECT 'holdout_eval', false, false FROM (SELECT unnest(range(greatest(1, CAST(round_even(count(*) * 0.5, 0) AS BIGINT)))) FROM d WHERE split = 'holdout') s)
SELECT split, count(*) AS n, count(*) FILTER (WHERE synthetic) AS synthetic, count(*) FILTER (WHERE perturbed) AS perturbed, CAST(0 AS BIGINT) AS injected FROM a GROUP BY split"""


@query("prepare_splits", _PREPARED)
def prepare_splits(spark, sf):
    d = view(spark, sf, "doc_records").drop("split", "lang")
    plan = Plan(holdout="src5", holdout_eval=0.5, exclude=("src6",), multi_ratio=0.2, floor=4, decay=0.2, perturb=0.1)
    return split_counts(P.prepare_splits(d, plan, group=F.lower("text")))


_INJECTED = ctes("codebook") + f""", b AS (SELECT code, description AS t, unnest(range(3)) AS copy FROM codebook),
s AS (SELECT *, CAST(floor({_U.format("concat('333:book:', code, ':', copy, ':1:p')")} * (length(t) - 1)) AS BIGINT) AS i FROM b)
SELECT code AS label, sha256(CASE WHEN copy = 0 THEN t ELSE concat(left(t, i), substr(t, i + 2, 1), substr(t, i + 1, 1), substr(t, i + 3)) END) AS digest, copy > 0 AS perturbed, copy > 0 AS synthetic, 'train' AS split FROM s"""


@query("prepare_splits_injected", _INJECTED)
def prepare_splits_injected(spark, sf):
    """The injected texts themselves: every code-book row and two copies, each with one swap."""
    d = view(spark, sf, "doc_records").drop("split", "lang")
    out = P.prepare_splits(d, Plan(inject=3, inject_names=("swap",)), codebook=_book(spark, sf))
    return out.where("injected").select("label", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "perturbed", "synthetic", "split")


@query("perturbation_impact")
def perturbation_impact(spark, sf):
    return A.perturbation_impact(table(spark, sf, "part"), "p_partkey", "p_name")


@query("perturbation_pairs")
def perturbation_pairs(spark, sf):
    return A.perturbation_impact(table(spark, sf, "part"), "p_partkey", "p_name", ordered_pairs=True)


# --- profiles ------------------------------------------------------------------------------------------------------------
_COUNTS = DOC + ", c AS (SELECT label AS code, count(*) AS n FROM doc_records GROUP BY label)\n"


def _counts(spark, sf):
    return view(spark, sf, "doc_records").groupBy(F.col("label").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("block_distribution", LONG + ", b AS (SELECT substr(code, 1, 3) AS block, count(*) AS n FROM eval_long WHERE is_gold = 1 GROUP BY 1) SELECT block, n, round(n / sum(n) OVER (), 9) AS share, CAST(row_number() OVER (ORDER BY n DESC, block) AS INTEGER) AS place FROM b")
def block_distribution(spark, sf):
    return rounded(R.block_distribution(pairs(spark, sf), F.col("gold")), "share")


@query("cardinality_distribution", LONG + "SELECT source_id, CAST(k AS INTEGER) AS labels, count(*) AS n FROM (SELECT record_id, source_id, sum(is_gold) AS k FROM eval_long GROUP BY 1, 2) r GROUP BY 1, 2")
def cardinality_distribution(spark, sf):
    return R.cardinality_distribution(pairs(spark, sf), F.col("gold"), ["source_id"])


@query("source_distribution", DOC + "SELECT split, source_id AS source, count(*) AS n FROM doc_records GROUP BY 1, 2")
def source_distribution(spark, sf):
    return R.source_distribution(view(spark, sf, "doc_records"))


@query("label_stats", DOC + "SELECT count(*) AS non_empty, count(DISTINCT label) AS distinct_labels FROM doc_records")
def label_stats(spark, sf):
    return R.label_stats(view(spark, sf, "doc_records"), "label")


@query("label_vocabulary", _COUNTS + "SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS id FROM c")
def label_vocabulary(spark, sf):
    return R.label_vocabulary(_counts(spark, sf))


@query("length_profile", DOC + ", x AS (SELECT split, 'text' AS part, length(text) AS n FROM doc_records UNION ALL SELECT split, 'main', length(string_split(text, ' | ')[1]) FROM doc_records) SELECT split, part, CAST(n // 500 * 500 AS BIGINT) AS from_chars, count(*) AS n, CAST(min(x.n) AS INTEGER) AS shortest, CAST(max(x.n) AS INTEGER) AS longest FROM x GROUP BY 1, 2, 3")
def length_profile(spark, sf):
    return R.length_profile(view(spark, sf, "doc_records"), "text", ["split"], prefix="")


@query("count_summary", _COUNTS + "SELECT min(n) AS least, max(n) AS most, median(n) AS median, round(avg(n), 9) AS mean FROM c")
def count_summary(spark, sf):
    return rounded(R.count_summary(_counts(spark, sf)), "mean")


_Q = ", ".join(f"round(quantile_cont(n, {q}), 9) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))


@query("imbalance_profile", DOC + f", b AS (SELECT source_id, label FROM doc_records UNION ALL SELECT 'overall', label FROM doc_records), c AS (SELECT source_id, label AS code, count(*) AS n FROM b GROUP BY 1, 2) SELECT source_id, count(*) AS classes, CAST(sum(n) AS BIGINT) AS rows, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean, round(stddev_samp(n), 6) AS std, {_Q}, count(*) FILTER (WHERE n = 1) AS singletons, count(*) FILTER (WHERE n <= 5) AS upto_5, count(*) FILTER (WHERE n <= 10) AS upto_10, round(max(n)::DOUBLE / min(n), 9) AS max_min, round(max(n) / quantile_cont(n, 0.5), 9) AS max_median FROM c GROUP BY source_id")
def imbalance_profile(spark, sf):
    return R.imbalance_profile(R.class_counts(view(spark, sf, "doc_records"), F.array("label"), ["source_id"]), "source_id")


@query("class_extremes", _COUNTS + ", r AS (SELECT 'top' AS \"end\", CAST(row_number() OVER (ORDER BY n DESC, code) AS INTEGER) AS place, code, n FROM c UNION ALL SELECT 'bottom', CAST(row_number() OVER (ORDER BY n, code) AS INTEGER), code, n FROM c) SELECT * FROM r WHERE place <= 20")
def class_extremes(spark, sf):
    return R.extremes(_counts(spark, sf))


@query("block_distribution_by_split", LONG + ", b AS (SELECT record_id % 3 AS part, substr(code, 1, 3) AS block, count(*) AS n FROM eval_long WHERE is_gold = 1 GROUP BY 1, 2), r AS (SELECT part, block, n, round(n / sum(n) OVER (PARTITION BY part), 9) AS share, CAST(row_number() OVER (PARTITION BY part ORDER BY n DESC, block) AS INTEGER) AS place FROM b) SELECT * FROM r WHERE place <= 7")
def block_distribution_by_split(spark, sf):
    return rounded(R.block_distribution(pairs(spark, sf).withColumn("part", F.col("record_id") % 3), F.col("gold"), by=["part"], top=7), "share")


@query("validate_labels", DOC + "SELECT count(*) AS non_empty, count(DISTINCT label) AS distinct_labels, CAST(CASE WHEN count(DISTINCT label) = 1 THEN 1 ELSE 0 END AS INTEGER) AS warnings FROM doc_records")
def validate_labels(spark, sf):
    d = view(spark, sf, "doc_records")
    return R.label_stats(d, "label").withColumn("warnings", F.lit(len(R.validate_labels(d, ["record_id", "text"], "label"))))


@query("concentration", _COUNTS + ", r AS (SELECT n, row_number() OVER (ORDER BY n, code) AS up, row_number() OVER (ORDER BY n DESC, code) AS down FROM c) SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS rows, round(2 * sum(up * n) / (count(*) * sum(n))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE, 9) AS gini, " + ", ".join(f"round(sum(CASE WHEN down <= {t} THEN n ELSE 0 END)::DOUBLE / sum(n), 9) AS top_{t}" for t in (10, 100, 1000)) + ", count(*) FILTER (WHERE n < 10) AS below_10, count(*) FILTER (WHERE n < 50) AS below_50 FROM r")
def concentration(spark, sf):
    return R.concentration(_counts(spark, sf))


@query("rank_frequency", _COUNTS + "SELECT code, n, CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(n) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (), 9) AS share FROM c WINDOW w AS (ORDER BY n DESC, code)")
def rank_frequency(spark, sf):
    return rounded(R.rank_frequency(_counts(spark, sf)), "share")


@query("classes_needed", _COUNTS + ", r AS (SELECT row_number() OVER w AS rank, sum(n) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER () AS share FROM c WINDOW w AS (ORDER BY n DESC, code)) SELECT " + ", ".join(f"CAST(min(CASE WHEN share >= {s / 100} THEN rank END) AS INTEGER) AS classes_{s}" for s in (50, 80, 90, 95)) + " FROM r")
def classes_needed(spark, sf):
    return R.classes_needed(R.rank_frequency(_counts(spark, sf)))


@query("record_coverage_topn", LONG + ", c AS (SELECT code, row_number() OVER (ORDER BY count(*) DESC, code) AS r FROM eval_long WHERE is_gold = 1 GROUP BY code), b AS (SELECT source_id, record_id, min(r) AS best FROM eval_long e JOIN c ON e.code = c.code WHERE is_gold = 1 GROUP BY 1, 2) SELECT source_id, count(*) AS records, round(avg(CASE WHEN best <= 10 THEN 1 ELSE 0 END), 9) AS top_10, round(avg(CASE WHEN best <= 50 THEN 1 ELSE 0 END), 9) AS top_50 FROM b GROUP BY source_id")
def record_coverage_topn(spark, sf):
    d = pairs(spark, sf)
    return R.record_coverage(d, "gold", R.class_counts(d, F.col("gold")), (10, 50), ["source_id"])


_LV = LONG + ", n AS (SELECT level, substr(code, 1, len) AS node, count(*) AS n FROM eval_long CROSS JOIN (VALUES ('chapter', 1), ('group', 2), ('block', 3), ('category', 5), ('code', 7)) t(level, len) WHERE is_gold = 1 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, node) AS r FROM n)\n"


@query("level_concentration", _LV + "SELECT level, count(*) AS nodes, " + ", ".join(f"round(sum(CASE WHEN r <= {k} THEN n ELSE 0 END)::DOUBLE / sum(n), 9) AS top_{k}" for k in (1, 5, 10)) + " FROM r GROUP BY level")
def level_concentration(spark, sf):
    return R.level_concentration(pairs(spark, sf), F.col("gold"), S.LEVELS)


# --- hierarchy -----------------------------------------------------------------------------------------------------------
_TREE = ctes("codebook") + """, e AS (SELECT "row", category, cause, description, level, substr(code, 1, len) AS node, CASE WHEN up > 0 THEN substr(code, 1, up) ELSE 'root' END AS parent FROM codebook CROSS JOIN (VALUES ('chapter', 1, 0), ('group', 2, 1), ('block', 3, 2), ('category', 5, 3), ('code', 7, 5)) t(level, len, up)),
g AS (SELECT level, node, parent, list_sort(list(DISTINCT category)) AS cats, arg_min(cause, "row") AS cause, arg_min(description, "row") AS description FROM e GROUP BY 1, 2, 3), kids AS (SELECT parent, count(*) AS children FROM g GROUP BY parent),
tree AS (SELECT level, node, g.parent, CASE WHEN level IN ('chapter', 'group') THEN concat(array_to_string(list_slice(cats, 1, 4), '; '), CASE WHEN len(cats) > 4 THEN '; ...' ELSE '' END) WHEN level = 'code' THEN description ELSE cause END AS label, coalesce(children, 0) AS children FROM g LEFT JOIN kids ON g.node = kids.parent)
"""


def _tree(spark, sf):
    return H.nodes(view(spark, sf, "codebook").withColumn("row", F.struct("row", "code")))


_TREE = _TREE.replace('SELECT "row", category', 'SELECT concat(lpad(CAST("row" AS VARCHAR), 20, \'0\'), code) AS "row", category')


@query("hierarchy_nodes", _TREE + "SELECT * FROM tree")
def hierarchy_nodes(spark, sf):
    return _tree(spark, sf)


@query("tree_stats", _TREE + "SELECT level, count(*) AS nodes, max(children) AS max_branching FROM (SELECT level, children FROM tree UNION ALL SELECT 'total', children FROM tree) t GROUP BY level")
def tree_stats(spark, sf):
    return H.tree_stats(_tree(spark, sf))


@query("branching_profile", _TREE + "SELECT level, count(*) AS parents, round(avg(children), 9) AS mean, median(children) AS median, max(children) AS most, count(*) FILTER (WHERE children > 10) AS over FROM tree WHERE children > 0 GROUP BY level")
def branching_profile(spark, sf):
    return H.branching(_tree(spark, sf))


@query("node_path", _TREE + "SELECT level, node, label FROM tree WHERE node IN ('A', 'A0', 'A00', 'A00.0', 'A00.000')")
def node_path(spark, sf):
    return H.path(_tree(spark, sf), "A00.000").select("level", "node", "label")


@query("cross_map", ctes("codebook") + "SELECT category, string_agg(DISTINCT substr(code, 1, 1), ',' ORDER BY substr(code, 1, 1)) AS chapters, count(DISTINCT substr(code, 1, 3)) AS blocks, count(DISTINCT code) AS codes FROM codebook GROUP BY category")
def cross_map(spark, sf):
    return H.cross_map(view(spark, sf, "codebook"))


@query("cross_counts", ctes("codebook") + "SELECT substr(code, 1, 1) AS chapter, substr(code, 1, 3) AS block, category, count(DISTINCT code) AS codes FROM codebook GROUP BY 1, 2, 3")
def cross_counts(spark, sf):
    return H.cross_counts(view(spark, sf, "codebook"))


_VALUES = "string_agg(DISTINCT {0}, '; ' ORDER BY {0})"
_BOOKTEXT = "SELECT {n} AS level, substr(code, 1, {n}) AS node, concat_ws(' | ', concat(substr(code, 1, {n}), ': ', {head}), concat('Cause: ', " + _VALUES.format("cause") + "){rest}, concat('HistCat: ', " + _VALUES.format("histcat") + ")) AS text FROM codebook GROUP BY 1, 2"


@query("codebook_documents", ctes("codebook") + " UNION ALL ".join(_BOOKTEXT.format(n=n, head=_VALUES.format("category" if n == 1 else "description"), rest="" if n == 1 else ", concat('Category: ', " + _VALUES.format("category") + ")") for n in (1, 3, 7)))
def codebook_documents(spark, sf):
    book = view(spark, sf, "codebook")
    frames = [H.documents(book, n).select(F.lit(n).alias("level"), "node", "text") for n in (1, 3, 7)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("load_codebook", ctes("codebook") + "SELECT code, description FROM codebook")
def load_codebook(spark, sf):
    book = view(spark, sf, "codebook").select("code", "description")
    raw = book.select(F.concat(F.lit(" "), "code", F.lit("\t")).alias("code"), F.regexp_replace("description", " ", "\n").alias("description"))
    return I.load_codebook(raw.unionByName(raw.select(F.lit("A00").alias("code"), "description")), ["code", "description"])


@query("attach_description", BOOK + ", c AS (SELECT code, count(*) AS n FROM eval_long WHERE is_gold = 1 GROUP BY code) SELECT c.code, n, description FROM c LEFT JOIN codebook b ON c.code = b.code")
def attach_description(spark, sf):
    return H.attach_description(R.class_counts(pairs(spark, sf), F.col("gold")), view(spark, sf, "codebook"))


def _beam_sql(beam: int, choices: int) -> str:
    """Five levels of the search, a CTE each."""
    out = [_TREE.rstrip(), "kid AS (SELECT parent, node AS child, count(*) OVER (PARTITION BY parent) AS n FROM tree)", "q AS (SELECT r_regionkey AS query_id FROM region)", "s0 AS (SELECT query_id, 'root' AS node, 1 AS place FROM q)"]
    score = "(CAST(('0x' || substr(md5(concat('beam:', s.query_id, ':', child)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
    for i in range(5):
        out.append(f"e{i} AS (SELECT query_id, child, place, n, row_number() OVER (PARTITION BY query_id, node ORDER BY {score} DESC, child) AS c FROM s{i} s JOIN kid ON s.node = kid.parent)")
        out.append(f"f{i} AS (SELECT query_id, child, min((place, c)) AS o FROM e{i} WHERE c <= {choices} OR n = 1 GROUP BY 1, 2)")
        out.append(f"s{i + 1} AS (SELECT * FROM (SELECT query_id, child AS node, row_number() OVER (PARTITION BY query_id ORDER BY o) AS place FROM f{i}) x WHERE place <= {beam})")
    return ", ".join(out) + " SELECT query_id, node AS code, CAST(place AS INTEGER) AS place FROM s5"


@query("beam_narrow", _beam_sql(3, 2))
def beam_narrow(spark, sf):
    tree = _tree(spark, sf)
    q = table(spark, sf, "region").select(F.col("r_regionkey").alias("query_id"))
    scores = tree.select("node", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("query_id")).select("query_id", "node", S.uniform("beam", F.col("query_id"), F.col("node")).alias("score"))
    return H.beam_narrow(q, tree, scores, 3, 2)


# --- retrieval -----------------------------------------------------------------------------------------------------------


@query("majority_topk", LONG + "SELECT code, n, CAST(row_number() OVER (ORDER BY n DESC, code) AS INTEGER) AS place FROM (SELECT code, count(*) AS n FROM eval_long WHERE is_gold = 1 GROUP BY code ORDER BY n DESC, code LIMIT 10) t")
def majority_topk(spark, sf):
    return T.majority_topk(pairs(spark, sf), "gold", 10)


@query("tfidf", """WITH b AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]{2,}') AS w FROM conversations),
t AS (SELECT id, unnest(w) AS term FROM b UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) FROM b WHERE len(w) > 1), e AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM e GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 500),
w AS (SELECT id, e.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM conversations)) / (1 + df)::DOUBLE) + 1) AS w FROM e JOIN d ON e.term = d.term), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id) SELECT w.id, term, round(w / norm, 6) AS weight FROM w JOIN n ON w.id = n.id""")
def tfidf(spark, sf):
    d = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return T.tfidf(d, "id", "text", 2, max_features=500).withColumn("weight", F.round("weight", 6))


_COS = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) + 1e-9 AS n FROM v),
s AS (SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id, c.label, round(list_dot_product(q.e, c.e) / (q.n * c.n), 9) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM s)
"""


def _cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    return T.cosine_topk(e.where("vec_id % 50 = 0"), e, 5)  # a stated query set against all rows


@query("cosine_topk", _COS + "SELECT query_id, place, vec_id, round(score, 6) AS score FROM r WHERE place <= 5")
def cosine_topk(spark, sf):
    return _cosine(spark, sf).withColumn("score", F.round("score", 6))


def _ranked(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    r = _cosine(spark, sf).join(e, "vec_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("ranked"))
    return r.join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), "query_id")


@query("recall_at_k", _COS + "SELECT CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 9) AS recall FROM (SELECT k, query_id, bool_or(label = query_label) AS hit FROM r, (SELECT unnest([1, 3, 5]) AS k) ks WHERE place <= k GROUP BY 1, 2) x GROUP BY k")
def recall_at_k(spark, sf):
    return rounded(T.recall_at_k(_ranked(spark, sf), (1, 3, 5), "gold"), "recall")


_SETS = _COS + """, gl AS (SELECT vec_id AS query_id, label AS code FROM embeddings WHERE vec_id % 50 = 0 UNION SELECT vec_id, (label + 1) % 10 FROM embeddings WHERE vec_id % 100 = 0), ks AS (SELECT unnest([1, 3, 5]) AS k),
rl AS (SELECT DISTINCT k, query_id, label AS code FROM r, ks WHERE place <= k), x AS (SELECT q.k, q.query_id, q.g, q.rr, coalesce(h.hits, 0) AS hits FROM (SELECT ks.k, a.query_id, a.g, b.rr FROM ks, (SELECT query_id, count(*) AS g FROM gl GROUP BY 1) a JOIN (SELECT k, query_id, count(*) AS rr FROM rl GROUP BY 1, 2) b ON a.query_id = b.query_id WHERE b.k = ks.k) q
  LEFT JOIN (SELECT k, rl.query_id, count(*) AS hits FROM rl JOIN gl ON rl.query_id = gl.query_id AND rl.code = gl.code GROUP BY 1, 2) h ON q.k = h.k AND q.query_id = h.query_id)
"""


def _gold_sets(spark, sf):
    """One label for each query, and another for every second."""
    own = F.col("gold").cast("int")
    return _ranked(spark, sf).withColumns({"gold": F.when(F.col("query_id") % 100 == 0, F.array(own, ((own + 1) % 10).cast("int"))).otherwise(F.array(own)), "ranked": F.col("ranked").cast("array<int>")})


@query("retrieval_eval", _SETS + """SELECT CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(hits::DOUBLE / g), 9) AS coverage, round(median(hits::DOUBLE / g), 9) AS median_coverage, round(avg(CASE WHEN hits = g THEN 1 ELSE 0 END), 9) AS all_in, round(avg(CASE WHEN hits = 0 THEN 1 ELSE 0 END), 9) AS none_in, round(avg(CASE WHEN hits > 0 AND hits < g THEN 1 ELSE 0 END), 9) AS partial,
 round(avg(CASE WHEN hits = g THEN 1 ELSE 0 END), 9) AS "full", round(2 * sum(hits)::DOUBLE / (sum(g) + sum(rr)), 9) AS micro_f1, round(avg(2 * hits::DOUBLE / (g + rr)), 9) AS mean_f1 FROM x GROUP BY k""")
def retrieval_eval(spark, sf):
    return T.retrieval_eval(_gold_sets(spark, sf), (1, 3, 5))


@query("coverage_by_size", _SETS + "SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN g = 1 THEN hits::DOUBLE / g END), 9) AS size_1, round(avg(CASE WHEN g = 2 THEN hits::DOUBLE / g END), 9) AS size_2 FROM x GROUP BY k")
def coverage_by_size(spark, sf):
    return T.coverage_by_size(_gold_sets(spark, sf), (1, 3, 5), (1, 2))


@query("ovr_topk_codes")
def ovr_topk_codes(spark, sf):
    """All codes of the training documents at once."""
    d = view(spark, sf, "doc_records").select("record_id", "label", "text", "split")
    codes = [r[0] for r in d.where("split = 'train'").select("label").distinct().orderBy("label").collect()]
    return T.ovr_topk(d.where("split = 'train'"), d.where("split <> 'train'"), codes, "text", "label", "record_id", 3, 1 << 11, passes=20)


@query("ovr_topk")
def ovr_topk(spark, sf):
    d = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")
    return T.ovr_topk(d.where("id % 2 = 0"), d.where("id % 2 = 1"), ["assistant", "user"], "text", "role", "id", 2)


# --- sources and sinks, on files written from the given tables ---------------------------------------------------------------


def _written(spark, df, kind: str) -> str:
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    I.write_by_extension(df, f"{path}.{kind}")
    return f"{path}.{kind}"


def _register(spark, sf):
    """Customers as a register: name, segment code, two more code columns, nation as sex, age, own id where even."""
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in "ABCDE"]), (F.col("c_custkey") % 5 + 1).cast("int")), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(".000"))
    other = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("z99."), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))).otherwise("nan")
    d = table(spark, sf, "customer").orderBy("c_custkey")
    return d.select(F.regexp_replace("c_name", "#", ".").alias("name"), code.alias("code"), F.when(F.col("c_custkey") % 7 == 0, None).otherwise(code).alias("first"), other.alias("second"), (F.col("c_nationkey") % 3).cast("string").alias("sex"), (F.col("c_custkey") % 90 / 2).cast("string").alias("age"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("own"))


MAPPING = I.Mapping(text=0, code=1, codes=(2, 3), sex=4, sex_map={"0": "F", "1": "M"}, age=5, record_id=6)
_REGISTER = """WITH r AS (SELECT c_custkey AS c, replace(c_name, '#', ' ') AS name, concat(substr('ABCDE', CAST(c_custkey % 5 AS INTEGER) + 1, 1), lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'), '.000') AS code, c_custkey % 90 / 2.0::DOUBLE AS age, CASE c_nationkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'unknown' END AS sex FROM customer)
SELECT 'cust' AS source_id, concat('k', c) AS record_id, concat('cod: ', name, ' | age: ', CASE WHEN age = floor(age) THEN CAST(CAST(age AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', age), '0+$', '') END, ' | sex: ', sex) AS text,
 CASE WHEN c % 7 = 0 AND c % 3 = 0 THEN concat('Z99.', lpad(CAST(c % 1000 AS VARCHAR), 3, '0')) WHEN c % 3 = 0 THEN concat(code, ',Z99.', lpad(CAST(c % 1000 AS VARCHAR), 3, '0')) ELSE code END AS label FROM r"""


@query("load_register", _REGISTER)
def load_register(spark, sf):
    path = _written(spark, _register(spark, sf), "csv")
    return I.load_source(spark, I.Source("cust", path, MAPPING)).select("source_id", "record_id", "text", "label")


@query("canonical_records", _REGISTER.replace("WITH r AS", "WITH all_r AS (WITH r AS", 1) + ") SELECT source_id, record_id, text, label FROM all_r UNION ALL SELECT 'again', record_id, text, label FROM all_r")
def canonical_records(spark, sf):
    path = _written(spark, _register(spark, sf), "tsv")
    swapped = I.Mapping(text=1)  # replaced by the caller's mapping of this source
    return I.build_canonical(spark, [I.Source("cust", path, MAPPING), I.Source("again", path, swapped), I.Source("off", "nowhere", MAPPING, enabled=False)], mappings={"again": MAPPING}).select("source_id", "record_id", "text", "label")


@query("register_row_numbers", "SELECT count(*) - 3 AS n, count(*) - 3 AS ids, CAST(0 AS BIGINT) AS least, count(*) - 4 AS most FROM customer")
def register_row_numbers(spark, sf):
    path = _written(spark, _register(spark, sf).repartition(5), "csv")
    plain = I.Mapping(text=0, code=1, skip_rows=(0, 3, 9))
    d = I.load_source(spark, I.Source("cust", path, plain)).select(F.substring_index("record_id", ":", -1).cast("long").alias("i"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("i").alias("ids"), F.min("i").alias("least"), F.max("i").alias("most"))


_NOTED = """concat(chr(39), ' "', text, '" ', chr(10), '; "",', CASE WHEN k = 1 THEN '' ELSE chr(13) || chr(10) || '\\"' END, text)"""


@query("quoted_register", f"""SELECT doc_id, k, lang, sha256({_NOTED}) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'a "b' END AS note FROM documents, (SELECT unnest(range(3)) AS k)""")
def quoted_register(spark, sf):
    """Whole texts with quotes, separators and line breaks, written and read again in ranges."""
    d = table(spark, sf, "documents").withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    noted = F.expr(_NOTED.replace("text,", "coalesce(text, ''),").replace(", text)", ", coalesce(text, ''))").replace("'\\\"'", "'\\\\\"'"))
    d = d.select("doc_id", "k", "lang", noted.alias("words"), F.when(F.col("doc_id") % 3 == 0, 'a "b').alias("note"))
    back = I.read_delimited(spark, I.Source("docs", _written(spark, d, "csv"), I.Mapping(text=3)))
    return back.select(F.col("doc_id").cast("long"), F.col("k").cast("long"), "lang", F.sha2(F.col("words").cast("binary"), 256).alias("digest"), "note")


@query("scoring_input", "SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 2 = 0) AS own, count(*) FILTER (WHERE c_custkey % 2 = 1) AS filled, count(*) AS ids FROM customer")
def scoring_input(spark, sf):
    d = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("k"), F.col("c_custkey").cast("string"))).otherwise(" ").alias("record_id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("text"))
    back = I.read_scoring_input(spark, _written(spark, d, "jsonl"))
    return back.agg(F.count("text").alias("n"), F.count_if(F.col("record_id").startswith("k")).alias("own"), F.count_if(F.col("record_id").rlike("^row-[0-9]{6}$")).alias("filled"), F.countDistinct("record_id").alias("ids"))


@query("tolerant_json", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_name END AS name FROM customer WHERE c_custkey % 5 <> 0")
def tolerant_json(spark, sf):
    c = F.col("c_custkey")
    line = F.when(c % 5 == 0, F.lit("{broken")).when(c % 3 == 0, F.to_json(F.struct(c.alias("id")))).otherwise(F.to_json(F.struct(c.alias("id"), F.col("c_name").alias("name"))))
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return I.read_jsonl_tolerant(spark, path, "id long, name string", {"name": "none"})


@query("stored_by_fingerprint", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM customer")
def stored_by_fingerprint(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "test").otherwise("train").alias("split"))
    settings = {"seed": 333, "log": "any"}
    root, key = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", I.fingerprint([{"path": sf}], settings, ["log"])
    I.materialise_by_fingerprint(lambda: d, root, key, spark, ("train", "test"), settings, ["log"])
    return I.materialise_by_fingerprint(lambda: d.limit(0), root, key, spark, ("train", "test"), settings | {"log": "other"}, ["log"]).select("c_custkey", "split")


@query("stored_by_source", "SELECT 'a' AS source, c_custkey AS k, 'one' AS made FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'b', c_custkey, 'two' FROM customer WHERE c_custkey % 3 = 1")
def stored_by_source(spark, sf):
    """Two sources stored, one of them changed: only that one is made again."""
    root, c = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", table(spark, sf, "customer")
    make = lambda name, i, made: lambda: c.where(F.col("c_custkey") % 3 == i).select(F.lit(name).alias("source"), F.col("c_custkey").alias("k"), F.lit(made).alias("made"))
    store.kept_by_source(spark, root, {"a": ("f1", make("a", 0, "one")), "b": ("f1", make("b", 1, "one"))})
    return store.kept_by_source(spark, root, {"a": ("f1", make("a", 0, "two")), "b": ("f2", make("b", 1, "two"))})


@query("resumed_scores", "SELECT c_custkey, lower(c_name) AS out FROM customer")
def resumed_scores(spark, sf):
    """Repeated and missing ids among the requests, and three runs."""
    log = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    d = table(spark, sf, "customer").select("c_custkey", "c_name")
    odd = d.unionByName(d.where("c_custkey % 4 = 0")).unionByName(d.where("c_custkey % 7 = 0").withColumn("c_custkey", F.lit(None).cast("long")))
    score = lambda x: x.select("c_custkey", F.lower("c_name").alias("out"))
    for part in (odd.where("c_custkey % 3 = 0"), odd, odd):
        score_batch(part, log, score, "c_custkey")
    return read_log(spark, log)


@query("streamed_scores", "SELECT c_custkey, lower(c_name) AS out FROM customer")
def streamed_scores(spark, sf):
    """A batch, then a stream that is stopped and started again over repeated requests."""
    log = f"{shared_folder(spark)}/slog-{uuid.uuid4().hex}"
    d = table(spark, sf, "customer").select("c_custkey", "c_name")
    score = lambda x: x.select("c_custkey", F.lower("c_name").alias("out"))
    score_batch(d.where("c_custkey % 5 = 0"), log, score, "c_custkey")
    path = f"{log}-requests"
    for part in (d.where("c_custkey % 2 = 0"), d.unionByName(d.where("c_custkey % 3 = 0"))):
        part.write.mode("append").parquet(path)
        score_stream(spark.readStream.schema(d.schema).parquet(path), log, f"{log}-state", score, "c_custkey").awaitTermination()
    return read_log(spark, log)


@query("split_bundle", LONG + "SELECT count(DISTINCT record_id) AS n, CAST(0 AS INTEGER) AS problems FROM eval_long")
def split_bundle(spark, sf):
    root = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    d = settled(view(spark, sf, "eval_records").select("record_id", "score", "correct"))  # read by the curve and two writers
    curve = P2.rc_curve(P2.curve(d, "score", "correct", "record_id"), (0.5, 1.0))
    I.write_split_bundle(d.select("record_id", "correct"), d, curve, root)
    return spark.read.parquet(f"{root}/rows").agg(F.countDistinct("record_id").alias("n")).withColumn("problems", F.lit(len(I.bundle_problems(spark, root, "record_id"))))


@query("load_overrides", DOC + "SELECT record_id, 'Z00.000,Z01.000' AS new_label FROM doc_records WHERE CAST(record_id AS BIGINT) % 20 = 0")
def load_overrides(spark, sf):
    d = view(spark, sf, "doc_records").where("CAST(record_id AS BIGINT) % 20 = 0").select("source_id", "record_id", F.col("label").alias("old_label"), F.lit(" Z00.000, Z01.000,Z00.000,").alias("new_label"))
    path = _written(spark, d, "csv")
    return C.load_overrides(spark.read.csv(path, header=True)).select("record_id", "new_label")
