"""Set-based multi-label metrics over frames with `gold` and `pred` code arrays.

`by` names slice columns; metrics of all slices come out of one job. Classes are those seen in the slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.scalars import sanitise_key
from codeloom.operators.ordering import on_slices, settled


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b; `empty` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _counts(df: DataFrame) -> DataFrame:
    both = F.size(F.array_intersect("gold", "pred"))
    g, p = F.size(F.array_distinct("gold")), F.size(F.array_distinct("pred"))
    return df.withColumns({"_tp": both, "_g": g, "_p": p})


def micro(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s = _counts(df).groupBy(*by).agg(F.sum("_tp").alias("tp"), F.sum(F.col("_p") - F.col("_tp")).alias("fp"), F.sum(F.col("_g") - F.col("_tp")).alias("fn"))
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    return s.select(*by, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp + fn).alias("jaccard"))


def record_scores(df: DataFrame) -> DataFrame:
    """Adds each record's precision, recall, f1 and jaccard; two empty sets count as 1."""
    d = _counts(df)
    none = (F.col("_g") == 0) & (F.col("_p") == 0)
    one = lambda e: F.when(none, 1.0).otherwise(e)
    return d.withColumns({
        "precision": one(ratio(F.col("_tp"), F.col("_p"))), "recall": one(ratio(F.col("_tp"), F.col("_g"))),
        "f1": one(ratio(2 * F.col("_tp"), F.col("_g") + F.col("_p"))), "jaccard": one(ratio(F.col("_tp"), F.col("_g") + F.col("_p") - F.col("_tp"))),
    })


def sample(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return record_scores(df).groupBy(*by).agg(*[F.avg(c).alias(f"sample_{c}") for c in ("precision", "recall", "f1", "jaccard")])


def diagnostics(df: DataFrame, by: Sequence[str] = (), extra_classes: Sequence[str] = ()) -> DataFrame:
    """Hamming loss over given and seen classes, average counts, count error, false positives and negatives."""
    seen = df.select(*by, F.explode(F.array_union(F.array_union("gold", "pred"), F.array(*map(F.lit, extra_classes)).cast("array<string>"))).alias("c")).groupBy(*by).agg(F.countDistinct("c").alias("classes"))
    d = _counts(df).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_g") + F.col("_p") - 2 * F.col("_tp")).alias("wrong"), F.avg("_g").alias("avg_gold"), F.avg("_p").alias("avg_pred"),
        F.avg(F.abs(F.col("_g") - F.col("_p"))).alias("count_mae"), F.avg(F.col("_p") - F.col("_tp")).alias("avg_fp"), F.avg(F.col("_g") - F.col("_tp")).alias("avg_fn"), F.avg((F.col("_p") == 0).cast("int")).alias("empty_rate"),
    )
    joined = on_slices(d, seen, by)
    loss = ratio(F.col("wrong"), F.col("n") * F.col("classes"))
    return joined.select(*by, "n", "classes", loss.alias("hamming_loss"), (1 - loss).alias("hamming_score"), "avg_gold", "avg_pred", "count_mae", "avg_fp", "avg_fn", "empty_rate")


def exploded(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., code, is_gold, is_pred): one row for each code of a record."""
    return df.select(*keep, "gold", "pred", F.explode(F.array_union("gold", "pred")).alias("code")).select(
        *keep, "code", F.array_contains("gold", F.col("code")).cast("int").alias("is_gold"), F.array_contains("pred", F.col("code")).cast("int").alias("is_pred")
    )


def class_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return exploded(df, by).groupBy(*by, "code").agg(F.sum(F.col("is_gold") * F.col("is_pred")).alias("tp"), F.sum("is_gold").alias("gold_total"), F.sum("is_pred").alias("pred_total"))


def macro(df: DataFrame, by: Sequence[str] = (), universe: Sequence[str] | None = None) -> DataFrame:
    """Unweighted means over the classes of each slice; with a universe, `_universe` counts the classes and those given."""
    p, r = ratio(F.col("tp"), F.col("pred_total")), ratio(F.col("tp"), F.col("gold_total"))
    per = class_stats(df, by).withColumns({"p": p, "r": r, "f": ratio(2 * F.col("tp"), F.col("gold_total") + F.col("pred_total"))})
    figures = [F.count(F.lit(1)).alias("classes"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1")]
    if universe is not None:
        unseen = len(set(universe)) - (F.count_if(F.col("code").isin(*universe)) if universe else F.lit(0))
        figures.append((F.count(F.lit(1)) + unseen).alias("_universe"))
    return per.groupBy(*by).agg(*figures)


def same_set(df: DataFrame) -> Column:
    return F.array_sort(F.array_distinct("gold")) == F.array_sort(F.array_distinct("pred"))


def same_string(df: DataFrame, separator: str = ",") -> Column:
    """The other notion of a match: equal joined labels, order and repeats included."""
    return F.array_join("gold", separator) == F.array_join("pred", separator)


def metric_set(df: DataFrame, by: Sequence[str] = (), multi_label: bool = True, block: int | None = None, universe: Sequence[str] = ()) -> DataFrame:
    """One row of figures for each slice: n, accuracy, micro, sample and macro figures, diagnostics.

    Several labels are compared as sets; with `multi_label` false the match is of joined strings, and only
    accuracy and macro figures are given. `block` adds the figures of codes cut to so many characters, as
    chapter_block_*; all levels are worked out in the same two aggregations. `universe` names classes that
    count in the Hamming loss even if no record has them.
    """
    if block is not None:
        cut = by_level(df.withColumn("_whole", same_set(df) if multi_label else same_string(df)), {"whole": 1 << 10, "block": block})
        cut = cut.withColumn("_hit", F.when(F.col("level") == "whole", F.col("_whole")).otherwise(same_set(cut)))
        figures = metric_set(cut, [*by, "level"], multi_label, universe=[*universe, *sorted({c[:block] for c in universe})])
        names = [c for c in figures.columns if c not in (*by, "level")]
        pick = lambda level, prefix: [F.max(F.when(F.col("level") == level, F.col(c))).alias(prefix + c) for c in names]
        return figures.groupBy(*by).agg(*pick("whole", ""), *[c for c, n in zip(pick("block", "chapter_block_"), names, strict=True) if n != "n"])
    d = record_scores(df)
    d = d if "_hit" in df.columns else d.withColumn("_hit", same_set(df) if multi_label else same_string(df))
    base = [F.count(F.lit(1)).alias("n"), F.avg(F.col("_hit").cast("int")).alias("accuracy")]
    if multi_label:
        base += [F.sum(c).alias(c) for c in ("_tp", "_g", "_p")]
        base += [F.avg(c).alias(f"sample_{c}") for c in ("precision", "recall", "f1", "jaccard")]
        base += [F.avg("_p").alias("avg_predicted_label_count"), F.avg("_g").alias("avg_true_label_count"), F.avg(F.abs(F.col("_p") - F.col("_g"))).alias("label_count_mae")]
        base += [F.avg(F.col("_p") - F.col("_tp")).alias("avg_false_positives"), F.avg(F.col("_g") - F.col("_tp")).alias("avg_false_negatives"), F.avg((F.col("_p") == 0).cast("int")).alias("empty_prediction_rate")]
    m = macro(df, by, universe)
    base = d.groupBy(*by).agg(*base)
    both = on_slices(base, m, by, "left").na.fill(0, [c for c in [*base.columns, *m.columns] if c not in by])
    tp, p, g = F.col("_tp"), F.col("_p"), F.col("_g")
    out = [*by, "n", "accuracy", F.col("accuracy").alias("exact_match")]
    if multi_label:
        loss = ratio(g + p - 2 * tp, F.col("n") * F.col("_universe"))
        out += [ratio(tp, p).alias("micro_precision"), ratio(tp, g).alias("micro_recall"), ratio(2 * tp, p + g).alias("micro_f1"), ratio(tp, p + g - tp).alias("micro_jaccard")]
        out += [c for c in base.columns if c.startswith(("sample_", "avg_", "label_count", "empty_"))] + [loss.alias("hamming_loss"), (1 - loss).alias("hamming_score")]
    return both.select(*out, *[c for c in m.columns if c not in (*by, "_universe")])


def per_source_metrics(df: DataFrame, source: str = "source_id", excluded: Sequence[str] = (), total: str = "overall", **kw) -> DataFrame:
    """metric_set of each source, by its key for metric names, and of all rows; excluded sources only count in the total."""
    own = F.when(~F.coalesce(F.col(source).isin(*excluded), F.lit(False)) if excluded else F.lit(True), sanitise_key(source))
    return metric_set(df.withColumn(source, F.explode(F.array_compact(F.array(own, F.lit(total))))), [source], **kw)


def with_total(df: DataFrame, column: str, total: str = "overall") -> DataFrame:
    """Each row once for its slice and once for the total, so slices and total come from one pass."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit(total))))


def by_level(df: DataFrame, levels: dict[str, int]) -> DataFrame:
    """Each row once for each hierarchy level, its codes cut to the level's prefix."""
    table = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(n).alias("len")) for k, n in levels.items()])
    d = df.withColumn("_l", F.explode(table))
    cut = lambda c: F.array_distinct(F.transform(c, lambda x: F.substr(x, F.lit(1), F.col("_l.len"))))
    return d.withColumns({"gold": cut("gold"), "pred": cut("pred"), "level": F.col("_l.level")}).drop("_l")


def to_long(df: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [c for c in df.columns if c not in by]
    return df.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias("metric", "value"))


# Metric names of the report modes, and the prefixes that every mode but `all` keeps too.
CORE = ("accuracy", "exact_match", "macro_f1", "sample_f1", "sample_jaccard", "micro_jaccard", "hamming_loss", "chapter_block_accuracy", "chapter_block_macro_f1", "source_transfer_label_accuracy", "source_transfer_label_recall")
STANDARD = (
    "accuracy", "exact_match", "macro_f1", "sample_f1", "sample_jaccard", "micro_jaccard", "hamming_loss", "chapter_block_accuracy", "chapter_block_macro_f1",
    "source_transfer_label_accuracy", "source_transfer_label_recall", "macro_precision", "macro_recall", "micro_precision", "micro_recall", "micro_f1", "hamming_score",
    "label_count_mae", "n", "chapter_block_exact_match", "chapter_block_macro_precision", "chapter_block_macro_recall", "chapter_block_micro_precision",
    "chapter_block_micro_recall", "chapter_block_micro_f1", "chapter_block_sample_precision", "chapter_block_sample_recall", "chapter_block_sample_f1",
    "chapter_block_micro_jaccard", "chapter_block_sample_jaccard", "source_transfer_label_sample_count", "source_transfer_label_sample_rate",
    "source_transfer_label_true_count", "source_transfer_label_macro_f1", "source_transfer_label_chapter_block_accuracy", "source_transfer_label_chapter_block_macro_f1",
    "same_source_label_sample_count", "same_source_label_sample_rate", "same_source_label_true_count", "same_source_label_accuracy", "same_source_label_recall",
    "same_source_label_macro_f1", "same_source_label_chapter_block_accuracy", "same_source_label_chapter_block_macro_f1", "unseen_label_sample_count",
    "unseen_label_sample_rate", "unseen_label_true_count", "unseen_label_accuracy", "unseen_label_recall", "unseen_label_macro_f1", "unseen_label_chapter_block_accuracy",
    "unseen_label_chapter_block_macro_f1", "seen_string_count", "seen_string_rate", "seen_accuracy", "seen_exact_match", "seen_macro_f1", "seen_sample_f1",
    "seen_sample_jaccard", "unseen_string_count", "unseen_string_rate", "unseen_accuracy", "unseen_exact_match", "unseen_macro_f1", "unseen_sample_f1",
    "unseen_sample_jaccard",
)
PREFIXES = ("per_source_", "chapter_", "block_")


def filter_metrics(long: DataFrame, mode: str = "standard", save_metric: str | None = None, prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    """The metrics of a mode, the one that models are saved by, and those of sources and levels (by prefix)."""
    if mode not in ("core", "standard", "all"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "all":
        return long
    keep = F.col("metric").isin(*(CORE if mode == "core" else STANDARD), *([save_metric.strip().lower()] if save_metric else []))
    for p in prefixes:
        keep = keep | (F.col("metric").startswith(p) & ~F.col("metric").startswith("chapter_block_"))
    return long.where(keep)


def error_pairs(df: DataFrame, id_col: str, n: int = 3) -> DataFrame:
    """Counts of (true, predicted) prefix sets of wrong records, with the first example and the share."""
    cut = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.substring(x, 1, n)))), ",")
    wrong = df.select(id_col, cut("gold").alias("true_blocks"), cut("pred").alias("pred_blocks")).where("true_blocks <> pred_blocks")
    counts = wrong.groupBy("true_blocks", "pred_blocks").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("example"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("true_blocks", "pred_blocks", "n", "example", ratio(F.col("n"), F.col("total")).alias("share"))  # the total is one row


def block_misses(df: DataFrame, n: int = 3) -> DataFrame:
    """For each true prefix: occurrences, misses and recall; and for each predicted one, false positives and precision."""
    cut = lambda c: F.array_distinct(F.transform(c, lambda x: F.substring(x, 1, n)))
    s = class_stats(df.withColumns({"gold": cut("gold"), "pred": cut("pred")}))
    return s.select(F.col("code").alias("block"), "gold_total", (F.col("gold_total") - F.col("tp")).alias("misses"), ratio(F.col("tp"), F.col("gold_total")).alias("recall"), "pred_total", (F.col("pred_total") - F.col("tp")).alias("false_positives"), ratio(F.col("tp"), F.col("pred_total")).alias("precision"))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.coalesce(pred, F.lit("(none)")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def top_confusions(counts: DataFrame, k: int) -> DataFrame:
    return counts.where("gold <> pred").orderBy(F.desc("n"), "gold", "pred").limit(k)


def per_class_accuracy(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gold").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def confusion_matrix(df: DataFrame, gold: str, pred: str, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold")).pivot(pred, list(labels)).count().na.fill(0)


def cardinality_breakdown(df: DataFrame) -> DataFrame:
    d = record_scores(df)
    return d.groupBy(F.col("_g").alias("gold_size")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(((F.col("_tp") == F.col("_g")) & (F.col("_tp") == F.col("_p"))).cast("int")).alias("exact"), F.round(F.avg("f1"), 9).alias("mean_f1"),
        F.count_if(F.col("_p") > F.col("_g")).alias("over"), F.count_if(F.col("_p") < F.col("_g")).alias("under"),
    )


def bucketed(df: DataFrame, bucket: Column, names: Sequence[str], exact: Column, f: Column) -> DataFrame:
    """n, exact rate and mean F1 of each named bucket; empty buckets are there with n 0."""
    spark = df.sparkSession
    stats = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(exact).alias("exact_rate"), F.round(F.avg(f), 9).alias("mean_f1"))
    return spark.createDataFrame([(x,) for x in names], "bucket string").join(stats, "bucket", "left").na.fill(0, ["n"])


def error_breakdown(df: DataFrame, error: str, words: int = 6) -> DataFrame:
    return df.where(F.col(error).isNotNull()).groupBy(F.array_join(F.slice(F.split(error, " "), 1, words), " ").alias("error")).agg(F.count(F.lit(1)).alias("n"))


def baseline_summary(df: DataFrame, source: str = "source_id", invalid: str = "n_invalid", error: str = "error", cost: str = "cost", elapsed: str = "latency") -> DataFrame:
    """One row a source and one for all: the metric set, exact matches, no-answer and error counts and rates, invalid codes, costs, times, classes."""
    d = with_total(df, source)
    classes = d.select(source, F.explode("pred").alias("c")).groupBy(source).agg(F.countDistinct("c").alias("predicted_classes"))
    none, bad = F.size("pred") == 0, F.col(error).isNotNull()
    rest = d.withColumn("_hit", same_set(d).cast("int")).groupBy(source).agg(
        F.sum("_hit").alias("exact_matches"), F.count_if(none).alias("no_answer"), F.avg(none.cast("int")).alias("no_answer_rate"), F.count_if(bad).alias("errors"), F.avg(bad.cast("int")).alias("error_rate"), F.sum(invalid).alias("invalid_codes"),
        F.avg((F.col(invalid) > 0).cast("int")).alias("invalid_rate"), F.sum(cost).alias("cost_total"), F.avg(cost).alias("cost_mean"), F.sum(elapsed).alias("elapsed_total"), F.avg(elapsed).alias("elapsed_mean"),
    )
    figures = metric_set(d, [source])
    return on_slices(on_slices(figures, rest, [source]), classes, [source], "left").na.fill(0, ["predicted_classes"])


def per_source_accuracy(df: DataFrame, source: str) -> DataFrame:
    """n, correct, accuracy and macro F1 of each source and of all, in one pass over the records."""
    d = with_total(df, source)
    hits = d.withColumn("_hit", same_set(d).cast("int")).groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("correct"), F.avg("_hit").alias("accuracy"))
    return on_slices(hits, macro(d, [source]).select(source, "macro_f1"), [source])


def sample_failures(df: DataFrame, wrong: Column, id_col: str, k: int) -> DataFrame:
    return df.where(wrong).orderBy(id_col).limit(k)


def cost_latency(df: DataFrame, cost: str, latency: str) -> DataFrame:
    return df.agg(F.sum(cost).alias("cost_total"), F.avg(cost).alias("cost_mean"), F.max(cost).alias("cost_max"), F.avg(latency).alias("latency_mean"), F.max(latency).alias("latency_max"))


def prefix_accuracy(df: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Chapter and category match rates over valid predictions."""
    same = lambda n: F.avg((F.substring(gold, 1, n) == F.substring(pred, 1, n)).cast("int"))
    return df.where(F.col(pred).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), same(1).alias("chapter_accuracy"), same(5).alias("category_accuracy"))


def metrics_excluding(df: DataFrame, source_col: str, source: str) -> DataFrame:
    """Headline metrics with and without one source."""
    both = df.withColumn("slice", F.explode(F.when(F.col(source_col) == source, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("without")))))
    return metric_set(both, ["slice"])


def aliasing_check(metrics: DataFrame, key: str) -> DataFrame:
    """Pairs of slices with the same figures to twelve decimals: a sign of aliased splits."""
    names = [c for c in metrics.columns if c != key]
    tag = F.concat_ws("|", *[F.coalesce(F.round(F.col(c).cast("double"), 12).cast("string"), F.lit("-")) for c in names])
    return metrics.groupBy(tag.alias("figures")).agg(F.array_sort(F.collect_set(key)).alias("slices")).where(F.size("slices") > 1)


def _traced(log: DataFrame) -> Column:
    """Whether a row of a result log left anything but an error."""
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0 if c in log.columns else F.lit(False)
    return some("codes") | some("invalid_codes") | (F.coalesce("raw", F.lit("")) != "") | (F.coalesce("cost", F.lit(0.0)) > 0) | (F.coalesce("turns", F.lit(0)) > 0)


def _silent(log: DataFrame) -> Column:
    return (F.coalesce("error", F.lit("")) != "") & ~_traced(log)


def scrub(log: DataFrame, id_col: str, line: str) -> DataFrame:
    """The best row of each record: rows that are errors without any trace go; valid codes, then cost, then the earlier line decide.

    log has codes (an array), raw, cost, turns and error, and may have invalid_codes.
    """
    order = Window.partitionBy(id_col).orderBy(F.desc((F.size("codes") > 0).cast("int")), F.desc(F.coalesce("cost", F.lit(0.0))), line)
    return log.where(~_silent(log)).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


# Reasons of dropped rows, by what the lower-cased error holds; the first that fits counts.
SILENT_REASONS = {"exit_1": "exit 1", "timeout": "timeout", "unparseable_response": "json", "reported_error": "reported error"}


def scrub_audit(log: DataFrame, id_col: str, source: str = "source_id") -> DataFrame:
    """(kind, key, n): rows read, kept, dropped and repeated, and the dropped ones by reason and by source."""
    error, reason = F.lower(F.trim("error")), None
    for name, part in SILENT_REASONS.items():
        reason = F.when(error.contains(part), name) if reason is None else reason.when(error.contains(part), name)
    d = log.select(id_col, _silent(log).alias("gone"), reason.otherwise("other").alias("reason"), F.coalesce(source, F.lit("")).alias("source"))
    d = settled(d)  # few and narrow columns, read by both counts
    ids = d.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.max((~F.col("gone")).cast("int")).alias("kept"))
    known = F.col(id_col).isNotNull()
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count_if(known).alias("ids"), F.count_if(known & (F.col("kept") == 1)).alias("kept"))
    rows = {"lines": F.col("lines"), "kept": F.col("kept"), "dropped": F.col("lines") - F.col("kept"), "repeated": F.col("lines") - F.col("ids")}
    counts = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(k).alias("key"), v.alias("n")) for k, v in rows.items()])).alias("x")).select("x.*")
    each = d.where("gone").select(F.explode(F.array(F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("key")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")))).alias("x"))
    return counts.unionByName(each.groupBy("x.kind", "x.key").agg(F.count(F.lit(1)).alias("n")))
