"""Seen and unseen slices, label origins and leakage between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.metrics import metric_set, ratio


def mark_seen(test: DataFrame, train: DataFrame, key: Column) -> DataFrame:
    """Adds `seen`: the key occurs in train. Distinct train keys are joined, so repeats don't multiply."""
    keys = train.select(key.alias("_k")).distinct().withColumn("_s", F.lit(True))
    return test.withColumn("_k", key).join(keys, "_k", "left").withColumn("seen", F.coalesce("_s", F.lit(False))).drop("_k", "_s")


def seen_unseen_metrics(test: DataFrame, train: DataFrame, key: Column, **kw) -> DataFrame:
    """Rows, share of all rows and metric_set of the seen and the unseen test rows."""
    figures = metric_set(mark_seen(test, train, key), ["seen"], **kw)
    total = figures.agg(F.sum("n").alias("_all"))
    return figures.crossJoin(F.broadcast(total)).withColumn("string_rate", ratio(F.col("n"), F.col("_all"))).drop("_all")  # at most two rows and one


def label_sources(train: DataFrame, codes: str = "gold", source: str = "source_id") -> DataFrame:
    return train.select(F.explode(codes).alias("code"), F.col(source).alias("source")).groupBy("code").agg(F.collect_set("source").alias("sources"))


def transfer_buckets(test: DataFrame, index: DataFrame, id_col: str, codes: str = "gold", source: str = "source_id") -> DataFrame:
    """(id, code, bucket): never in train, same source, or only other sources. A row may touch several buckets."""
    each = test.select(id_col, source, F.explode(codes).alias("code")).join(index, "code", "left")
    bucket = F.when(F.col("sources").isNull(), "never").when(F.array_contains("sources", F.col(source)), "same_source").otherwise("other_source")
    return each.select(id_col, "code", bucket.alias("bucket"))


def source_transfer_metrics(test: DataFrame, train: DataFrame, id_col: str, codes: str = "gold", source: str = "source_id", **kw) -> DataFrame:
    """For each bucket of transfer_buckets: rows that touch it and their share, labels in it and their recall, and the rows' metric_set.

    A row is counted in every bucket that one of its labels is in.
    """
    touched = transfer_buckets(test, label_sources(train, codes, source), id_col, codes, source)
    rows = test.join(touched.select(id_col, "bucket").distinct(), id_col)
    hit = touched.join(test.select(id_col, "pred"), id_col).groupBy("bucket").agg(F.count(F.lit(1)).alias("true_count"), F.avg(F.array_contains("pred", F.col("code")).cast("int")).alias("recall"))
    total = test.agg(F.count(F.lit(1)).alias("_all"))
    figures = metric_set(rows, ["bucket"], **kw).join(hit, "bucket")
    return figures.crossJoin(F.broadcast(total)).withColumn("sample_rate", ratio(F.col("n"), F.col("_all"))).drop("_all")  # at most three rows and one


def holdout_leakage(train: DataFrame, holdout: DataFrame, text: str, codes: str) -> DataFrame:
    """Counts and rates: inputs seen, (input, label) pairs seen, label occurrences and distinct labels seen."""
    mark = lambda df, name, *cols: df.select(*cols).distinct().withColumn(name, F.lit(1))
    label = F.array_join(F.array_sort(codes), ",").alias("_l")
    rows = holdout.select(F.col(text).alias("_t"), label)
    rows = rows.join(mark(train.select(F.col(text).alias("_t")), "a", "_t"), "_t", "left").join(mark(train.select(F.col(text).alias("_t"), label), "b", "_t", "_l"), ["_t", "_l"], "left")
    r = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("a").alias("inputs_seen"), F.count("b").alias("pairs_seen"))
    occ = holdout.select(F.explode(codes).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(mark(train.select(F.explode(codes).alias("c")), "s", "c"), "c", "left")
    o = occ.agg(F.sum("n").alias("labels"), F.sum(F.when(F.col("s") == 1, F.col("n")).otherwise(0)).alias("labels_seen"), F.count(F.lit(1)).alias("classes"), F.count("s").alias("classes_seen"))
    both = r.crossJoin(F.broadcast(o))  # one row each
    rate = lambda a, b: ratio(F.col(a), F.col(b)).alias(f"{a}_rate")
    return both.select("*", rate("inputs_seen", "rows"), rate("pairs_seen", "rows"), rate("labels_seen", "labels"), rate("classes_seen", "classes"))


def never_in(test: DataFrame, train: DataFrame, key: Column) -> DataFrame:
    return test.withColumn("_k", key).join(train.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def rare_slice(test: DataFrame, train: DataFrame, threshold: int, id_col: str, codes: str = "gold") -> DataFrame:
    """Rows with a gold code that train has fewer than `threshold` times."""
    counts = train.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    rare = test.select(id_col, F.explode(codes).alias("code")).join(counts, "code", "left").where(F.coalesce("n", F.lit(0)) < threshold).select(id_col).distinct()
    return test.join(rare, id_col, "left_semi")


def string_leakage(train: DataFrame, test: DataFrame, text: str) -> DataFrame:
    """Distinct strings of test, how many train has too, and their share."""
    both = test.select(text).intersect(train.select(text)).agg(F.count(F.lit(1)).alias("shared"))
    n = test.agg(F.countDistinct(text).alias("test_strings"))
    return n.crossJoin(F.broadcast(both)).withColumn("rate", ratio(F.col("shared"), F.col("test_strings")))  # one row each


def unknown_labels(df: DataFrame, codes: str, vocabulary: DataFrame) -> DataFrame:
    return df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(vocabulary.select("code"), "code", "left_anti")


def pending(requests: DataFrame, results: DataFrame, id_col: str) -> DataFrame:
    """Rows that have no result yet."""
    return requests.join(results.select(id_col).distinct(), id_col, "left_anti")
