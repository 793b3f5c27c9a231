"""Code curation: harmonisation against a code book and transfer table, ordered rules, exact overrides."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.scalars import extract_field, normalise_shape


def ambiguous(transfer: DataFrame, old: str = "old_code", new: str = "new_code") -> DataFrame:
    """Old codes with more than one new code."""
    return transfer.groupBy(old).agg(F.array_sort(F.collect_set(new)).alias("targets")).where(F.size("targets") > 1)


def assert_functional(transfer: DataFrame, old: str = "old_code", new: str = "new_code") -> DataFrame:
    bad = ambiguous(transfer, old, new).orderBy(old).limit(5).collect()
    if bad:
        raise ValueError("ambiguous transfer: " + "; ".join(f"{r[0]} -> {', '.join(r[1])}" for r in bad))
    return transfer


def harmonise(df: DataFrame, codebook: DataFrame, transfer: DataFrame, codes: str = "y_codes", key: str = "record_id", max_labels: int | None = None) -> DataFrame:
    """Shape, transfer and check each code; rows with an unknown code, none or too many are dropped.

    Codes are looked up one row each, so the code book is joined as Spark sees fit at its size; order is
    kept and repeats go. Lists are known by key and codes together, so rows of one key, or of none, keep their own.
    """
    lists = df.select(F.col(key).alias("_key"), F.col(codes).alias("_own")).distinct()
    each = lists.select("_key", "_own", F.posexplode("_own").alias("pos", "raw")).withColumn("code", normalise_shape(F.upper(F.trim("raw"))))
    moved = each.join(transfer.select(F.col("old_code").alias("code"), "new_code"), "code", "left").withColumn("final", F.coalesce("new_code", "code"))
    known = moved.join(codebook.select(F.col("code").alias("final"), F.lit(True).alias("known")).distinct(), "final", "left")
    back = known.groupBy("_key", "_own").agg(F.every(F.coalesce("known", F.lit(False))).alias("_all"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "final"))), lambda x: x["final"])).alias("_codes"))
    good = back.where("_all AND size(_codes) > 0" + (f" AND size(_codes) <= {max_labels}" if max_labels else ""))
    out = df.join(good.select("_key", "_own", "_codes"), F.col(key).eqNullSafe(F.col("_key")) & (F.col(codes) == F.col("_own")))
    return out.drop(codes, "_key", "_own").withColumnRenamed("_codes", codes).withColumn("label", F.array_join(codes, ","))


def harmonise_in_place(df: DataFrame, codebook: Sequence[str], transfer: dict[str, str], codes: str = "y_codes") -> DataFrame:
    """The same with a small code book as literals: stateless, so it also runs on streams."""
    known = F.array(*map(F.lit, codebook))
    moves = F.create_map(*[F.lit(x) for kv in transfer.items() for x in kv]) if transfer else F.create_map().cast("map<string,string>")
    final = F.array_distinct(F.transform(codes, lambda c: F.coalesce(F.try_element_at(moves, normalise_shape(F.upper(F.trim(c)))), normalise_shape(F.upper(F.trim(c))))))
    out = df.withColumn(codes, final)
    return out.where((F.size(codes) > 0) & F.forall(codes, lambda c: F.array_contains(known, c))).withColumn("label", F.array_join(codes, ","))


@dataclass(frozen=True)
class Rule:
    """New codes for the rows that meet all given selectors."""

    id: str
    new_codes: tuple[str, ...]
    sources: tuple[str, ...] = ()
    records: tuple[str, ...] = ()
    text: str | None = None
    old_codes: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()


def check_rules(rules: Sequence[Rule], max_labels: int = 3) -> Sequence[Rule]:
    """Ids are unique, each rule has a selector, patterns compile, new codes are few and distinct."""
    if len({r.id for r in rules}) != len(rules):
        raise ValueError("rule ids must be unique")
    for r in rules:
        if not (r.sources or r.records or r.text or r.old_codes or r.blocks):
            raise ValueError(f"rule {r.id} has no selector")
        if not 0 < len(set(r.new_codes)) == len(r.new_codes) <= max_labels:
            raise ValueError(f"rule {r.id} needs 1 to {max_labels} distinct codes")
        _compiled(r.text or "")
    return rules


def _compiled(pattern: str) -> None:
    """Raises for a pattern that doesn't compile where rules run, which is Java; without a session Python's rules stand in."""
    spark = SparkSession.getActiveSession()
    try:
        re.compile(pattern) if spark is None else spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e


def load_rules(spark: SparkSession, path: str, max_labels: int = 3) -> list[Rule]:
    """Rules of a TOML file with a list `rules`, in order, checked. The file is read whole through Spark."""
    import tomllib

    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rules = []
    for r in tomllib.loads(text).get("rules", []):
        known = {"id", "new_codes", "sources", "records", "text", "old_codes", "blocks"}
        if extra := set(r) - known:
            raise ValueError(f"rule {r.get('id')} has unknown keys {sorted(extra)}")
        rules.append(Rule(**{k: tuple(dict.fromkeys(v)) if isinstance(v, list) else v for k, v in r.items()}))
    return list(check_rules(rules, max_labels))


def load_overrides(df: DataFrame, max_labels: int = 3, separator: str = ",") -> DataFrame:
    """Overrides with distinct new codes; missing columns, repeated keys, or too many or no codes raise."""
    need = ["source_id", "record_id", "old_label", "new_label"]
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"overrides lack {missing}")
    codes = F.array_distinct(F.filter(F.transform(F.split("new_label", separator), lambda x: F.trim(x)), lambda x: x != ""))
    out = df.select("source_id", "record_id", "old_label", F.array_join(codes, separator).alias("new_label"), F.size(codes).alias("_n"))
    bad = out.where(~F.col("_n").between(1, max_labels)).limit(1).collect() or out.groupBy("source_id", "record_id").count().where("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"bad override of {bad[0]['source_id']}, {bad[0]['record_id']}")
    return out.drop("_n")


def apply_rules(df: DataFrame, rules: Sequence[Rule], codes: str = "y_codes", source: str = "source_id", record: str = "record_id", main: Column | None = None) -> DataFrame:
    """The first rule that matches decides; adds `rule` (null where nothing changes).

    Text patterns see the main field only: `main`, or the part of column text after `cod: `, or else the whole text.
    """
    check_rules(rules)
    new = name = None
    for r in rules:
        test = F.lit(True)
        for values, col in ((r.sources, source), (r.records, record)):
            if values:
                test = test & F.col(col).isin(*values)
        if r.text:
            test = test & F.coalesce(main if main is not None else extract_field("text", "cod: "), F.col("text"), F.lit("")).rlike(r.text)
        if r.old_codes:
            test = test & F.arrays_overlap(codes, F.array(*map(F.lit, r.old_codes)))
        if r.blocks:
            test = test & _in_blocks(codes, r.blocks)
        value = F.array(*map(F.lit, r.new_codes))
        new = F.when(test, value) if new is None else new.when(test, value)
        name = F.when(test, F.lit(r.id)) if name is None else name.when(test, F.lit(r.id))
    if new is None:
        return df.withColumn("rule", F.lit(None).cast("string"))
    out = df.withColumns({"_new": F.coalesce(new, F.col(codes)), "_rule": name})
    out = out.withColumn("rule", F.when(F.array_sort("_new") != F.array_sort(codes), F.col("_rule"))).withColumn(codes, F.col("_new")).drop("_new", "_rule")
    return out.withColumn("label", F.array_join(codes, ",")) if "label" in df.columns else out


def _in_blocks(codes: str, blocks: Sequence[str]) -> Column:
    return F.exists(codes, lambda c: F.substring(c, 1, 3).isin(*blocks))


def override_mismatches(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides whose old label isn't the record's label."""
    o = overrides.select("source_id", "record_id", "old_label")
    return df.join(o, ["source_id", "record_id"]).where("NOT (old_label <=> label)").select("source_id", "record_id", "label", "old_label")


def apply_overrides(df: DataFrame, overrides: DataFrame, codes: str = "y_codes", separator: str = ",") -> DataFrame:
    """Exact (source, record) overrides after the rules, of the label and, where there is such a column, of the codes; an old label that differs raises."""
    twice = overrides.groupBy("source_id", "record_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"override given twice: {twice[0][0]}, {twice[0][1]}")
    if bad := override_mismatches(df, overrides).limit(5).collect():
        raise ValueError(f"old labels differ: {[(r['source_id'], r['record_id']) for r in bad]}")
    o = overrides.select("source_id", "record_id", "new_label")
    out = df.join(o, ["source_id", "record_id"], "left")
    new = F.filter(F.transform(F.split("new_label", F.lit(f"\\Q{separator}\\E")), lambda x: F.trim(x)), lambda x: x != "")
    own = {codes: F.when(F.col("new_label").isNotNull(), new).otherwise(F.col(codes))} if codes in df.columns else {}
    return out.withColumns(own | {"label": F.coalesce("new_label", "label")}).drop("new_label")
