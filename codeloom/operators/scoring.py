"""Batch scoring with a caller's function, and its output columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalars import parse_predictions

Scorer = Callable[[list[str]], Sequence[str]]


def score(df: DataFrame, scorer: Scorer, text: str, batch: int = 64, output: str = "raw_output") -> DataFrame:
    """Adds the scorer's output, in batches of a fixed size; another number of outputs than texts raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[str] = []
            texts = f[text].fillna("").tolist()
            for i in range(0, len(texts), batch):
                got = list(scorer(texts[i : i + batch]))
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError("the scorer must give one output a text")
                out += got
            yield f.assign(**{output: pd.Series(out, index=f.index, dtype=object)})

    return df.mapInPandas(run, _with(df, output))


def _with(df: DataFrame, output: str):
    from pyspark.sql.types import StringType, StructField, StructType

    return StructType([*df.schema.fields, StructField(output, StringType())])


def decoded(df: DataFrame, output: str = "raw_output", separator: str = ",") -> DataFrame:
    """Adds the parsed label, its count, and the invalid parts as JSON with their count."""
    p = parse_predictions(F.col(output), separator)
    d = df.withColumn("_p", p)
    return d.withColumns({"label": F.array_join("_p.valid", separator), "n_codes": F.size("_p.valid"), "invalid_codes": F.to_json("_p.invalid"), "n_invalid": F.size("_p.invalid")}).drop("_p")


def decoded_in_registry(df: DataFrame, registry: DataFrame, id_col: str, output: str = "raw_output", separator: str = ",", code: str = "code") -> DataFrame:
    """As `decoded`, and a code must also be in the registry to be valid. Ids must be unique.

    Codes are looked up one row each, so the registry is joined as Spark sees fit at its size.
    """
    shaped = parse_predictions(F.col(output), separator)
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(output), F.lit("")), F.lit(f"\\Q{separator}\\E")), lambda x: F.trim(x)), lambda x: x != "")
    each = df.select(F.col(id_col).alias("_id"), shaped.alias("_p"), parts.alias("_parts")).select("_id", F.col("_p.valid").alias("_valid"), F.posexplode("_parts").alias("_at", "_code"))
    known = registry.select(F.col(code).alias("_code"), F.lit(True).alias("_known")).distinct()
    each = each.join(known, "_code", "left").withColumn("_good", F.coalesce("_known", F.lit(False)) & F.array_contains("_valid", F.col("_code")))
    lists = each.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_at", "_code", "_good"))).alias("_all"))
    pick = lambda good: F.transform(F.filter("_all", lambda x: x["_good"] == good), lambda x: x["_code"])
    none = F.array().cast("array<string>")
    d = df.join(lists, F.col(id_col) == F.col("_id"), "left").withColumns({"_v": F.coalesce(pick(True), none), "_i": F.coalesce(pick(False), none)})
    return d.withColumns({"label": F.array_join("_v", separator), "n_codes": F.size("_v"), "invalid_codes": F.to_json("_i"), "n_invalid": F.size("_i")}).drop("_id", "_all", "_v", "_i")
