"""Readers and writers: registers by position, code books, scoring input, tolerant JSON lines, stores by fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloom.functions import scalars as S
from codeloom.sources import delimited, store

#: The canonical record.
RECORD = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c == "y_codes" else T.StringType()) for c in ("source_id", "record_id", "source_path", "text", "y_codes", "label")])
SEPARATORS = {"csv": ",", "tsv": "\t", "txt": "\t"}


@dataclass(frozen=True)
class Mapping:
    """Column positions of a register."""

    text: int
    code: int | None = None
    codes: tuple[int, ...] = ()
    sex: int | None = None
    sex_map: dict[str, str] = field(default_factory=dict)
    age: int | None = None
    record_id: int | None = None
    skip_rows: tuple[int, ...] = ()


@dataclass(frozen=True)
class Source:
    """A register: where and how to read it."""

    id: str
    path: str
    mapping: Mapping
    file_type: str | None = None
    sep: str | None = None
    encoding: str = "UTF-8"
    header: bool = True
    skip_rows: tuple[int, ...] = ()
    enabled: bool = True


def file_type(path: str, given: str | None = None) -> str:
    kind = (given or path.rsplit(".", 1)[-1]).lower()
    if kind not in (*SEPARATORS, "parquet", "jsonl", "json"):
        raise ValueError(f"unknown file type {kind!r}")
    return kind


def read_delimited(spark: SparkSession, source: Source) -> DataFrame:
    """All columns as strings, fields as Python's csv reader has them. Rows longer than the first are dropped, shorter ones filled with nulls.

    Rows keep their file order in `_row` (from 0 after the header).
    """
    kind = file_type(source.path, source.file_type)
    if kind not in SEPARATORS:
        raise ValueError(f"{kind} isn't delimited")
    return delimited.read(spark, source.path, source.sep or SEPARATORS[kind], source.encoding, source.header)


def with_row_number(df: DataFrame, name: str = "_row") -> DataFrame:
    """Rows numbered in file order, for a frame read from files without a shuffle.

    The place in a partition is known where it is read; a second pass counts the partitions' rows (a row a
    partition, joined as Spark sees fit). Both passes scan the same files, so they see the same partitions.
    """
    d = df.withColumn("_mono", F.monotonically_increasing_id()).withColumns({"_p": F.shiftright("_mono", 33), "_at": F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))})
    # The first column is read too: a scan of the malformed-row column alone isn't allowed.
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.count(df.columns[0]).alias("_c"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.where("_c >= 0").select("_p", before.alias("_base"))  # one row a partition
    return d.join(bases, "_p").withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).select(*df.columns, name)


def drop_positions(df: DataFrame, positions: Sequence[int], name: str = "_row") -> DataFrame:
    """Leaves out the rows at these positions and counts the others anew, from the positions alone."""
    if not positions:
        return df
    gone = F.array(*[F.lit(p).cast("long") for p in sorted(set(positions))])
    left = df.where(~F.array_contains(gone, F.col(name)))
    return left.withColumn(name, F.col(name) - F.size(F.filter(gone, lambda p: p < F.col(name))))


def load_source(spark: SparkSession, source: Source, fields: Sequence[str] = ("cod", "age", "sex"), max_labels: int = 3, drop_empty: bool = True) -> DataFrame:
    """Canonical records of one register: rows skipped by position, codes collected and filtered, text built."""
    m = source.mapping
    raw = read_delimited(spark, source)
    raw = drop_positions(raw, [*m.skip_rows, *source.skip_rows])
    pos = raw.drop("_row")
    code = lambda i: F.when(S.null_if_missing(S.pick(pos, i)).isNotNull(), S.normalise_code(S.pick(pos, i)))
    codes = S.collect_codes([code(i) for i in m.codes] or [F.lit(None).cast("string")], code(m.code), max_labels)
    values = {"cod": S.dots_to_spaces(S.null_if_missing(S.pick(pos, m.text))), "age": S.format_age(S.pick(pos, m.age)), "sex": S.map_category(S.pick(pos, m.sex), m.sex_map or {"": S.UNKNOWN})}
    text = S.build_text([(f, values[f]) for f in fields], "cod")
    out = raw.select(
        F.lit(source.id).alias("source_id"), F.coalesce(S.null_if_missing(S.pick(pos, m.record_id)), F.concat_ws(":", F.lit(source.id), F.col("_row").cast("string"))).alias("record_id"),
        F.lit(source.path).alias("source_path"), text.alias("text"), codes.alias("y_codes"),
    )
    return filter_cardinality(out, max_labels, drop_empty).withColumn("label", F.array_join("y_codes", ","))


def filter_cardinality(df: DataFrame, max_labels: int, drop_empty: bool = True, codes: str = "y_codes") -> DataFrame:
    """Rows with too many labels are dropped, not cut; so are, if asked, those without any."""
    return df.where(F.size(codes).between(1 if drop_empty else 0, max_labels))


def build_canonical(spark: SparkSession, sources: Sequence[Source], codebook: DataFrame | None = None, transfer: DataFrame | None = None, rules: Sequence = (), overrides: DataFrame | None = None, mappings: dict[str, Mapping] | None = None, **kw) -> DataFrame:
    """All enabled sources, then harmonised, then standardised by rules and overrides; no source gives an empty typed frame.

    mappings replace the sources' own, by source id.
    """
    from codeloom.operators.curate import apply_overrides, apply_rules, harmonise

    sources = [replace(s, mapping=(mappings or {}).get(s.id, s.mapping)) for s in sources]

    frames = [load_source(spark, s, **kw) for s in sources if s.enabled]
    if not frames:
        return spark.createDataFrame([], RECORD)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if codebook is not None:
        out = harmonise(out, codebook, transfer if transfer is not None else spark.createDataFrame([], "old_code string, new_code string"))
    main = F.coalesce(S.extract_field(F.col("text"), "cod: "), F.col("text"))
    out = apply_rules(out, rules, main=main) if rules else out
    return out if overrides is None else apply_overrides(out, overrides)


def load_codebook(df: DataFrame, required: Sequence[str] = ("code",)) -> DataFrame:
    """Trimmed single-line cells; rows whose code has the right shape. Missing columns raise."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"code book lacks {missing}")
    clean = df.select(*[F.trim(F.regexp_replace(F.col(c).cast("string"), r"[\t\n\r]+", " ")).alias(c) for c in df.columns])
    return clean.where(S.is_valid_code("code"))


def read_scoring_input(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """csv, tsv, parquet, jsonl or txt (a row a line); blank ids become row-000001 and so on; null texts are empty."""
    kind = file_type(path)
    if kind == "txt":
        df = spark.read.text(path).withColumnRenamed("value", text)
    elif kind in SEPARATORS:
        df = delimited.read(spark, path, SEPARATORS[kind])
    else:
        df = spark.read.parquet(path) if kind == "parquet" else spark.read.json(path)
    if text not in df.columns:
        raise ValueError(f"no column {text!r}")
    if df.isEmpty():
        raise ValueError("no rows to score")
    own = F.trim(F.col("record_id").cast("string")) if "record_id" in df.columns else F.lit("")
    d = df.withColumn("_id", own)
    d = d if kind in SEPARATORS else with_row_number(d)
    row = F.concat(F.lit("row-"), S.padded(F.col("_row") + 1, 6))
    return d.withColumns({"record_id": F.when(F.coalesce("_id", F.lit("")) == "", row).otherwise(F.col("_id")), text: F.coalesce(F.col(text).cast("string"), F.lit(""))}).drop("_id", "_row")


def write_by_extension(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    kind = file_type(path)
    if kind in SEPARATORS:
        # Quotes are doubled and white space is kept, as other csv readers expect.
        df.write.mode(mode).options(sep=SEPARATORS[kind], header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """Lines that parse; missing fields get defaults."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for c, v in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return df


def fingerprint(signatures: Sequence[dict], settings: dict, ignore: Sequence[str] = ()) -> str:
    """16 hex digits of the canonical JSON of what determines the content."""
    relevant = {k: v for k, v in settings.items() if k not in ignore}
    return hashlib.sha256(json.dumps({"sources": sorted(signatures, key=lambda s: json.dumps(s, sort_keys=True)), "settings": relevant}, sort_keys=True).encode()).hexdigest()[:16]


def signature(spark: SparkSession, path: str) -> list[dict]:
    """Path, size and time of a source's files, through Spark's own listing."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime").collect()
    return [{"path": r[0], "size": r[1], "mtime": r[2].isoformat()} for r in sorted(rows)]


def materialise_by_fingerprint(df_of, root: str, key: str, spark: SparkSession, splits: Sequence[str] = (), settings: dict | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """The stored result of this key, if one was committed with these settings; else a new one (see store.kept)."""
    return store.kept(spark, root, key, df_of, settings, splits, ignore)


def write_split_bundle(predictions: DataFrame, rows: DataFrame, curves: DataFrame, root: str) -> None:
    predictions.write.mode("overwrite").json(f"{root}/predictions")
    rows.write.mode("overwrite").parquet(f"{root}/rows")
    curves.write.mode("overwrite").json(f"{root}/curves")


def bundle_problems(spark: SparkSession, root: str, id_col: str) -> list[str]:
    """What a bundle lacks: equal ids on both sides and some curve points."""
    p, r = spark.read.json(f"{root}/predictions"), spark.read.parquet(f"{root}/rows")
    out = []
    if p.select(F.col(id_col).cast("string")).exceptAll(r.select(F.col(id_col).cast("string"))).count() or p.count() != r.count():
        out.append("predictions and rows differ")
    if spark.read.json(f"{root}/curves").isEmpty():
        out.append("no curve points")
    return out


def settings_of(source: Source) -> dict:
    return asdict(source)
