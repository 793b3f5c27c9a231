"""From canonical records to prepared splits: one lazy plan with a `split` column, written once by the caller."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import augment as A
from codeloom.operators import splits as E


@dataclass(frozen=True)
class Plan:
    """What to hold out, leave out, sample, split, synthesise, balance and inject; the last three in train only.

    `inject` is the least number of code-book rows for each label, `inject_steps` how many perturbations a copy gets.
    """

    sizes: dict[str, float] = field(default_factory=lambda: {"train": 0.9, "val": 0.05, "test": 0.05})
    holdout: str | None = None
    holdout_eval: float | None = None
    exclude: tuple[str, ...] = ()
    fraction: float = 1.0
    multi_ratio: float = 0.0
    floor: int = 0
    decay: float = 0.0
    perturb: float = 0.0
    inject: int = 0
    inject_steps: int = 1
    inject_names: tuple[str, ...] = tuple(A.REGISTRY)
    seed: int = 333


PROVENANCE = ("synthetic", "perturbed", "injected")


def balance_report(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """Rows, classes, and least and median class count before and after balancing."""
    from codeloom.operators.profile import count_summary

    def one(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        return count_summary(counts).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")))).select(F.lit(name).alias("stage"), "rows", "classes", "least", "median", "most")  # one row each

    return one(before, "before").unionByName(one(after, "after"))


def balance_policy(train: DataFrame, plan: Plan, id_col: str, text: str, separator: str = ",") -> DataFrame:
    """Raises single-label real classes to the floor and perturbs a fraction of such rows in place."""
    own = train.where(~F.col("synthetic") & ~F.col("label").contains(separator)).drop("synthetic", "perturbed")
    rest = train.where(F.col("synthetic") | F.col("label").contains(separator))
    if plan.floor:
        counts = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        own = A.upsample(own, A.floor_targets(counts, plan.floor, plan.decay), "label", id_col, text, seed=plan.seed)
    else:
        own = own.withColumns({"synthetic": F.lit(False), "perturbed": F.lit(False)})
    if plan.perturb:
        done = A.perturb_fraction(own.withColumnRenamed("perturbed", "_before"), id_col, text, plan.perturb, where=~F.col("synthetic"), seed=plan.seed)
        own = done.withColumn("perturbed", F.col("perturbed") | F.col("_before")).drop("_before")
    return own.unionByName(rest, allowMissingColumns=True)


def prepare_splits(df: DataFrame, plan: Plan, id_col: str = "record_id", text: str = "text", group: Column | None = None, codebook: DataFrame | None = None) -> DataFrame:
    """Rows of (records' columns, split, provenance flags). With `group`, rows of a group stay on one side."""
    rest, held = (df, None) if plan.holdout is None else E.partition_holdout(df, plan.holdout)
    if plan.exclude:
        rest = E.exclude_sources(rest, plan.exclude)
    if plan.fraction < 1:
        rest = E.sample_fraction(rest, id_col, plan.fraction, plan.seed)
    split = E.random_split(rest, id_col, plan.sizes, plan.seed) if group is None else E.grouped_split(rest, group, plan.sizes, plan.seed)
    split = split.withColumns({c: F.lit(False) for c in PROVENANCE})
    train, others = split.where("split = 'train'"), split.where("split <> 'train'")
    if plan.multi_ratio:
        single = train.where(~F.col("label").contains(","))
        n = max(1, round(single.count() * plan.multi_ratio))
        made = A.synthesise(single, n, "label", id_col, text, "source_id", sizes=A.label_counts(train), seed=plan.seed)
        made = A.shuffle_labels(made, id_col, "y_codes", plan.seed)
        made = made.withColumns({"split": F.lit("train"), "synthetic": F.lit(True), "perturbed": F.lit(False), "injected": F.lit(False)})
        train = train.unionByName(made, allowMissingColumns=True)
    if plan.floor or plan.perturb:
        train = balance_policy(train, plan, id_col, text)
    if plan.inject and codebook is not None:
        extra = A.inject_codebook(codebook.limit(0).select(id_col, "label", text), codebook.select(id_col, "label", text), text, "label", id_col, plan.inject, k=plan.inject_steps, seed=plan.seed, names=plan.inject_names)
        train = train.unionByName(extra.withColumn("split", F.lit("train")), allowMissingColumns=True)
    out = train.unionByName(others, allowMissingColumns=True)
    if held is not None:
        parts = [("holdout", held)]
        if plan.holdout_eval is not None:
            parts.append(("holdout_eval", E.holdout_eval_sample(held, id_col, plan.holdout_eval, plan.seed)))
        for name, part in parts:
            out = out.unionByName(part.withColumns({"split": F.lit(name)} | {c: F.lit(False) for c in PROVENANCE}), allowMissingColumns=True)
    return out


def split_counts(prepared: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return prepared.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in PROVENANCE])
