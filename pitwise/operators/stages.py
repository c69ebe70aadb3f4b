"""U8: scoring in stages, each with a durable table.

A stage's prompt may name any input column and the output of any earlier
stage.  Every stage appends its results to a table of its own; a run scores
only the (stage, key) pairs that are not there.  A stage is committed in
``commits`` parts by the hash of its keys, so a failed run loses one part at
most, and a lost executor only its tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwise.operators.scoring import Scorer, batch_score
from pitwise.sources.results import materialise, written

_NAME = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Stage:
    """``name`` is the column of its output; ``template`` holds ``{column}``
    for input columns and earlier stages' names."""

    name: str
    template: str
    scorer_factory: Callable[[], Scorer]

    @property
    def parts(self) -> list[str]:
        return list(dict.fromkeys(_NAME.findall(self.template)))


def filled(template: str) -> Column:
    """The template with its ``{column}`` parts put in once, from left to right
    (a part's own braces stay as they are); NULL parts are empty."""
    pieces, at = [], 0
    for m in _NAME.finditer(template):
        pieces += [F.lit(template[at:m.start()]), F.coalesce(F.col(m[1]).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*pieces, F.lit(template[at:]))


def _check(stages: Sequence[Stage], columns: list[str], keys: Sequence[str]) -> None:
    if missing := [k for k in keys if k not in columns]:
        raise ValueError(f"no key columns {missing}")
    known = set(columns)
    for s in stages:
        if s.name in known or f"{s.name}_error" in known:
            raise ValueError(f"stage {s.name!r} has the name of another column")
        if unknown := [p for p in s.parts if p not in known]:
            raise ValueError(f"stage {s.name!r} names {unknown}, which no input or earlier stage has")
        known |= {s.name, f"{s.name}_error"}


def _results(spark: SparkSession, path: str, stage: Stage, keys: Sequence[str]) -> DataFrame | None:
    """One row per key: its answer if any attempt gave one, else its last error text in order."""
    if not written(spark, path):
        return None
    got = spark.read.parquet(path).groupBy(*keys).agg(
        F.min(F.struct(F.col("error").isNotNull().alias("failed"), F.col("response").alias("r"), F.col("error").alias("e"))).alias("b"))
    return got.select(*keys, F.col("b.r").alias(stage.name), F.col("b.e").alias(f"{stage.name}_error"))


def run_stages(df: DataFrame, stages: Sequence[Stage], folder: str, *, keys: Sequence[str], commits: int = 1, retry_errors: bool = False,
               **options) -> DataFrame:
    """The keys and, per stage, its output and error (NULL where it succeeded).

    ``folder`` keeps the inputs and one table per stage; calling again with the
    same folder resumes.  ``keys`` name a row (not NULL; of rows that repeat
    them one is scored); ``retry_errors`` scores rows again whose stage failed.
    A later stage runs for rows whose earlier stage failed too, with an empty
    text in its place.  ``options`` go to ``batch_score``."""
    _check(stages, df.columns, keys)
    spark, keys = df.sparkSession, list(keys)
    needed = list(dict.fromkeys([*keys, *(p for s in stages for p in s.parts if p in df.columns)]))
    others = [c for c in needed if c not in keys]
    base = df.select(*needed).where(F.concat(*(F.col(k).cast("string") for k in keys)).isNotNull())
    if others:
        base = base.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__o")).select(*keys, "__o.*")
    else:
        base = base.distinct()
    folder = folder.rstrip("/")
    inputs = materialise(spark, f"{folder}/inputs", lambda: base)
    names = [s.name for s in stages]
    for i, stage in enumerate(stages):
        path = f"{folder}/stage-{i + 1}-{stage.name}"
        rows = inputs
        for j in [k for k in range(i) if names[k] in stage.parts]:
            rows = rows.join(_results(spark, f"{folder}/stage-{j + 1}-{names[j]}", stages[j], keys).drop(f"{names[j]}_error"), keys, "left")
        for part in range(commits):
            todo = rows.where(F.pmod(F.xxhash64(*keys), F.lit(commits)) == part) if commits > 1 else rows
            if written(spark, path):
                done = spark.read.parquet(path)
                todo = todo.join((done.where("error is null") if retry_errors else done).select(*keys).distinct(), keys, "left_anti")
            scored = batch_score(todo.select(*keys, filled(stage.template).alias("prompt")), stage.scorer_factory, keys=keys,
                                 response_col="response", error_col="error", **options)
            scored.write.mode("append").parquet(path)
    out = inputs.select(*keys)
    for i, stage in enumerate(stages):
        out = out.join(_results(spark, f"{folder}/stage-{i + 1}-{stage.name}", stage, keys), keys, "left")
    return out
