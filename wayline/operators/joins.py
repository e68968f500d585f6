"""Joins between frames, labels, features, caches and instructions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.frames import KEY
from wayline.operators.ordered import IDX, running_offsets

MISSING_SYSTEM = "(Model instruction missing)"
NO_INSTRUCTION = "(No instruction available)"


def label_frames(frames: DataFrame, labels: DataFrame, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    return frames.join(labels, [*key, idx], "inner")


def skip_existing(work: DataFrame, done_txt: DataFrame, done_info: DataFrame | None = None,
                  on: Sequence[str] = ("episode_id", "inst_alias", "inst_id")) -> DataFrame:
    """Work items that lack an output; with `done_info` both outputs must exist to skip."""
    done = done_txt.select(*on).distinct()
    if done_info is not None:
        done = done.join(done_info.select(*on), list(on), "left_semi")
    return work.join(done, list(on), "left_anti")


def episode_manifest(df: DataFrame, ids: Sequence[str], batch_size: int = 32) -> DataFrame:
    """Freeze an order: global position `pos` (hash order of the ids) and its `batch_id`."""
    placed = running_offsets(df.withColumn("_g", F.lit(0)), ["_g"], ids, F.lit(1), "pos").drop("_g")
    return placed.withColumn("batch_id", F.floor(F.col("pos") / batch_size))


def resume(work: DataFrame, cache: DataFrame, on: Sequence[str] = ("info_key",)) -> tuple[DataFrame, DataFrame]:
    """(already scored, still to do) by info key.

    Equal cache rows count once; different ones of one key are an error, for nothing says
    which of them holds.
    """
    once = cache.distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    clash = F.raise_error(F.lit("a key is cached with different values")).cast("boolean")
    once = once.where(F.when(F.col("_n") == 1, True).otherwise(clash)).drop("_n")
    return work.join(once, list(on), "inner"), work.join(once, list(on), "left_anti")


def attach_instructions(paths: DataFrame, systems: Sequence[str], folders: DataFrame, instructions: DataFrame,
                        path: str = "path", system: str = "system", text: str = "text") -> DataFrame:
    """One row per path and system; says whether the system's folder or its text is missing."""
    names = F.explode(F.array(*[F.lit(s) for s in systems]))
    grid = paths.select(path).withColumn(system, names)
    out = (
        grid.join(folders.select(path, system, F.lit(True).alias("_dir")), [path, system], "left")
        .join(instructions.select(path, system, text), [path, system], "left")
    )
    shown = F.when(F.col("_dir").isNull(), MISSING_SYSTEM).otherwise(F.coalesce(F.col(text), F.lit(NO_INSTRUCTION)))
    return out.select(path, system, shown.alias(text))


def union_splits(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
