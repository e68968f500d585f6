"""Judging how well an instruction agrees with actions, scenes and objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.text import build_prompt

INFO_TYPES = ["Action", "Scene", "Object"]


def explode_tasks(infos: DataFrame, path: str = "path", keep: Sequence[str] = ("instruction",)) -> DataFrame:
    """Three judging tasks per info, with id `<path>-<Type>`."""
    kinds = F.array(*[F.struct(F.lit(t).alias("info_type"), F.col(f"{t.lower()}_info").alias("info")) for t in INFO_TYPES])
    rows = infos.select(F.col(path).alias("info_key"), *keep, F.inline(kinds))
    return rows.withColumn("custom_id", F.concat_ws("-", "info_key", "info_type"))


def judge_prompts(tasks: DataFrame, template: str = "plain") -> DataFrame:
    return tasks.withColumn("prompt", build_prompt("info_type", "info", "instruction", template))


def info_scores(scored: DataFrame, info: str = "info_key", kind: str = "info_type", score: str = "score") -> DataFrame:
    """action, scene, object and their average per info; every info needs each task exactly once."""
    wide = scored.groupBy(info).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(F.col(kind) == t, F.col(score))).alias(t.lower()) for t in INFO_TYPES])
    whole = (F.col("_n") == 3)
    for t in INFO_TYPES:
        whole = whole & F.col(t.lower()).isNotNull()
    bad = F.raise_error(F.concat(F.lit("tasks do not match for "), F.col(info).cast("string"))).cast("double")
    act = F.when(whole, F.col("action")).otherwise(bad)
    return wide.select(info, act.alias("action"), "scene", "object").withColumn(
        "average", (F.col("action") + F.col("scene") + F.col("object")) / 3)


def consistency_scores(scored: DataFrame, info: str = "info_key", kind: str = "info_type", score: str = "score") -> DataFrame:
    """Mean of each score over the infos."""
    return info_scores(scored, info, kind, score).agg(*[F.avg(c).alias(c) for c in ("scene", "object", "action", "average")])
