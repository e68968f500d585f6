"""Poses and motion classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.actions import FORWARD, LEFT, RIGHT
from wayline.operators.frames import KEY
from wayline.operators.ordered import IDX, neighbours, prefix_sums


def motion_angle(rotation: Column | str) -> Column:
    """Degrees of rotation, -asin of row 2, column 0; 0 without a pose."""
    rotation = F.col(rotation) if isinstance(rotation, str) else rotation
    entry = F.get(F.get(rotation, F.lit(2)), F.lit(0))
    return F.coalesce(F.degrees(-F.asin(entry)), F.lit(0.0))


def motion_class(rotation: Column | str, threshold: float = 7.0) -> Column:
    angle = motion_angle(rotation)
    return F.when(angle < -threshold, RIGHT).when(angle > threshold, LEFT).otherwise(FORWARD)


def dead_reckoning(df: DataFrame, key: Sequence[str] = KEY, step: float = 0.25, turn: int = 15, col: str = "action",
                   idx: str = IDX, block: int | None = None) -> DataFrame:
    """The n+1 poses (x, y, heading) reached by n actions from the origin."""
    a = F.col(col)
    delta = F.when(a == LEFT, turn).when(a == RIGHT, -turn).otherwise(0)
    turned = prefix_sums(df, key, {"_turned": delta}, True, idx, block)
    heading = F.pmod(F.col("_turned"), F.lit(360))
    rad = F.radians(heading.cast("double"))
    moved = prefix_sums(
        turned.withColumn("heading", heading), key,
        {"x": F.when(a == FORWARD, step * F.cos(rad)).otherwise(0.0),
         "y": F.when(a == FORWARD, step * F.sin(rad)).otherwise(0.0)}, True, idx, block)
    zero = F.struct(F.lit(0).cast("long").alias("pose_idx"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
                    F.lit(0).cast("long").alias("heading"))
    here = F.struct((F.col(idx) + 1).cast("long").alias("pose_idx"), "x", "y", F.col("heading").cast("long").alias("heading"))
    poses = F.when(F.col(idx) == 0, F.array(zero, here)).otherwise(F.array(here))
    return moved.select(*key, F.explode(poses).alias("_p")).select(*key, "_p.*")


def step_distance(poses: DataFrame, key: Sequence[str] = KEY, scale: float = 10.0, idx: str = "pose_idx",
                  block: int | None = None) -> DataFrame:
    """Scaled distance of each pose from the one before it."""
    near = neighbours(poses, key, {"_x": ("x", -1), "_y": ("y", -1)}, idx, block)
    dx, dy = (F.col("x") - F.col("_x")) * scale, (F.col("y") - F.col("_y")) * scale
    return near.where(F.col("_x").isNotNull()).select(*key, idx, F.sqrt(dx * dx + dy * dy).alias("distance"))
