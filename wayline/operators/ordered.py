"""Ordered sequences that stay evenly spread over the cluster.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task. That is the
best plan while every key is small: one exchange by key serves a whole chain of
sequence operators. Keys may hold any share of the data, though, so `sequence_block`
first measures the largest key. If it is too large for a task, operators work on
blocks of `BLOCK` consecutive positions: one task sees ``(key, block)``, border rows
are copied to the neighbouring block, and what crosses blocks (open runs, running
sums) is carried through a summary with one row per block.

``block=None`` selects the plain plan, a number the blocked one; results are equal.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096
HOT_ROWS = 65536
#: Rows of one task on average that sorts whole keys; a table of more rows gets more tasks.
TASK_ROWS = 100_000

IDX = "frame_idx"
# the folder of a session on one machine that names none
_OWN: list[str] = []


def _key_window(key: Sequence[str], *more: str):
    return Window.partitionBy(*key, *more)


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result once, so that its several consumers do not compute it again.

    It becomes a parquet table below the cluster's `spark.checkpoint.dir`, which also cuts
    the lineage.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below `spark.checkpoint.dir`.

    A cluster must name that folder, for its machines share no other. A session on one
    machine gets a folder that goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="wayline-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        root = _OWN[0]
    return f"{root.rstrip('/')}/wayline-{tag}-{uuid.uuid4().hex}"


def sequence_block(df: DataFrame, key: Sequence[str], hot_rows: int = HOT_ROWS) -> int | None:
    """None if every key fits a task, else `BLOCK`.

    The limit, `hot_rows`, doesn't depend on the size of the table. Costs one aggregation
    with map-side combine that reads the key columns only.
    """
    return BLOCK if _largest(df, key)[0] > hot_rows else None


def _largest(df: DataFrame, key: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key, and of all."""
    top, rows = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    return top or 0, rows or 0


def _dealt(df: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """Deal large tables by key to as many tasks as their rows ask for, so that what a task sorts doesn't grow with the table."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def number_rows(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], coarse: Column,
                name: str = IDX, hot_rows: int = HOT_ROWS, deal: Sequence[str] | None = None) -> DataFrame:
    """Add the 0-based position of each row inside its key.

    `coarse` is a column that never decreases along `order` (a day, a leading
    number). Keys of more than `hot_rows` rows are numbered one coarse bucket at a time
    and shifted by the rows of the earlier buckets. Others are dealt to tasks by the columns `deal` of the
    key (all of it; name those that are no constants, which Spark takes out of later steps).
    """
    top, rows = _largest(df, key)
    if top <= hot_rows:
        at = F.row_number().over(_key_window(key).orderBy(*order)).cast("long")
        return _dealt(df, deal or key, rows).withColumn(name, at - 1)
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > hot_rows).select(*key, F.lit(True).alias("_hot"))
    marked = df.join(hot, list(key), "left").withColumn("_c", F.when(F.col("_hot"), coarse))
    local = F.row_number().over(_key_window(key, "_c").orderBy(*order)).cast("long") - 1
    earlier = F.sum("_m").over(_key_window(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    shift = (
        marked.where(F.col("_hot"))
        .groupBy(*key, "_c")
        .agg(F.count(F.lit(1)).alias("_m"))
        .select(*key, "_c", F.coalesce(earlier, F.lit(0)).alias("_shift"))
    )
    return (
        marked.withColumn("_at", local)
        .join(shift, [*key, "_c"], "left")
        .withColumn(name, F.col("_at") + F.coalesce("_shift", F.lit(0)))
        .select(*df.columns, name)
    )


def hash_order(*key: Column | str) -> Column:
    """A fixed, arbitrary text order that spreads evenly over buckets."""
    return F.md5(F.concat_ws("@", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]))


#: Hexadecimal digits of the hash that each level of slices adds, and rows that a slice of the last level has on average.
SLICE_DIGITS, SLICE_ROWS = 3, 65536


def slice_levels(rows: int) -> int:
    """Levels of slices that leave no more than SLICE_ROWS rows to a slice: one up to 268 million rows, two up to 10^12."""
    levels = 1
    while rows > SLICE_ROWS * 16 ** (SLICE_DIGITS * levels):
        levels += 1
    return levels


def running_offsets(df: DataFrame, group: Sequence[str], ids: Sequence[str], size: Column, name: str = "offset",
                    rows: int | None = None) -> DataFrame:
    """Add the sum of `size` over all earlier rows of the group, in hash order of `ids`.

    The hash range is cut into equal slices, these again into slices, and so on, as deep as the number of
    rows asks for. A row's offset is what lies before its slice among the slices of each level, and
    before it inside the last one. No task ever sorts more than a slice, or the 4096 sums of the slices in one.
    `rows` is a known number of rows; without it they are counted.
    """
    levels = slice_levels(df.count() if rows is None else rows)
    slots = [f"_s{k}" for k in range(levels)]
    h = {f"_s{k}": F.substring("_h", 1 + SLICE_DIGITS * k, SLICE_DIGITS) for k in range(levels)}
    placed = df.withColumn("_h", hash_order(*ids)).withColumn("_size", size.cast("long")).withColumns(h)
    starts = placed.groupBy(*group, *slots).agg(F.sum("_size").alias("_sum"))
    for k in range(levels - 1, -1, -1):
        # what lies before a slice of this level, and the sums of the slices one level up
        level = starts if k == levels - 1 else starts.groupBy(*group, *slots[: k + 1]).agg(F.sum("_sum").alias("_sum"))
        earlier = Window.partitionBy(*group, *slots[:k]).orderBy(slots[k]).rowsBetween(Window.unboundedPreceding, -1)
        before = level.select(*group, *slots[: k + 1], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(f"_o{k}"))
        found = before if k == levels - 1 else found.join(before, [*group, *slots[: k + 1]])
    start = reduce(lambda a, b: a + b, [F.col(f"_o{k}") for k in range(levels)])
    inside = Window.partitionBy(*group, *slots).orderBy("_h", *ids).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .join(found.select(*group, *slots, start.alias("_start")), [*group, *slots])
        .withColumn(name, F.col("_start") + F.col("_in"))
        .select(*df.columns, name)
    )


def with_halo(df: DataFrame, before: int, after: int, idx: str = IDX, block: int = BLOCK) -> DataFrame:
    """Assign rows to blocks; copy border rows to the neighbours that need them.

    Adds `_b` (block) and `_own` (false on copies).
    """
    if max(before, after) > block:
        raise ValueError("the window is wider than a block")
    home = F.floor(F.col(idx) / block)
    place = F.col(idx) % block
    targets = [home]
    if after:
        targets.append(F.when((place < after) & (home > 0), home - 1))
    if before:
        targets.append(F.when(place >= block - before, home + 1))
    blocks = F.filter(F.array(*targets), lambda b: b.isNotNull()) if len(targets) > 1 else F.array(home)
    spread = df.withColumn("_home", home).withColumn("_b", F.explode(blocks))
    return spread.withColumn("_own", F.col("_b") == F.col("_home")).drop("_home")


def neighbours(df: DataFrame, key: Sequence[str], fields: Mapping[str, tuple[str, int]], idx: str = IDX,
               block: int | None = None) -> DataFrame:
    """Add columns taken from the row `offset` positions away (null beyond the ends)."""
    def shifted(w):
        return [(F.lag(c, -o) if o < 0 else F.lead(c, o)).over(w).alias(n) for n, (c, o) in fields.items()]

    if block is None:
        return df.select("*", *shifted(_key_window(key).orderBy(idx)))
    offsets = [o for _, o in fields.values()]
    spread = with_halo(df, max(0, -min(offsets)), max(0, max(offsets)), idx, block)
    w = _key_window(key, "_b").orderBy(idx)
    return spread.select("*", *shifted(w)).where("_own").drop("_own", "_b")


def _carry(df: DataFrame, key: Sequence[str], value: Column, agg, back: bool, name: str) -> DataFrame:
    """Per block, the aggregate of `value` over all earlier (or later) blocks of the key."""
    frame = (Window.unboundedPreceding, -1) if back else (1, Window.unboundedFollowing)
    w = _key_window(key).orderBy("_b").rowsBetween(*frame)
    return df.groupBy(*key, "_b").agg(agg(value).alias("_v")).select(*key, "_b", agg("_v").over(w).alias(name))


def run_heads(df: DataFrame, key: Sequence[str], start: Column, name: str = "head", idx: str = IDX,
              block: int | None = None) -> DataFrame:
    """Add the position where the row's run began: the last `start` at or before it."""
    mark = F.when(start, F.col(idx))
    if block is None:
        w = _key_window(key).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.max(mark).over(w))
    rows = cut(df.withColumn("_mark", mark).withColumn("_b", F.floor(F.col(idx) / block)))
    w = _key_window(key, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    carried = _carry(rows, key, F.col("_mark"), F.max, True, "_prev")
    return (
        rows.withColumn("_local", F.max("_mark").over(w))
        .join(carried, [*key, "_b"])
        .select(*df.columns, F.coalesce("_local", "_prev").alias(name))
    )


def run_bounds(df: DataFrame, key: Sequence[str], start: Column, keep: Sequence[str] = (), idx: str = IDX,
               block: int | None = None) -> DataFrame:
    """One row per run: head, tail and the `keep` columns of its first row."""
    rows = df.withColumn("_start", start)
    if block is None:
        w = _key_window(key)
        last = F.max(idx).over(w)
        nxt = F.lead("head").over(w.orderBy("head"))
        return (
            rows.withColumn("_last", last).where("_start").withColumnRenamed(idx, "head")
            .withColumn("tail", F.coalesce(nxt - 1, F.col("_last")))
            .select(*key, "head", "tail", *keep)
        )
    rows = cut(rows.withColumn("_b", F.floor(F.col(idx) / block)))
    later = _key_window(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    blocks = (
        rows.groupBy(*key, "_b")
        .agg(F.min(F.when(F.col("_start"), F.col(idx))).alias("_first"), F.max(idx).alias("_max"))
        .select(*key, "_b", F.min("_first").over(later).alias("_next"), F.max("_max").over(later).alias("_maxl"), "_max")
    )
    inside = F.lead(F.col(idx)).over(_key_window(key, "_b").orderBy(idx))
    return (
        rows.where("_start").withColumn("_in", inside)
        .join(blocks, [*key, "_b"])
        .withColumn("tail", F.coalesce("_in", "_next", F.coalesce("_maxl", "_max") + 1) - 1)
        .withColumnRenamed(idx, "head")
        .select(*key, "head", "tail", *keep)
    )


def prefix_sums(df: DataFrame, key: Sequence[str], sums: Mapping[str, Column], inclusive: bool = True, idx: str = IDX,
                block: int | None = None) -> DataFrame:
    """Add running sums along the sequence (over strictly earlier rows if not inclusive)."""
    end = 0 if inclusive else -1
    if block is None:
        w = _key_window(key).orderBy(idx).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in sums.items()])
    names = list(sums)
    rows = cut(df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()], F.floor(F.col(idx) / block).alias("_b")))
    w = _key_window(key, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, end)
    back = _key_window(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*key, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
        .select(*key, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(back), F.lit(0)).alias(f"_c_{n}") for n in names])
    )
    return (
        rows.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)).alias(f"_i_{n}") for n in names])
        .join(blocks, [*key, "_b"])
        .select(*df.columns, *[(F.col(f"_i_{n}") + F.col(f"_c_{n}")).alias(n) for n in names])
    )


def is_last(df: DataFrame, key: Sequence[str], name: str = "_last", idx: str = IDX,
            block: int | None = None) -> DataFrame:
    """Flag the final row of every sequence."""
    return neighbours(df, key, {"_after": (idx, 1)}, idx, block).withColumn(name, F.col("_after").isNull()).drop("_after")
