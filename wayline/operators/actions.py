"""Smoothing, run-length compaction and key frames of action sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.actions import FORWARD, LEFT, RIGHT, STOP
from wayline.functions.random import hash_uniform
from wayline.operators.frames import KEY
from wayline.operators.ordered import IDX, cut, is_last, neighbours, run_bounds, run_heads

# Cut points between enter, pass and leave.
ENTER_CUT, PASS_CUT = 0.3334, 0.6667


def append_stop(df: DataFrame, key: Sequence[str] = KEY, col: str = "action", idx: str = IDX,
                block: int | None = None) -> DataFrame:
    """Label the last frame `stop`; a missing label anywhere else is an error."""
    flagged = is_last(df, key, "_last", idx, block)
    missing = F.raise_error(F.lit("fewer labels than frames")).cast("int")
    label = F.when(F.col("_last"), STOP).otherwise(F.coalesce(F.col(col).cast("int"), missing))
    return flagged.withColumn(col, label).drop("_last")


def smooth_single_turn(df: DataFrame, key: Sequence[str] = KEY, drop_stop: bool = True, col: str = "action",
                       idx: str = IDX, block: int | None = None) -> DataFrame:
    """Turn between two forwards becomes forward; optionally drop the final stop."""
    near = neighbours(df, key, {"_p": (col, -1), "_n": (col, 1)}, idx, block)
    lone = F.col(col).isin(LEFT, RIGHT) & (F.col("_p") == FORWARD) & (F.col("_n") == FORWARD)
    kept = near.where(F.col("_n").isNotNull()) if drop_stop else near
    return kept.withColumn(col, F.when(lone, FORWARD).otherwise(F.col(col))).drop("_p", "_n")


def smooth_aba(df: DataFrame, key: Sequence[str] = KEY, values: Sequence[int] = (1, 2, 3), col: str = "action",
               idx: str = IDX, block: int | None = None) -> DataFrame:
    """A B A becomes A A A, applied left to right in place.

    The in-place rule has a closed form. Call a position open if its raw
    neighbours agree, differ from it, and are in `values`. After a change at i the
    value at i equals raw i+1, so i+1 cannot change, and i+2 sees raw values again.
    Hence in every stretch of consecutive open positions exactly the 1st, 3rd, 5th,
    ... change: two neighbours and the start of the stretch decide, with no fold.
    """
    near = neighbours(df, key, {"_p2": (col, -2), "_p": (col, -1), "_n": (col, 1)}, idx, block)
    c = F.col

    def open_at(before, here, after):
        return F.coalesce((before == after) & (before != here) & before.isin(*values), F.lit(False))

    marked = near.withColumn("_open", open_at(c("_p"), c(col), c("_n")))
    marked = marked.withColumn("_start", c("_open") & ~open_at(c("_p2"), c("_p"), c(col)))
    headed = run_heads(marked, key, c("_start"), "_head", idx, block)
    changed = c("_open") & ((c(idx) - c("_head")) % 2 == 0)
    return headed.withColumn(col, F.when(changed, c("_p")).otherwise(c(col))).select(*df.columns)


def smooth_turn_majority(df: DataFrame, key: Sequence[str] = KEY, strict: bool = False, col: str = "action",
                         idx: str = IDX, block: int | None = None) -> DataFrame:
    """Each maximal run of left/right takes its majority; ties take the first label, or stay if strict."""
    near = neighbours(df, key, {"_p": (col, -1)}, idx, block)
    turn = F.col(col).isin(LEFT, RIGHT)
    start = turn & ~F.coalesce(F.col("_p").isin(LEFT, RIGHT), F.lit(False))
    rows = run_heads(near.withColumn("_turn", turn), key, start, "_head", idx, block).drop("_p")
    left = F.sum((F.col(col) == LEFT).cast("int"))
    right = F.sum((F.col(col) == RIGHT).cast("int"))
    tie = F.col(col) if strict else F.col("_first")
    vote = F.when(F.col("_nl") > F.col("_nr"), LEFT).when(F.col("_nr") > F.col("_nl"), RIGHT).otherwise(tie)
    if block is None:
        w = Window.partitionBy(*key, "_turn", "_head")
        voted = rows.select("*", left.over(w).alias("_nl"), right.over(w).alias("_nr"), F.min_by(col, idx).over(w).alias("_first"))
    else:
        rows = cut(rows)
        runs = rows.where("_turn").groupBy(*key, "_head").agg(
            left.alias("_nl"), right.alias("_nr"), F.min_by(col, idx).alias("_first"))
        voted = rows.join(runs, [*key, "_head"], "left")
    return voted.withColumn(col, F.when(F.col("_turn"), vote).otherwise(F.col(col))).select(*df.columns)


def smooth_actions(df: DataFrame, key: Sequence[str] = KEY, level: int = 2, values: Sequence[int] = (1, 2, 3),
                   col: str = "action", idx: str = IDX, block: int | None = None) -> DataFrame:
    """Level 2 and above: ABA then turn majority; level 1: turn majority; 0: nothing."""
    if level >= 2:
        df = smooth_aba(df, key, values, col, idx, block)
    return smooth_turn_majority(df, key, False, col, idx, block) if level >= 1 else df


def action_runs(df: DataFrame, key: Sequence[str] = KEY, col: str = "action", idx: str = IDX,
                block: int | None = None) -> DataFrame:
    """Run-length encoding: action, head, tail, length and middle = (head + tail) div 2."""
    near = neighbours(df, key, {"_p": (col, -1)}, idx, block)
    runs = run_bounds(near, key, ~F.col(col).eqNullSafe(F.col("_p")), [col], idx, block)
    return runs.select(*key, col, "head", "tail", (F.col("tail") - F.col("head") + 1).alias("length"),
                       F.floor((F.col("head") + F.col("tail")) / 2).alias("middle"))


def compact_middle(runs: DataFrame, key: Sequence[str] = KEY, col: str = "action") -> DataFrame:
    return runs.select(*key, F.col("middle").alias(IDX), col)


def compact_levels(runs: DataFrame, level: int, key: Sequence[str] = KEY, col: str = "action") -> DataFrame:
    """Tail (1), middle and tail (2), head, middle and tail (3), or every frame (-1) of runs of at least `level`."""
    spots = {1: ["tail"], 2: ["middle", "tail"], 3: ["head", "middle", "tail"]}
    if level == -1:
        return runs.select(*key, F.explode(F.sequence("head", "tail")).alias(IDX), col)
    if level not in spots:
        raise ValueError("level is 1, 2, 3 or -1")
    at = F.explode(F.array_distinct(F.array(*[F.col(s) for s in spots[level]])))
    return runs.where(F.col("length") >= level).select(*key, at.alias(IDX), col)


def enter_leave(runs: DataFrame, key: Sequence[str] = KEY, ratio: float = 0.5, mode: str = "middle",
                short: str = "keep", seed: int = 42, col: str = "action") -> DataFrame:
    """One phrase per run; with probability `ratio` a forward run becomes enter, pass or leave.

    Long runs (tail - head >= 2): enter at the tail, pass at the middle or leave at
    the head. Short ones: in `middle` mode forward or enter (`short`) at the middle,
    in `normal` mode enter at the tail. Other runs keep their phrase.
    """
    rest: Column = F.col("middle" if mode == "middle" else "tail")
    gate = (F.col(col) == "move forward") & (hash_uniform(*key, "head", seed=seed, salt="enter_leave") < ratio)
    draw = hash_uniform(*key, "head", seed=seed, salt="enter_leave_kind")
    long = F.col("tail") - F.col("head") >= 2
    short_word = F.lit("enter") if short == "enter" or mode == "normal" else F.col(col)
    word = (
        F.when(~gate, F.col(col)).when(~long, short_word)
        .when(draw < ENTER_CUT, "enter").when(draw < PASS_CUT, "pass").otherwise("leave")
    )
    spot = (
        F.when(~gate | ~long, rest)
        .when(draw < ENTER_CUT, F.col("tail")).when(draw < PASS_CUT, F.col("middle")).otherwise(F.col("head"))
    )
    return runs.select(*key, spot.alias(IDX), word.alias(col))


def key_frames(df: DataFrame, key: Sequence[str] = KEY, col: str = "action", idx: str = IDX,
               block: int | None = None) -> DataFrame:
    """Middles of the runs after majority smoothing, plus frame 0.

    Frame 0 belongs to the run with head 0, so it is added there without a union.
    """
    runs = action_runs(append_stop(smooth_actions(df, key, 1, col=col, idx=idx, block=block), key, col, idx, block),
                       key, col, idx, block)
    spots = F.when((F.col("head") == 0) & (F.col("middle") > 0), F.array(F.lit(0).cast("long"), F.col("middle")))
    return runs.select(*key, F.explode(F.coalesce(spots, F.array("middle"))).alias(idx))
