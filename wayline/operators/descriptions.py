"""From per-frame entities to episode descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.random import hash_index, hash_uniform
from wayline.functions.text import _strip
from wayline.functions.vectors import cosine
from wayline.operators.frames import KEY
from wayline.operators.ordered import BLOCK, IDX, neighbours, run_heads, with_halo
from pyspark.sql.window import Window

KEPT_MARK = " @@"


def similar_runs(df: DataFrame, key: Sequence[str] = KEY, vec: str = "vec", threshold: float = 0.7, seed: int = 42,
                 idx: str = IDX, block: int | None = None) -> DataFrame:
    """Positions kept: one seeded pick per run of similar neighbours, and always the last."""
    near = neighbours(df, key, {"_v": (vec, -1)}, idx, block)
    same = F.coalesce(cosine(vec, "_v") > threshold, F.lit(False))
    rows = run_heads(near.select(*key, idx, (~same).alias("_start")), key, F.col("_start"), "_head", idx, block)
    u = hash_uniform(*key, idx, seed=seed, salt="similar_runs")
    picks = rows.groupBy(*key, "_head").agg(F.min_by(idx, F.struct(u, F.col(idx))).alias("_pick"), F.max(idx).alias("_end"))
    # the last run also yields the end of the sequence
    ends = picks.groupBy(*key).agg(F.max("_end").alias(idx))
    return picks.select(*key, F.col("_pick").alias(idx)).unionByName(ends).distinct()


def pick_scenes(df: DataFrame, key: Sequence[str] = KEY, frames: str = "n_frames", items: str = "n_items",
                seed: int = 42, long_path: int = 58) -> DataFrame:
    """Scene positions to keep per episode, from one row per episode with its two counts.

    Short paths keep one of [0, N-2] and the last; paths of at least `long_path`
    frames and 3 items keep one of [0, mid-1], one of [mid, N-2] and the last.
    """
    n = F.col(items)
    mid = F.floor((n - 1) / 2)
    zero = F.lit(0).cast("long")

    def between(lo: Column, hi: Column, salt: str) -> Column:
        return lo + hash_index(hi - lo + 1, *key, seed=seed, salt=salt)

    last = F.greatest(zero, n - 1)
    three = F.array(between(zero, F.greatest(zero, mid - 1), "pick_scenes_a"),
                    between(F.greatest(zero, mid), F.greatest(zero, n - 2), "pick_scenes_b"), last)
    two = F.array(between(zero, F.greatest(zero, n - 2), "pick_scenes_a"), last)
    picks = F.when((F.col(frames) >= long_path) & (n >= 3), three).otherwise(two)
    return df.select(*key, F.explode(F.array_distinct(picks.cast("array<bigint>"))).alias("pos"))


def mark_kept(df: DataFrame, scene_kept: Column, object_kept: Column) -> DataFrame:
    """Append the kept mark to a kept scene or object, and to the action if either is kept."""
    def mark(c: str, when: Column) -> Column:
        return F.when(when, F.concat(F.col(c), F.lit(KEPT_MARK))).otherwise(F.col(c))

    return df.withColumns({
        "scene": mark("scene", scene_kept), "object": mark("object", object_kept),
        "action": mark("action", scene_kept | object_kept),
    })


def trailing_window(df: DataFrame, w: int, key: Sequence[str] = KEY, item: str = "event_id", idx: str = IDX,
                    name: str = "items", block: int | None = None) -> DataFrame:
    """The w items ending here; near the start, the first w items of the sequence.

    Both cases are the first w entries of the frame [i-w+1, i+w-1].
    """
    reach = w - 1
    rows = df if block is None else with_halo(df, reach, reach, idx, block)
    part = [*key] if block is None else [*key, "_b"]
    frame = Window.partitionBy(*part).orderBy(idx).rowsBetween(-reach, reach)
    out = rows.withColumn(name, F.slice(F.collect_list(F.struct(item)).over(frame), 1, w))
    out = out if block is None else out.where("_own")
    return out.select(*df.columns, F.transform(name, lambda s: s[item]).alias(name))


def dedup_adjacent(df: DataFrame, key: Sequence[str] = KEY, col: str = "description", idx: str = IDX,
                   block: int | None = None) -> DataFrame:
    """Drop rows whose value equals the one before."""
    near = neighbours(df, key, {"_p": (col, -1), "_i": (idx, -1)}, idx, block)
    return near.where(F.col("_i").isNull() | ~F.col(col).eqNullSafe(F.col("_p"))).drop("_p", "_i")


def sentence(col: Column | str) -> Column:
    """Trimmed text with a final full stop and a space; null when there is nothing to say."""
    text = _strip(F.col(col) if isinstance(col, str) else col)
    return F.when(text != "", F.concat(text, F.when(text.endswith("."), " ").otherwise(". ")))


def frame_description(df: DataFrame, position: str = "first", numbered: bool = False, kept: bool = False,
                      number: str = IDX, name: str = "description") -> DataFrame:
    """`"A. S. O. "` from action, scene and object; empty parts are left out.

    `position` puts the action first, last, or (dynamic) last only for turns. With
    `kept`, scene and object appear only where `scene_kept` and `object_kept` hold,
    the action where either does.
    """
    a, s, o = sentence("action"), sentence("scene"), sentence("object")
    if kept:
        ks, ko = F.col("scene_kept"), F.col("object_kept")
        a, s, o = F.when(ks | ko, a), F.when(ks, s), F.when(ko, o)
    late = {"first": F.lit(False), "last": F.lit(True), "dynamic": F.col("action").contains("turn")}[position]
    late = F.coalesce(late, F.lit(False))
    lead = F.concat(F.col(number).cast("string"), F.lit(". ")) if numbered else F.lit("")
    parts = [lead, F.when(~late, a), s, o, F.when(late, a)]
    return df.withColumn(name, F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))


def assemble(df: DataFrame, key: Sequence[str] = KEY, col: str = "description", idx: str = IDX,
             name: str = "summary", block: int = BLOCK) -> DataFrame:
    """Join the descriptions of an episode in order, one per line.

    Blocks are joined first, so a task sorts at most a block and the last step only
    concatenates block texts.
    """
    def lines(order: str, text: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n")

    parts = df.groupBy(*key, F.floor(F.col(idx) / block).alias("_b")).agg(lines(idx, col).alias("_part"))
    return parts.groupBy(*key).agg(lines("_b", "_part").alias(name))


def ablate(df: DataFrame, action: bool = False, scene: bool = False, obj: bool = False,
           use_enter_leave: bool = True) -> DataFrame:
    """Overwrite parts with the string "None"; optionally turn enter/leave/pass into plain forward."""
    act = F.lit("None") if action else F.col("action")
    if not use_enter_leave:
        act = F.when(act.isin("enter", "leave", "pass"), "move forward").otherwise(act)
    return df.withColumns({
        "action": act,
        "scene": F.lit("None") if scene else F.col("scene"),
        "object": F.lit("None") if obj else F.col("object"),
    })


def explode_entities(infos: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored info maps to one row per frame, ordered by the integer value of the map key."""
    keys = F.map_keys("actions_compact")
    at = F.transform(F.array_sort(F.transform(keys, lambda k: k.cast("long"))), lambda k: k)
    rows = infos.select(*key, "actions_compact", "scenes", "objects", F.posexplode(at).alias("pos", IDX))
    return rows.select(
        *key, IDX, F.col("pos").cast("long").alias("pos"),
        *[F.try_element_at(m, F.col(IDX).cast("string")).alias(n)
          for m, n in (("actions_compact", "action"), ("scenes", "scene"), ("objects", "object"))])
