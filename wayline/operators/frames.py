"""Frame ordering, thinning, selection and pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.random import hash_uniform
from wayline.operators.ordered import BLOCK, IDX, neighbours, number_rows

KEY = ("source", "split", "episode_id")


def natural_key(name: Column | str) -> Column:
    """An array that sorts like the name in natural order: texts as texts, digit runs of any length as numbers.

    Each element is a text and the number after it, as (digits, value): without padding,
    longer numbers are larger, and a text without a number comes first.
    """
    name = F.col(name) if isinstance(name, str) else name
    pieces = F.array_remove(F.regexp_extract_all(name, F.lit(r"(\D*\d*)"), 1), "")

    def pair(p: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(p, r"(\d+)$", 1), r"^0+(?=\d)", "")
        return F.struct(F.regexp_extract(p, r"^(\D*)", 1).alias("text"), F.length(number).alias("digits"), number.alias("number"))

    return F.transform(pieces, pair)


def leading_number(name: Column | str) -> Column:
    """The integer before the first `_` or `.` of a file name."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(name, r"^(\d+)", 1).try_cast("long")


def frame_order(df: DataFrame, key: Sequence[str] = KEY, name: str = "name", by_number: bool = False) -> DataFrame:
    """Add `frame_idx`: natural order of the names, or of their leading numbers."""
    if by_number:
        lead = leading_number(name)
        return number_rows(df, key, [lead.asc_nulls_last(), F.col(name)], F.coalesce(F.floor(lead / BLOCK), F.lit(2**62)))
    natural = natural_key(name)
    first = F.try_element_at(natural, F.lit(1))
    # buckets of the first text and its number without the last four digits
    coarse = F.struct(first["text"].alias("text"), first["digits"].alias("digits"), F.substring(first["number"], F.lit(1), F.greatest(first["digits"] - 4, F.lit(0))).alias("number"))
    return number_rows(df, key, [natural, F.col(name)], coarse)


def limit_stride(df: DataFrame, max_frames: int | None = None, downsample: int = 1, idx: str = IDX) -> DataFrame:
    """Keep `[:max_frames:downsample]` and renumber; no shuffle, positions are dense. Without a cap all frames count."""
    capped = df if max_frames is None else df.where(F.col(idx) < max_frames)
    kept = capped.where(F.col(idx) % downsample == 0)
    return kept.withColumn(idx, F.floor(F.col(idx) / downsample))


def stride_limit(df: DataFrame, downsample: int, cap: int, idx: str = IDX) -> DataFrame:
    """Keep `[::downsample][:cap]` and renumber."""
    kept = df.where((F.col(idx) % downsample == 0) & (F.col(idx) < cap * downsample))
    return kept.withColumn(idx, F.floor(F.col(idx) / downsample))


def auto_downsample(df: DataFrame, key: Sequence[str] = KEY, limit: int = 500, cap: int = 300,
                    downsample: int = 0, idx: str = IDX) -> DataFrame:
    """Stride by 1 + n div `limit` (or a fixed `downsample`), then keep `cap` frames."""
    if downsample:
        return stride_limit(df, downsample, cap, idx)
    sizes = df.groupBy(*key).agg((F.max(idx) + 1).alias("_n"))
    step = F.lit(1) + F.floor(F.col("_n") / limit)
    return (
        df.join(sizes, list(key))
        .withColumn("_ds", step)
        .where((F.col(idx) % F.col("_ds") == 0) & (F.col(idx) < F.col("_ds") * cap))
        .withColumn(idx, F.floor(F.col(idx) / F.col("_ds")))
        .select(*df.columns)
    )


def select_key_frames(frames: DataFrame, key_frames: DataFrame, key: Sequence[str] = KEY, idx: str = IDX) -> DataFrame:
    return frames.join(key_frames, [*key, idx], "left_semi")


def complete_episodes(frames: DataFrame, labels: DataFrame, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Split episodes into those with frames and as many labels, and the rejected.

    A rejected episode carries its reason: no frames, no labels, or a length mismatch.
    """
    f = frames.groupBy(*key).agg(F.count(F.lit(1)).alias("n_frames"))
    a = labels.groupBy(*key).agg(F.count(F.lit(1)).alias("n_labels"))
    both = f.join(a, list(key), "full").na.fill(0, ["n_frames", "n_labels"])
    reason = (
        F.when(F.col("n_frames") == 0, "no frames")
        .when(F.col("n_labels") == 0, "no labels")
        .when(F.col("n_frames") != F.col("n_labels"), "length mismatch")
    )
    judged = both.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def frame_pairs(frames: DataFrame, key: Sequence[str] = KEY, label: str = "action", item: str = "event_id",
                idx: str = IDX, block: int | None = None) -> DataFrame:
    """(frame i, frame i+1) with the label of frame i; the last frame has no pair."""
    out = neighbours(frames, key, {"_next": (item, 1), "_after": (idx, 1)}, idx, block)
    return out.where(F.col("_after").isNotNull()).select(
        *key, idx, F.col(item).alias("first_item"), F.col("_next").alias("second_item"), label)


def merge_frames_aug(frames: DataFrame, key: Sequence[str] = KEY, f: int = 2, label: str = "action",
                     idx: str = IDX) -> DataFrame:
    """Extra pairs (i, i+f) for i = 0, f+1, 2(f+1), ... where the label is constant on [i, i+f].

    The windows tile the sequence, so this is one hash aggregation.
    """
    if f < 2:
        raise ValueError("frames are merged for f >= 2")
    width = f + 1
    tile = frames.groupBy(*key, F.floor(F.col(idx) / width).alias("_g")).agg(
        F.min(label).alias(label), F.max(label).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    full = tile.where((F.col("_n") == width) & (F.col(label) == F.col("_hi")))
    first = F.col("_g") * width
    return full.select(*key, first.alias("first_idx"), (first + f).alias("second_idx"), label)


def pair_swap(pairs: DataFrame, key: Sequence[str] = KEY, label: str = "cls", idx: str = IDX,
              seed: int = 42) -> DataFrame:
    """With probability 1/2 reverse a turn pair: swap its frames and its class (1 and 2)."""
    swap = (F.col(label) > 0) & (hash_uniform(*key, idx, seed=seed, salt="pair_swap") < 0.5)
    return pairs.select(
        *key, idx,
        F.when(swap, F.col("second_item")).otherwise(F.col("first_item")).alias("first_item"),
        F.when(swap, F.col("first_item")).otherwise(F.col("second_item")).alias("second_item"),
        F.when(swap, 3 - F.col(label)).otherwise(F.col(label)).alias(label),
    )


def thin_fps(frames: DataFrame, fps_in: float, fps_out: float, idx: str = IDX) -> DataFrame:
    """Keep every `int(fps_in / fps_out)`-th frame and renumber."""
    step = int(fps_in / fps_out)
    if step < 1:
        raise ValueError("the target rate exceeds the source rate")
    return frames.where(F.col(idx) % step == 0).withColumn(idx, F.floor(F.col(idx) / step))


def resize_dims(w: Column | str, h: Column | str, size: int) -> tuple[Column, Column]:
    """Width and height after scaling the shorter edge to `size` (0 leaves them)."""
    w, h = [F.col(c) if isinstance(c, str) else c for c in (w, h)]
    if size == 0:
        return w, h
    narrow = w < h
    new_w = F.when(narrow, size).otherwise(F.floor(w * size / h)).cast("int")
    new_h = F.when(narrow, F.floor(h * size / w)).otherwise(size).cast("int")
    return new_w, new_h


def tile_plan(images: DataFrame, image: str = "image_id", w: str = "w", h: str = "h", max_num: int = 12,
              size: int = 448, thumbnail: bool = False) -> DataFrame:
    """Crop boxes of the tile grid whose aspect ratio is closest to the image's.

    Among grids at the same distance the last one (by tile count) wins whose area
    rule holds: image area > size^2 * tiles / 2; otherwise the first.
    """
    grids = sorted({(i, j) for i in range(1, max_num + 1) for j in range(1, max_num + 1) if i * j <= max_num},
                   key=lambda g: (g[0] * g[1], g[0]))
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("c"), F.lit(j).alias("r"))
                      for n, (i, j) in enumerate(grids)])
    ratio = F.col(w) / F.col(h)
    gaps = F.transform(F.col("_grids"), lambda g: F.abs(F.col("_ratio") - g["c"] / g["r"]))
    best = F.filter(F.arrays_zip(F.col("_grids").alias("g"), F.col("_gaps").alias("gap")),
                    lambda z: z["gap"] == F.array_min("_gaps"))
    area = F.col(w).cast("double") * F.col(h)
    roomy = F.filter(F.slice("_best", 2, len(grids)),
                     lambda z: area > F.lit(0.5 * size * size) * z["g"]["c"] * z["g"]["r"])
    chosen = F.coalesce(F.try_element_at(F.col("_roomy"), F.lit(-1)), F.element_at("_best", 1))
    picked = (
        images.withColumn("_grids", table).withColumn("_ratio", ratio).withColumn("_gaps", gaps)
        .withColumn("_best", best).withColumn("_roomy", roomy).withColumn("_g", chosen["g"])
        .select(image, F.col("_g.c").alias("cols"), F.col("_g.r").alias("rows"))
    )
    tiles = F.col("cols") * F.col("rows")
    extra = F.when(tiles > 1, tiles).otherwise(tiles - 1) if thumbnail else tiles - 1
    x, y = F.col("tile") % F.col("cols"), F.floor(F.col("tile") / F.col("cols")).cast("int")
    thumb = F.col("tile") == tiles
    return (
        picked.withColumn("tile", F.explode(F.sequence(F.lit(0), extra)))
        .select(image, "cols", "rows", "tile",
                F.when(thumb, 0).otherwise(x * size).alias("x0"), F.when(thumb, 0).otherwise(y * size).alias("y0"),
                F.when(thumb, size).otherwise((x + 1) * size).alias("x1"),
                F.when(thumb, size).otherwise((y + 1) * size).alias("y1"), thumb.alias("is_thumbnail"))
    )


def sample_segments(videos: DataFrame, video: str = "video_id", vlen: str = "vlen", fps: str = "fps",
                    segments: int = 32, bound: tuple[float, float] | None = None, first_idx: int = 0) -> DataFrame:
    """Centre frame of each of `segments` equal segments of the (bounded) video."""
    lo, hi = bound if bound else (-100000.0, 100000.0)
    start = F.greatest(F.lit(first_idx), F.rint(F.lit(float(lo)) * F.col(fps)).cast("long"))
    end = F.least(F.rint(F.lit(float(hi)) * F.col(fps)).cast("long"), F.col(vlen) - 1)
    step = (F.col("_e") - F.col("_s")) / F.lit(float(segments))
    at = F.col("_s") + F.col("_step") / 2 + F.rint(F.col("_step") * F.col("pos"))
    return (
        videos.withColumn("_s", start).withColumn("_e", end).withColumn("_step", step)
        .withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
        .select(video, "pos", F.when(at < 0, F.ceil(at)).otherwise(F.floor(at)).cast("long").alias("frame"))
    )


def sample_frames(videos: DataFrame, mode: str, num_frames: int = 8, video: str = "video_id", vlen: str = "vlen",
                  fps: str = "fps", fix_start: int | None = None, min_frames: int = 1, max_frames: int = -1,
                  local: int = 8, clip: tuple[float, float] | None = None, seed: int = 42) -> DataFrame:
    """Frame positions to read per video: one row (video, pos, frame).

    Modes: `middle`, `rand`, `dynamic_fps1` (a multiple of `local` frames by
    duration) and `fpsX` (one frame every 1/X seconds). A clip shortens the video.
    """
    n, rate = F.col("_n"), F.col(fps).cast("double")
    length = F.col(vlen).cast("long")
    if clip:
        lo = max(0.0, float(clip[0]))
        span = F.least(length / rate - 0.1, F.lit(float(clip[1]))) - lo
        length = F.floor(span * rate)
    base = videos.withColumn("_n", length).where(F.col("_n") > 0)
    if mode.startswith("fps"):
        gap = 1.0 / float(mode[3:])
        steps = F.ceil((n / rate) / gap)
        at = F.rint((F.lit(gap / 2) + F.col("pos") * F.lit(gap)) * rate).cast("long")
        out = (
            base.withColumn("_k", F.greatest(steps, F.lit(1)))
            .withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
            .withColumn("frame", at).where(F.col("frame") < n)
        )
        return (out.where(F.col("pos") < max_frames) if max_frames > 0 else out).select(video, "pos", "frame")
    if mode not in ("middle", "rand", "dynamic_fps1"):
        raise ValueError(f"unknown sampling mode {mode}")
    dynamic = mode == "dynamic_fps1"
    floor_min = F.floor(n / local) * local if dynamic else n
    least = F.when(F.lit(min_frames) > n, floor_min).otherwise(F.lit(min_frames).cast("long"))
    wanted = F.lit(num_frames).cast("long")
    if dynamic:
        wanted = F.greatest(F.lit(1), F.floor(n / rate / local)) * local
        wanted = F.least(wanted, F.lit(max_frames)) if max_frames > 0 else wanted
    out = base.withColumn("_want", F.greatest(least, wanted)).withColumn("_acc", F.least(F.col("_want"), n))
    if mode == "rand":
        # segments of one frame leave nothing to draw from: such a video takes `acc` distinct frames in order
        tight = F.floor(n / F.col("_acc")) < 2
        order = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(
            hash_uniform(video, i, seed=seed, salt="sample_frames_tight").alias("u"), i.alias("i")))
        first = F.slice(F.array_sort(order), F.lit(1), F.col("_acc").cast("int"))
        out = out.withColumn("_drawn", F.when(tight, F.array_sort(F.transform(first, lambda s: s["i"]))))
    out = out.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_want") - 1)))
    slot = F.least(F.col("pos"), F.col("_acc") - 1)
    # linspace edge i is i * (n / acc), its last edge exactly n
    edge = lambda i: F.when(i == F.col("_acc"), n).otherwise(F.floor(i * (n / F.col("_acc")))).cast("long")
    out = out.withColumn("_lo", edge(slot)).withColumn("_hi", edge(slot + 1) - 1)
    if mode == "rand":
        width = F.col("_hi") - F.col("_lo")
        pick = F.col("_lo") + F.floor(hash_uniform(video, slot, seed=seed, salt="sample_frames") * width)
        frame = F.coalesce(F.try_element_at("_drawn", (slot + 1).cast("int")), pick)
    elif fix_start is not None:
        frame = F.col("_lo") + fix_start
    else:
        frame = F.floor((F.col("_lo") + F.col("_hi")) / 2)
    return out.select(video, "pos", frame.cast("long").alias("frame"))
