"""Similarity, contrastive loss and retrieval metrics between videos and texts.

Features: one row per (ids..., `inst_id`) with `v` and `t` vectors, or long rows with a
`side` of v or t (see `pair_sides`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.vectors import cosine, dot, neg_mse
from wayline.operators.ordered import cut, running_offsets

LOGIT_SCALE = 0.07
SCORE_RANGE = 1.7
METRICS = ["recall", "precision", "hitrate", "map", "mrr", "ndcg", "auroc"]


def similarity(v: Column | str, t: Column | str, kind: str = "cosine", scale: float = LOGIT_SCALE) -> Column:
    """cosine * e^scale, dot * e^scale, or minus the mean squared difference."""
    if kind == "cosine":
        return cosine(v, t) * math.exp(scale)
    if kind == "dot":
        return dot(v, t) * math.exp(scale)
    if kind == "mse":
        return neg_mse(v, t)
    raise ValueError(f"unknown similarity {kind}")


def pair_sides(features: DataFrame, ids: Sequence[str], side: str = "side", vec: str = "vec") -> DataFrame:
    """One row per id with both vectors (an inner join in one aggregation)."""
    both = features.groupBy(*ids).agg(F.first(F.when(F.col(side) == "v", F.col(vec)), True).alias("v"),
                                      F.first(F.when(F.col(side) == "t", F.col(vec)), True).alias("t"))
    return both.where(F.col("v").isNotNull() & F.col("t").isNotNull()).select(*ids, "v", "t")


def batch_pairs(features: DataFrame, episode: Sequence[str] = ("episode_id",), kind: str = "cosine",
                scale: float = LOGIT_SCALE) -> DataFrame:
    """Every video against every text of its batch: (batch_id, q, d, score, target).

    Batches come from `episode_manifest` and hold at most `batch_size` (32) rows, so a
    row meets a constant number of others whatever the data.
    """
    cols = [F.col(c) for c in episode]
    q = features.select("batch_id", F.col("pos").alias("q"), "v", F.struct(*cols).alias("_ve"))
    d = features.select("batch_id", F.col("pos").alias("d"), "t", F.struct(*cols).alias("_te"))
    pairs = q.join(d, "batch_id")
    return pairs.select("batch_id", "q", "d", similarity("v", "t", kind, scale).alias("score"),
                        (F.col("_ve") == F.col("_te")).alias("target"))


def masked_mean_pool(frames: DataFrame, key: Sequence[str], vec: str = "vec", mask: str = "mask",
                     eps: float = 1e-9) -> DataFrame:
    """Mean of the frame vectors whose mask is 1; one partial sum per dimension is shuffled, not the frames."""
    m = F.col(mask).cast("double")
    rows = frames.select(*key, m.alias("_m"), F.posexplode(vec).alias("_i", "_x"))
    dims = rows.groupBy(*key, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(eps))).alias("_v"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_v")))
    return dims.groupBy(*key).agg(F.transform(ordered, lambda s: s["_v"]).alias(vec))


def pad_and_mask(df: DataFrame, batch: Sequence[str] = ("batch_id",), values: str = "values") -> DataFrame:
    """Pad lists of frames with zero frames to the longest of the batch; the mask tells frames with any non-zero entry."""
    sizes = df.groupBy(*batch).agg(F.max(F.size(values)).alias("_len"))
    zero = F.transform(F.element_at(values, 1), lambda x: (x * 0))
    out = df.join(sizes, list(batch)).withColumn("padded", F.concat(values, F.array_repeat(zero, F.col("_len") - F.size(values))))
    return out.withColumn("mask", F.transform("padded", lambda f: F.exists(f, lambda x: x != 0))).drop("_len")


def contrastive_loss(pairs: DataFrame) -> DataFrame:
    """Per batch, the mean of row-wise and column-wise cross entropy with the diagonal as target."""
    def side(by: str) -> DataFrame:
        top = pairs.groupBy("batch_id", by).agg(F.max("score").alias("_m"))
        return (
            pairs.join(top, ["batch_id", by]).groupBy("batch_id", by)
            .agg((F.log(F.sum(F.exp(F.col("score") - F.col("_m")))) + F.max("_m")
                  - F.max(F.when(F.col("q") == F.col("d"), F.col("score")))).alias("_ce"))
            .groupBy("batch_id").agg(F.avg("_ce").alias(f"_{by}"))
        )

    return side("q").join(side("d"), "batch_id").select("batch_id", ((F.col("_q") + F.col("_d")) / 2).alias("loss"))


def metric_columns(k: int, prefix: str) -> list[str]:
    return [f"{prefix}{m}_{k}" for m in METRICS] + [f"{prefix}rprecision", f"{prefix}similarity"]


def _rank_metrics(ranked: DataFrame, by: Sequence[str], k: int, prefix: str) -> DataFrame:
    """Metrics per query from rows (by..., rank, hit, cum, total, score); `total` counts the relevant texts."""
    hit, rank, total = F.col("hit"), F.col("rank"), F.col("total")
    top = rank <= k
    s = lambda c: F.sum(F.when(c[0], c[1]).otherwise(0.0))
    first = F.min(F.when(hit & top, rank))
    gain = 1 / F.log2(rank + 1)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.max("total"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0),
                        lambda a, i: a + 1 / F.log2(i + 1))
    in_top = F.filter(F.collect_list(F.when(top, F.struct(hit.alias("h"), F.col("score").alias("s")))), lambda x: x.isNotNull())
    pos, neg = F.filter(in_top, lambda x: x["h"]), F.filter(in_top, lambda x: ~x["h"])
    wins = F.aggregate(pos, F.lit(0.0), lambda a, p: a + F.aggregate(neg, F.lit(0.0), lambda b, q: b + F.when(
        p["s"] > q["s"], 1.0).when(p["s"] == q["s"], 0.5).otherwise(0.0)))
    n_pairs = F.size(pos) * F.size(neg)
    hits = s((hit & top, F.lit(1.0)))
    r = F.max("total")
    none = lambda c: F.when(r > 0, c).otherwise(0.0)
    m = {
        "recall": none(hits / F.greatest(r, F.lit(1))), "precision": none(hits / k), "hitrate": none(F.least(hits, F.lit(1.0))),
        "map": none(F.when(hits > 0, s((hit & top, F.col("cum") / rank)) / F.greatest(hits, F.lit(1.0))).otherwise(0.0)),
        "mrr": none(F.coalesce(1 / first, F.lit(0.0))), "ndcg": none(s((hit & top, gain)) / ideal),
        "auroc": none(F.when(n_pairs > 0, wins / F.greatest(n_pairs, F.lit(1))).otherwise(0.0)),
    }
    rp = none(s((hit & (rank <= total), F.lit(1.0))) / F.greatest(r, F.lit(1)))
    # similarity repeats R-precision: it is listed but was never defined on its own
    cols = [m[x].alias(f"{prefix}{x}_{k}") for x in METRICS] + [rp.alias(f"{prefix}rprecision"), rp.alias(f"{prefix}similarity")]
    return ranked.groupBy(*by).agg(*cols)


def retrieval_metrics(pairs: DataFrame, k: int = 3, prefix: str = "v2t_", group: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Mean over the queries of each group of the ranking metrics at k; equal scores rank by text position.

    One window per query, over at most a batch of texts, feeds all metrics.
    """
    w = Window.partitionBy(*group, "q")
    order = w.orderBy(F.desc("score"), "d")
    hit = F.col("target").cast("long")
    ranked = pairs.select(
        *group, "q", "score", F.col("target").alias("hit"), F.row_number().over(order).alias("rank"),
        F.sum(hit).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum(hit).over(w).alias("total"))
    per_query = _rank_metrics(ranked, [*group, "q"], k, prefix)
    return per_query.groupBy(*group).agg(*[F.avg(c).alias(c) for c in metric_columns(k, prefix)])


def batch_reduce(metrics: DataFrame, columns: Sequence[str] | None = None, skip: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Unweighted mean over batches; a short last batch counts fully."""
    cols = columns or [c for c in metrics.columns if c not in skip]
    return metrics.agg(*[F.avg(c).alias(c) for c in cols])


def matched_similarity(pairs: DataFrame, scale: float = SCORE_RANGE) -> DataFrame:
    """(mean score of matched pairs + scale) / (2 scale)."""
    mean = F.avg(F.when(F.col("target"), F.col("score")))
    return pairs.agg(((mean + scale) / (2 * scale)).alias("similarity"))


#: Cells of texts at most (their centres are sent to every task), rows worked on at once, positions kept in one row.
CELLS, SLICE, POSITIONS = 2048, 1000, 65536


def _matrix(vectors: pa.Array, kind: str) -> np.ndarray:
    """Vectors as rows of doubles; of length one for cosine."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None] if kind == "cosine" else m


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of every row of a to every row of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def _scores(v: np.ndarray, t: np.ndarray, kind: str, factor: float) -> np.ndarray:
    return -_squares(v, t) / v.shape[1] if kind == "mse" else v @ t.T * factor


def cell_bounds(v: np.ndarray, centres: np.ndarray, radius: np.ndarray, kind: str, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that a text in each cell can have against each video."""
    if kind == "mse":
        away = np.sqrt(_squares(v, centres))
        return -((away + radius) ** 2) / v.shape[1], -(np.maximum(away - radius, 0.0) ** 2) / v.shape[1]
    middle, reach = v @ centres.T, np.linalg.norm(v, axis=1)[:, None] * radius[None, :]
    return (middle - reach) * factor, (middle + reach) * factor


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def text_cells(rows: DataFrame, centres: np.ndarray, kind: str) -> DataFrame:
    """(pos, cell, away, t): the nearest centre of every text and its distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            t = _matrix(b.column("t"), kind)
            cell = _squares(t, centres).argmin(1)
            away = np.linalg.norm(t - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array(cell.astype(np.int32)), pa.array(away), b.column("t")], names=["pos", "cell", "away", "t"])

    return rows.select("pos", "t").mapInArrow(run, f"pos long, cell int, away double, t {rows.schema['t'].dataType.simpleString()}")


def settle(rows: DataFrame, centres: np.ndarray, radius: np.ndarray, size: np.ndarray, kind: str, factor: float) -> DataFrame:
    """(pos, own, v, sure, cells): texts of cells that lie above the own score as a whole, and the cells that bounds leave open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            v, own = _matrix(b.column("v"), kind), b.column("own").to_numpy()[:, None]
            low, high = cell_bounds(v, centres, radius, kind, factor)
            # products in another order differ in the last bits, relative to their terms
            slack = 1e-9 * (1 + np.abs(own) + np.abs(low) + np.abs(high))
            above, below = low > own + slack, high < own - slack
            left, cells = np.nonzero(~above & ~below)
            offsets = np.searchsorted(left, np.arange(len(v) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("pos"), b.column("own"), b.column("v"), pa.array((above * size).sum(1)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.astype(np.int32)))],
                names=["pos", "own", "v", "sure", "cells"])

    return rows.select("pos", "own", "v").mapInArrow(run, f"pos long, own double, v {rows.schema['v'].dataType.simpleString()}, sure long, cells array<int>")


def _meet(kind: str, factor: float):
    """Counts of a group of videos against a group of distinct texts and their positions."""
    def count(videos: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        names = ["pos", "above", "before", "level"]
        if not len(videos) or not len(texts):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        v, t = (_matrix(pa.array(x.tolist()), kind) for x in (videos["v"], texts["t"]))
        at = [np.asarray(p, np.int64) for p in texts["at"]]
        weight = np.array([len(p) for p in at])
        s, own, pos = _scores(v, t, kind, factor), videos["own"].to_numpy()[:, None], videos["pos"].to_numpy()
        # a product summed in another order may differ in the last bits: that is still a tie
        tie = np.abs(s - own) <= 1e-12 * np.maximum(1.0, np.abs(own))
        above = ((s > own) & ~tie) @ weight
        before, level = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        for q, d in np.argwhere(tie).tolist():
            i = int(np.searchsorted(at[d], pos[q]))
            before[q] += i
            level[q] += len(at[d]) - (i < len(at[d]) and at[d][i] == pos[q])  # but for the own text
        return pd.DataFrame(dict(zip(names, (pos, above, before, level))))

    return count


def matched_rank(features: DataFrame, ids: Sequence[str], scale: float = LOGIT_SCALE, kind: str = "dot",
                 block: int = 1024) -> DataFrame:
    """For each video: score and rank of its own text among all texts (equal scores rank by text position).

    One text per video is relevant (ids are unique), and every ranking metric follows from its rank and the
    scores above it. So no pair is emitted and no top list is kept. Texts fall into cells around up to
    `CELLS` of them; bounds from a cell's centre and radius settle it for a video as a whole, without a
    product or a copy. A video is sent only to the cells left open, where it meets `block` distinct texts at a
    time in one matrix product; equal texts are one row with their positions. Videos of an open cell are
    dealt into groups of about 4 x `block`, for each of which its texts are sent once.
    """
    placed = running_offsets(features.withColumn("_g", F.lit(0)), ["_g"], ids, F.lit(1), "pos", features.select(*ids).count()).drop("_g")
    rows = cut(placed.select(F.col("pos").cast("long").alias("pos"), "v", "t", similarity("v", "t", kind, scale).alias("own")))
    total, factor = rows.count(), math.exp(scale)
    # positions follow a hash, so the first ones are a random sample
    sample = rows.where(F.col("pos") < max(1, min(CELLS, -(-total // block)))).orderBy("pos").select("t").toArrow()
    if not total:
        return rows.select("pos", "own", *[F.lit(0).cast("long").alias(c) for c in ("above", "before", "level", "rank", "n")])
    centres = _matrix(sample.column("t").combine_chunks(), kind)
    texts = cut(text_cells(rows, centres, kind))
    found = texts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()  # a row for each cell
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in found:
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"] * (1 + 1e-9) + 1e-12
    judged = cut(settle(rows, centres, radius, size, kind, factor))
    opened = judged.select(F.explode("cells").alias("cell"))
    groups = opened.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (4 * block)).alias("chunks"))
    groups = F.broadcast(groups.join(texts.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("tiles")), "cell"))  # a row for each cell
    own_cells = judged.select("pos", "own", "v", F.explode("cells").alias("cell")).join(groups, "cell")
    asked = own_cells.withColumn("chunk", F.pmod(F.xxhash64("pos", F.lit(1)), F.col("chunks"))).withColumn(
        "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    merged = texts.groupBy("cell", "t", F.floor(F.col("pos") / POSITIONS).alias("_p")).agg(F.array_sort(F.collect_list("pos")).alias("at"))
    given = merged.join(groups, "cell").withColumn("tile", F.pmod(F.xxhash64(F.col("at")[0]), F.col("tiles"))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    place = ["cell", "tile", "chunk"]
    counts = asked.select(*place, "pos", "own", "v").groupBy(*place).cogroup(given.select(*place, "t", "at").groupBy(*place)).applyInPandas(
        _meet(kind, factor), "pos long, above long, before long, level long")
    zero = F.lit(0).cast("long")
    sure = judged.select("pos", "own", F.col("sure").alias("above"), zero.alias("before"), zero.alias("level"))
    summed = sure.unionByName(counts.withColumn("own", F.lit(None).cast("double"))).groupBy("pos").agg(
        F.max("own").alias("own"), *[F.sum(c).alias(c) for c in ("above", "before", "level")])
    return summed.withColumn("rank", F.col("above") + F.col("before") + 1).withColumn("n", F.lit(total).cast("long"))


def full_metrics(features: DataFrame, ids: Sequence[str], k: int = 3, prefix: str = "v2t_", kind: str = "dot",
                 scale: float = LOGIT_SCALE, block: int = 1024) -> DataFrame:
    """Retrieval metrics of every video against every text; only its own text is relevant.

    Vectors are stored under their ids, so a repeated id has been overwritten: ids are
    unique here and R = 1.
    """
    ranks = matched_rank(features, ids, scale, kind, block)
    r = F.col("rank")
    inside = r <= k
    size = F.least(F.lit(k), F.col("n"))
    # of the other texts in the top k, the own text beats those ranked below it, and splits ties
    later_ties = F.least(F.col("level") - F.col("before"), size - r)
    earlier_ties = F.least(F.col("before"), r - 1)
    auroc = F.when(inside & (size > 1), ((size - r - later_ties) + 0.5 * (later_ties + earlier_ties)) / (size - 1)).otherwise(0.0)
    one = F.when(inside, 1.0).otherwise(0.0)
    cols = {
        "recall": one, "precision": one / k, "hitrate": one, "map": F.when(inside, 1 / r).otherwise(0.0),
        "mrr": F.when(inside, 1 / r).otherwise(0.0), "ndcg": F.when(inside, 1 / F.log2(r + 1)).otherwise(0.0), "auroc": auroc,
    }
    rp = F.avg(F.when(r == 1, 1.0).otherwise(0.0))
    return ranks.agg(*[F.avg(c).alias(f"{prefix}{m}_{k}") for m, c in cols.items()],
                     rp.alias(f"{prefix}rprecision"), rp.alias(f"{prefix}similarity"))


def classification_report(df: DataFrame, pred: str = "pred", truth: str = "truth", classes: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """Accuracy, micro F1 (equal to it) and macro F1 over the classes that occur; one pass of conditional counts."""
    def count(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0))

    p, t = F.col(pred), F.col(truth)
    aggs = [F.count(F.lit(1)).alias("n"), count(p == t).alias("ok")]
    for c in classes:
        aggs += [count((p == c) & (t == c)).alias(f"_tp{c}"), count((p == c) | (t == c)).alias(f"_any{c}")]
    row = df.agg(*aggs)
    f1, seen = F.lit(0.0), F.lit(0)
    for c in classes:
        tp, any_ = F.col(f"_tp{c}"), F.col(f"_any{c}")
        f1 = f1 + F.when(any_ > 0, 2 * tp / F.greatest(any_ + tp, F.lit(1))).otherwise(0.0)
        seen = seen + (any_ > 0).cast("int")
    acc = F.try_divide(F.col("ok"), F.col("n"))
    return row.select(F.col("n").alias("rows"), acc.alias("accuracy"), acc.alias("f1_micro"), F.try_divide(f1, seen).alias("f1_macro"))
