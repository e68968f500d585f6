"""Top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Phrases of the nine cells of the image, far to near, left to right.
GRID = [
    "far left side", "far front", "far right side",
    "left side", "front", "right side",
    "left side and very close", "very close", "right side and very close",
]


def grid_position(w: Column, h: Column, bx: Column, by: Column) -> Column:
    """Phrase of the cell that holds the box centre; thirds use integer division."""
    def cell(at: Column, size: Column) -> Column:
        return F.least(F.greatest(F.floor(at / F.floor(size / 3)), F.lit(0)), F.lit(2))

    names = F.array(*[F.lit(g) for g in GRID])
    return F.element_at(names, (cell(by, h) * 3 + cell(bx, w) + 1).cast("int"))


def top_objects(detections: DataFrame, images: DataFrame, k: int = 3, threshold: float = 0.5,
                image: str = "image_id", det: str = "det_id") -> DataFrame:
    """`"label: position. "` of the k best detections above the threshold, `"No object."` without any.

    row_number <= k lets Spark cut to k rows per image before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("score"), det))
    where = grid_position(F.col("w"), F.col("h"), F.floor("cx"), F.floor("cy"))
    phrase = F.concat(F.col("label"), F.lit(": "), where, F.lit(". "))
    best = (
        detections.where(F.col("score") > threshold).withColumn("_r", rank).where(F.col("_r") <= k)
        .groupBy(image).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", phrase.alias("p")))),
                                                     lambda s: s["p"]), "").alias("objects"))
    )
    return images.select(image).join(best, image, "left").withColumn("objects", F.coalesce("objects", F.lit("No object.")))


def top_classes(df: DataFrame, names: DataFrame, k: int = 1, limit: int | None = None, item: str = "item_id",
                vec: str = "vec", class_id: str = "class_id", class_name: str = "name") -> DataFrame:
    """Names of the k highest scores among the first `limit` classes, joined by `", "`.

    Only names of classes that a vector has an element for are kept, so the map of names,
    computed by a scalar subquery, is no longer than a row's vector; the ranking stays inside
    the row.
    """
    named = names.where(F.col(class_id) < (limit or df.agg(F.max(F.size(vec))).scalar()))
    table = named.agg(F.map_from_entries(F.collect_list(F.struct(F.col(class_id).cast("int"), class_name))).alias("m")).scalar()
    scores = F.slice(vec, 1, limit) if limit else F.col(vec)
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    picks = F.slice(ranked, 1, k)
    rows = df.withColumn("_names", table).withColumn("_picks", picks)
    return rows.select(item, F.array_join(F.transform("_picks", lambda p: F.element_at("_names", p["i"])), ", ").alias("classes"))
