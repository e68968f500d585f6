"""The human study: what raters see and what they answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.random import hash_uniform
from wayline.operators.ordered import running_offsets


def survey_order(items: DataFrame, raters: DataFrame, n: int = 5, item: str = "path", system: str = "system",
                 rater: str = "rater", seed: int = 42) -> DataFrame:
    """Per rater, n different items in random order, and the systems of each item shuffled.

    Ranking all items for all raters would pair everything with everything. A rater
    instead draws n positions without repeats (for j = N-n .. N-1: a draw from 0..j, or
    j itself if that was taken) and looks them up.
    """
    units = items.select(item).distinct()
    placed = running_offsets(units.withColumn("_g", F.lit(0)), ["_g"], [item], F.lit(1), "_pos").drop("_g")
    total = units.agg(F.count(F.lit(1)).cast("long").alias("n")).scalar()
    people = raters.select(rater).withColumn("_total", total)
    total, take = F.col("_total"), F.least(F.lit(n).cast("long"), F.col("_total"))

    def draw(taken: Column, j: Column) -> Column:
        # j counts back from the end: 0 stands for N - n
        top = total - take + j
        t = F.floor(hash_uniform(rater, j, seed=seed, salt="survey_item") * (top + 1))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, t), top).otherwise(t)))

    steps = F.sequence(F.lit(0).cast("long"), take - 1)
    picked = F.aggregate(steps, F.array().cast("array<bigint>"), draw)
    shown = F.transform(picked, lambda p: F.struct(hash_uniform(rater, p, seed=seed, salt="survey_order").alias("u"), p.alias("_pos")))
    drawn = people.select(rater, F.posexplode(F.array_sort(shown)).alias("item_rank", "_s")).select(rater, "item_rank", "_s._pos")
    rows = drawn.join(placed, "_pos").join(items.select(item, system), item)
    u = hash_uniform(rater, item, system, seed=seed, salt="survey_system")
    # a rater sees the few systems of one item
    rank = F.row_number().over(Window.partitionBy(rater, item).orderBy(u, system)) - 1
    return rows.select(rater, "item_rank", item, rank.alias("system_rank"), system)


def explode_answers(submissions: DataFrame, rater: str = "userId") -> DataFrame:
    """Rows (rater, submitted, path, question, system) from nested answers."""
    return (
        submissions.select(F.col(rater).alias("rater"), F.col("submissionTime").alias("submitted"), F.explode("answers").alias("path", "_q"))
        .select("rater", "submitted", "path", F.explode("_q").alias("question", "_s"))
        .select("rater", "submitted", "path", "question", F.explode_outer("_s").alias("system"))
    )


def valid_raters(votes: DataFrame, systems: int, paths: int = 5, questions: int = 2, by: Sequence[str] = ("rater",)) -> DataFrame:
    """Raters who answered `questions` questions on `paths` paths, each with at least one and not all systems.

    Two roll-ups, cell then rater, each with partial aggregation.
    """
    cells = votes.groupBy(*by, "path", "question").agg(F.count("system").alias("_ticks"), F.count_distinct("system").alias("_d"))
    good = (F.col("_d") > 0) & (F.col("_d") < systems)
    per = cells.groupBy(*by).agg(F.count_distinct("path").alias("_p"), F.count(F.lit(1)).alias("_c"), F.min(good).alias("_ok"))
    return per.where((F.col("_p") == paths) & (F.col("_c") == paths * questions) & F.col("_ok")).select(*by)


def vote_tally(votes: DataFrame, systems: int, paths: int = 5, questions: int = 2, by: Sequence[str] = ("rater",)) -> DataFrame:
    """Votes per question and system among valid raters, and the share of shown answers that ticked it."""
    valid = valid_raters(votes, systems, paths, questions, by)
    kept = votes.join(valid, list(by), "left_semi").where(F.col("system").isNotNull())
    ticks = kept.select(*by, "path", "question", "system").distinct()
    answers = ticks.select(*by, "path", "question").distinct().groupBy("question").agg(F.count(F.lit(1)).alias("answers"))
    votes_ = ticks.groupBy("question", "system").agg(F.count(F.lit(1)).alias("votes"))
    return votes_.join(answers, "question").select("question", "system", "votes", (F.col("votes") / F.col("answers")).alias("share"))
