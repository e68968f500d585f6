"""Trajectory-shaped views of the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.frames import KEY
from wayline.operators.ordered import is_last, number_rows, sequence_block


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """One episode per user, frames in time order."""
    kind = F.col("event_type")
    rows = table(spark, d, "events").select(
        F.lit("synth").alias("source"),
        F.when(F.col("user_id") % 2 == 0, "val_seen").otherwise("val_unseen").alias("split"),
        F.col("user_id").alias("episode_id"),
        F.when(kind == "purchase", 2).when(kind == "signup", 3).otherwise(1).alias("action"),
        kind.alias("obj"), "event_id", "value", "ts")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return number_rows(rows, KEY, ["ts", "event_id"], hour, deal=["episode_id"]).drop("ts")


_BLOCKS: dict[tuple[str, str], int | None] = {}


def block(spark: SparkSession, d: str) -> int | None:
    """How to walk the episodes of `frames`, measured once per application."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _BLOCKS:
        _BLOCKS[at] = sequence_block(table(spark, d, "events"), ["user_id"])
    return _BLOCKS[at]


def labels(spark: SparkSession, d: str) -> DataFrame:
    marked = is_last(frames(spark, d), KEY, block=block(spark, d))
    return marked.withColumn("action", F.when(F.col("_last"), 0).otherwise(F.col("action"))).drop("_last")


def instructions(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        F.col("lang").alias("inst_alias"), F.col("source").alias("split"), F.col("doc_id").alias("episode_id"), "text")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """A corpus with several texts for each episode: the turns of conversations."""
    return table(spark, d, "conversations").select(
        F.col("role").alias("inst_alias"), F.lit("conv").alias("split"), F.col("conv_id").alias("episode_id"), F.col("turn").alias("inst_id"),
        F.coalesce("text", F.lit("")).alias("text"))


def small_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The whole benchmark table: the corpus for statistics that are quadratic by definition."""
    return table(spark, d, "benchmark").select(F.lit("benchmark").alias("inst_alias"), F.col("item_id").alias("episode_id"), "text")


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Judge answers, three per info."""
    n = (F.floor("value") % 13).cast("int").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit("Score here: fine <"), n, F.lit(">")))
        .when(kind == "click", F.concat(F.lit("I give a score of "), n, F.lit(".5")))
        .when(kind == "purchase", F.concat(F.lit("**"), n, F.lit(" out of 10**")))
        .when(kind == "signup", F.concat(F.lit("<"), n, F.lit("/30>"))).otherwise("no verdict"))
    typ = F.when(F.col("event_id") % 3 == 0, "Action").when(F.col("event_id") % 3 == 1, "Scene").otherwise("Object")
    return table(spark, d, "events").select(
        F.col("event_id").alias("task_id"), F.floor(F.col("event_id") / 3).alias("info_id"), typ.alias("info_type"), text.alias("response"))


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias("pair_id"), F.when(F.col("vec_id") % 2 == 0, "v").otherwise("t").alias("side"),
        F.col("label").alias("episode_id"), F.col("embedding").alias("vec"))


def feature_pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair with v, t and the video's episode; a label is shared by several pairs."""
    rows = features(spark, d)
    return rows.groupBy("pair_id").agg(
        F.min(F.when(F.col("side") == "v", F.col("episode_id"))).alias("episode_id"),
        F.first(F.when(F.col("side") == "v", F.col("vec")), True).alias("v"),
        F.first(F.when(F.col("side") == "t", F.col("vec")), True).alias("t"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("det_id"),
        F.concat("l_returnflag", "l_linestatus").alias("label"), (F.col("l_tax") * 12).alias("score"),
        (F.col("l_quantity") * 10).alias("cx"), (F.col("l_discount") * 4800).alias("cy"), F.lit(500).alias("w"), F.lit(480).alias("h"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Long votes; a rater is a user."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("rater"), (F.col("event_id") % 5).cast("int").alias("path"),
        (F.col("event_id") % 2).cast("int").alias("question"), F.col("event_type").alias("system"), "ts")


def dialogue(spark: SparkSession, d: str) -> DataFrame:
    """Per-frame entities with free text; the action alternates with the turn."""
    turn = F.col("turn").cast("long")
    action = F.when(turn % 3 == 0, "move forward").when(turn % 3 == 1, "turn left").otherwise("enter")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("episode_id"), turn.alias("frame_idx"), action.alias("action"), F.col("role").alias("scene"),
        F.col("text").alias("object"))


def videos(spark: SparkSession, d: str) -> DataFrame:
    """One video per order: length and frame rate from its columns."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("video_id"), (F.floor("o_totalprice") % 400 + 5).cast("long").alias("vlen"),
        (F.col("o_custkey") % 6 + 1).cast("double").alias("fps"))


def images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("image_id"), (F.floor("o_totalprice") % 1900 + 100).cast("int").alias("w"),
        (F.floor(F.col("o_totalprice") / 7) % 1100 + 100).cast("int").alias("h"))
