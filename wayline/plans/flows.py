"""Whole evaluations and the generation run, as chains of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.actions import action_phrase
from wayline.functions.text import extract_score, join_values
from wayline.operators import actions as A
from wayline.operators import consistency as C
from wayline.operators import descriptions as D
from wayline.operators import joins as J
from wayline.operators import models as M
from wayline.operators import retrieval as R
from wayline.operators.diversity import diversity_report
from wayline.operators.frames import KEY, limit_stride
from wayline.operators.ordered import IDX, cut, sequence_block
from wayline.operators.sampling import diversify_action, diversify_element, sample_rows
from wayline.sources import files as S


def describe_runs(frames: DataFrame, key: Sequence[str] = KEY, level: int = 2, max_frames: int | None = None, downsample: int = 1,
                  block: int | None | str = "measure", enter_leave: bool = False, diversify: int = 0, scene: str = "", obj: str = "", seed: int = 42,
                  compact: int | None = None, synonyms: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Frames with predicted actions to one described row per run of equal actions.

    All frames count unless `max_frames` caps them. `block` says how to walk the episodes
    (see `sequence_block`); by default the longest one is measured. Scene and object models
    see representatives only: the middle of a run, or in normal mode (`compact`) the positions
    of `compact_levels`. With `diversify`, actions vary by their phrases, and scenes and objects
    by `synonyms` (word, rank, replacement), where words tagged as names in `tags` stay.
    """
    capped = limit_stride(frames.select(*key, IDX, "action", *[c for c in ("path", "content") if c in frames.columns]), max_frames, downsample)
    block = sequence_block(capped, key) if block == "measure" else block
    smooth = A.smooth_actions(capped, key, level, block=block)
    labelled = A.append_stop(smooth, key, block=block)
    runs = A.action_runs(labelled, key, block=block).withColumn("action", action_phrase("action"))
    if enter_leave:
        spots = A.enter_leave(runs, key, mode="middle" if compact is None else "normal", seed=seed)
    else:
        spots = A.compact_middle(runs, key) if compact is None else A.compact_levels(runs, compact, key)
    if "path" in frames.columns:
        spots = spots.join(capped.drop("action"), [*key, IDX])
    inputs = ["path"] if "path" in frames.columns else ["action"]
    entities = M.annotate(spots, "scene", scene, inputs) if scene else spots.withColumn("scene", F.lit(None).cast("string"))
    entities = M.annotate(entities, "object", obj, inputs) if obj else entities.withColumn("object", F.lit(None).cast("string"))
    if diversify and synonyms is not None:
        for col in ("scene", "object"):
            entities = diversify_element(entities, synonyms, key, diversify, col=col, tags=tags, seed=seed)
    return diversify_action(entities, key, diversify, seed=seed)


def generate(frames: DataFrame, key: Sequence[str] = KEY, summariser: str = "", position: str = "first", **kw) -> DataFrame:
    """One instruction per episode."""
    described = D.frame_description(describe_runs(frames, key, **kw), position)
    return M.summarise(D.assemble(described, key), summariser)


def generate_missing(frames: DataFrame, path: str, alias: str, key: Sequence[str] = KEY, inst_id: str = "0", **kw) -> DataFrame:
    """Generate and add the instructions that `path` lacks; all outputs of the alias, earlier ones included, come back.

    An episode with an output is left out before its frames are described.
    """
    spark = frames.sparkSession
    on = [*key, "inst_alias", "inst_id"]
    done = S.existing(spark, path)
    work = S.expand_outputs(frames.select(*key).distinct(), alias).where(F.col("inst_id") == inst_id)
    if done is not None:
        work = J.skip_existing(work, done.select(*[F.col(c).cast(work.schema[c].dataType).alias(c) for c in on]), on=on)
    todo = frames.join(work.select(*key), list(key), "left_semi")
    made = generate(todo, key, **kw).withColumns({"inst_alias": F.lit(alias), "inst_id": F.lit(inst_id), "text": F.col("instruction")})
    S.write_instructions(made, path)
    return spark.read.parquet(path).where(F.col("inst_alias") == alias)


def generate_files(frames: DataFrame, root: str, alias: str, key: Sequence[str] = KEY, generate_num: int = 1, seed: int = 42, **kw) -> DataFrame:
    """Generate the outputs 0 .. generate_num - 1 that the episode folders lack, as `.txt` and `.info` files; all of the alias come back.

    Episodes that have an output are left out before their frames are described. Output i varies by the seed + i.
    """
    spark = frames.sparkSession
    work = S.expand_outputs(frames.select(*key).distinct(), alias, generate_num)
    on = [*key, "inst_alias", "inst_id"]
    there = S.scan_outputs(spark, root, alias).select(*[F.col(c).cast(work.schema[c].dataType).alias(c) for c in on])
    work = cut(J.skip_existing(work, there, on=on))
    for i in range(generate_num):
        todo = frames.join(work.where(F.col("inst_id") == str(i)).select(*key), list(key), "left_semi")
        made = generate(todo, key, seed=seed + i, **kw)
        S.write_outputs(made.withColumns({"inst_alias": F.lit(alias), "inst_id": F.lit(str(i)), "text": F.col("instruction")}), root)
    return S.scan_instructions(spark, root, None, alias)


def match(features: DataFrame, ids: Sequence[str], episode: Sequence[str], batch_size: int = 32, k: int = 3, kind: str = "cosine") -> DataFrame:
    """Retrieval metrics per batch, averaged over batches."""
    manifest = J.episode_manifest(features, ids, batch_size)
    return R.batch_reduce(R.retrieval_metrics(R.batch_pairs(manifest, episode, kind), k))


def judge(infos: DataFrame, model: str, template: str = "plain", batch: int = 32) -> DataFrame:
    """Infos to scored tasks with a registered `judge` function."""
    flat = infos.select("path", "instruction", *[join_values(F.map_values(m)).alias(f"{t}_info") for t, m in (
        ("action", "actions_compact"), ("scene", "scenes"), ("object", "objects"))])
    prompts = C.judge_prompts(C.explode_tasks(flat), template)
    answered = M.annotate(prompts, "judge", model, ["prompt"], "response", batch)
    return answered.withColumn("score", F.coalesce(extract_score("response"), F.lit(5.0)))


def consistency(infos: DataFrame, model: str, cache: DataFrame | None = None, **kw) -> DataFrame:
    """Mean scores; infos found in `cache` (info_key, info_type, score) are not judged again."""
    if cache is None:
        return C.consistency_scores(judge(infos, model, **kw))
    todo = infos.join(cache.select(F.col("info_key").alias("path")).distinct(), "path", "left_anti")
    fresh = judge(todo, model, **kw).select("info_key", "info_type", "score")
    known = cache.join(infos.select(F.col("path").alias("info_key")), "info_key", "left_semi")
    return C.consistency_scores(known.select("info_key", "info_type", "score").unionByName(fresh))


def diversity(texts: DataFrame, sample_ratio: float = 1.0, group: Sequence[str] = ("inst_alias",), ids: Sequence[str] = (*KEY, "inst_id"),
              seed: int = 42, **kw) -> DataFrame:
    return diversity_report(sample_rows(texts, sample_ratio, [*group, *ids], seed), group=group, ids=ids, **kw)
