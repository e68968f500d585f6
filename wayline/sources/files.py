"""Reading and writing episode folders, corpora, logs and feature tables.

Layout: `<root>/<source>/<split>/<episode>/<modality>/<file>`; keys come from the path.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.util import inheritable_thread_target

from wayline.operators.frames import KEY
from wayline.operators.ordered import IDX, shared_folder
from wayline.sources.episodes import EPISODES, READ, WRITE, clean, mounted, publish_block, read_bytes, register, remove_episode, spare_folders, staging_folder

INFO = (
    "actions array<string>, actions_compact map<string,string>, scenes map<string,string>, objects map<string,string>, "
    "summary string, thinking string, instruction string"
)
SUBMISSION = (
    "userId string, submissionTime timestamp, config struct<allowMultipleChoices:boolean>, "
    "answers map<string,map<string,array<string>>>"
)
TIMING = "actions double, scenes double, objects double, summary double, total double, steps int, steps_compact int"
STAGES = ["actions", "scenes", "objects", "summary", "total"]


def _file_path() -> Column:
    """The path of a JSON file, which the reader gives as an encoded URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _stem(name: str) -> Column:
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def _absolute(root: str) -> str:
    return root.rstrip("/") if "://" in root or root.startswith("file:") else os.path.abspath(root)


def _episodes(spark: SparkSession, root: str, kind: str, folder: str, wanted: Sequence[str], splits: Sequence[str] | None = None,
              episodes: Sequence[str] | None = None, per_task: int = EPISODES) -> DataFrame:
    """Rows of one folder of every episode (see `episodes.EpisodeReader`); nothing outside the splits and episodes is listed."""
    options = {name: json.dumps([str(v) for v in values]) for name, values in (("splits", splits), ("episodes", episodes)) if values is not None}
    options["per_task"] = str(per_task)
    return register(spark).read.format(READ).options(kind=kind, folder=folder, wanted="|".join(wanted), **options).load(_absolute(root))


def scan_frames(spark: SparkSession, root: str, modality: str = "rgb", content: bool = False, png_fallback: bool = True,
                splits: Sequence[str] | None = None, episodes: Sequence[str] | None = None, per_task: int = EPISODES) -> DataFrame:
    """Frames of all episodes, or of those asked for: `*.jpg`, or `*.png` where an episode has no jpg; numbered in natural order.

    A task lists whole episodes, so their frames are chosen and numbered there, without a shuffle; `per_task` of them at
    least. No image is read unless `content` is asked for; select frames first, then `load_content`.
    """
    files = _episodes(spark, root, "names", modality, ["jpg", "png"] if png_fallback else ["jpg"], splits, episodes, per_task)
    frames = files.select(*KEY, "path", "name", F.col("pos").alias(IDX))
    return load_content(spark, frames, root) if content else frames


#: Bytes of files that a task holds at once.
CONTENT_BYTES = 16 << 20


def load_content(spark: SparkSession, frames: DataFrame, root: str) -> DataFrame:
    """Attach the bytes of the given frames; each task opens the files of its own rows."""
    top = _absolute(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(top)
        for b in batches:
            held, first, size = [], 0, 0
            for i, path in enumerate(b.column("path").to_pylist()):
                held.append(read_bytes(store, base.rstrip("/") + path[len(top):]))
                size += len(held[-1])
                if size >= CONTENT_BYTES or i == b.num_rows - 1:
                    yield b.slice(first, len(held)).append_column("content", pa.array(held, pa.binary()))
                    held, first, size = [], i + 1, 0

    return frames.mapInArrow(run, StructType([*frames.schema.fields, StructField("content", BinaryType())]))


OUTPUT = ("source", "split", "episode_id", "inst_alias", "inst_id")


def scan_instructions(spark: SparkSession, root: str | None, splits: Sequence[str] | None, alias: str, written: str | None = None) -> DataFrame:
    """One row per instruction text of an alias, over the splits (None: all): files below `root`, and what `write_instructions` put at `written`."""
    parts = []
    if root is not None:
        raw = _episodes(spark, root, "texts", alias, ["txt"], splits)
        parts.append(raw.select(*KEY, F.lit(alias).alias("inst_alias"), _stem("name").alias("inst_id"), F.col("value").alias("text"), "path"))
    if written is not None:
        parts.append(_written(spark, written, splits, alias).select(*OUTPUT, "text", F.lit(written).alias("path")))
    return reduce(DataFrame.unionByName, parts)


def scan_infos(spark: SparkSession, root: str | None, splits: Sequence[str] | None, alias: str, written: str | None = None) -> DataFrame:
    """One row per info document of an alias, over the splits (None: all), from files and from `written`."""
    parts = []
    if root is not None:
        raw = _episodes(spark, root, "texts", alias, ["info"], splits)
        rows = raw.select(*KEY, F.lit(alias).alias("inst_alias"), _stem("name").alias("inst_id"), F.from_json("value", INFO).alias("_i"), "path")
        parts.append(rows.select(*OUTPUT, "_i.*", "path"))
    if written is not None:
        rows = _written(spark, written, splits, alias)
        fields = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(INFO)]
        parts.append(rows.select(*OUTPUT, *fields, F.lit(written).alias("path")))
    return reduce(DataFrame.unionByName, parts)


def scan_outputs(spark: SparkSession, root: str, alias: str) -> DataFrame:
    """The outputs (episode, alias, id) that are there; their files are listed, not read."""
    return _episodes(spark, root, "names", alias, ["txt"]).select(*KEY, F.lit(alias).alias("inst_alias"), _stem("name").alias("inst_id"))


#: Blocks that a publishing task has at least, and publishing tasks for each core.
BLOCKS, PUBLISHERS = 4, 4


def write_files(rows: DataFrame, root: str, spare: str | None = None) -> None:
    """Write files below the root: rows (paths, contents) of files that belong together. None is replaced, none comes without the others.

    A first job stages the files, a second one gives them their names and removes the staged ones; the driver lists blocks of files
    only. If the first fails, nothing is there; if the second does, whole rows. With `spare`, a folder of the same mount, staged
    blocks are kept there, and a later call writes those of their files over that have lost their names by then: a
    file system that is slow to reuse removed files (ext4 without a journal) then has none to reuse.
    """
    spark, top = register(rows.sparkSession), mounted(_absolute(root))
    staging = staging_folder(top)
    options = {"staging": staging}
    if spare is not None:
        spare_folders(kept := mounted(_absolute(spare)))
        options["spare"] = kept
    staged = rows.select(F.col("paths").cast("array<string>"), F.col("contents").cast("array<binary>"))
    staged.write.format(WRITE).options(**options).mode("append").save(_absolute(root))
    try:
        with open(f"{staging}/committed", encoding="utf-8") as f:
            blocks = json.load(f)
        if blocks:
            tasks = min(-(-len(blocks) // BLOCKS), PUBLISHERS * spark.sparkContext.defaultParallelism)
            spark.sparkContext.parallelize(blocks, tasks).foreach(partial(publish_block, top, spare=options.get("spare")))
    finally:
        clean(staging)


def write_outputs(df: DataFrame, root: str) -> None:
    """Write outputs (episode, alias, id, text and info columns) as `<id>.txt` and `<id>.info` in the alias's folder of each episode.

    The text appears with its document or not at all. Outputs that are there stay, also if another run writes them at the same
    time; a failed job leaves nothing. `root` has to be mounted on all machines.
    """
    there = [f.name for f in StructType.fromDDL(INFO) if f.name in df.columns]
    info = F.to_json(F.struct(*there), {"ignoreNullFields": "false", "pretty": "true"})
    stem = F.concat_ws("/", *[F.col(c).cast("string") for c in ("split", "episode_id", "inst_alias", "inst_id")])
    write_files(df.select(
        F.array(F.concat(stem, F.lit(".info")), F.concat(stem, F.lit(".txt"))).alias("paths"),
        F.array(F.encode(info, "UTF-8"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("contents")), root)


#: Files and folders that `in_rounds` has on disk at once, about, rounds that go on side by side (of LEAST files at least), and
#: slices of a round's rows.
FILES, SIDE, LEAST, SLICES = 1 << 16, 2, 1 << 14, 4


def in_rounds(rows: DataFrame, episode: Sequence[str], files: Column, source: str, step: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What `step(rows, root)` returns, for a step that writes episode folders below the root only to read them back from there.

    Whole episodes, told apart by the columns `episode`, are dealt to rounds, a row counting as `files`; rounds side by side have some
    FILES files. The rows that come back from a round are kept as a table and its folders are removed, so the files on disk don't
    grow with the rows. A single episode is never divided: its files are numbered and chosen together. The root ends in `source`;
    `spare_folder` has the spare blocks of the rounds that follow each other.
    """
    spark = rows.sparkSession
    todo, done, base = (shared_folder(spark, tag) for tag in ("rounds", "read", "files"))
    side = max(1, min(SIDE, FILES // LEAST))
    count, total = rows.agg(F.count(F.lit(1)), F.sum(files)).first()
    rounds = max(1, -(-int(total or 0) * side // FILES))
    dealt = rows.withColumn("_round", F.pmod(F.xxhash64(*episode), F.lit(rounds)).cast("int"))
    # an episode's rows are together, for its folder is asked for once then; those of a long one are in several slices
    ranges = dealt.repartitionByRange(rounds, "_round", *episode, F.xxhash64(*rows.columns)).sortWithinPartitions("_round", *episode)
    ranges.write.partitionBy("_round").option("maxRecordsPerFile", count // (rounds * SLICES) + 1).parquet(todo)
    kept = spark.read.schema(dealt.schema).parquet(todo)
    schemas: list[StructType] = []
    failed: list[BaseException] = []

    def follow(own: int) -> None:
        try:
            spark.createDataFrame([], "none int")  # makes the session that of this thread, without which a Python source is not found
            for i in range(own, rounds, side):
                if failed:
                    return
                root = f"{base}/{own}/{i}/{source}"
                back = step(kept.where(F.col("_round") == i).drop("_round"), root)
                back.write.mode("append").parquet(f"{done}/{own}")
                schemas.append(back.schema)
                remove_episodes(spark, root, spare_folder(root))
            if os.path.exists(spare_folder(root)):
                remove_episodes(spark, spare_folder(root))
        except BaseException as e:
            failed.append(e)

    side = min(side, rounds)
    with ThreadPoolExecutor(side) as pool:
        list(pool.map(inheritable_thread_target(spark)(follow), range(side)))
    shutil.rmtree(mounted(_absolute(base)), ignore_errors=True)
    if failed:
        raise failed[0]
    return spark.read.schema(schemas[0]).parquet(*[f"{done}/{own}" for own in range(side)])


def spare_folder(root: str) -> str:
    """Where the rounds that have their roots beside this one keep staged blocks."""
    return f"{mounted(_absolute(root)).rsplit('/', 2)[0]}/.spare"


def remove_episodes(spark: SparkSession, root: str, spare: str | None = None) -> None:
    """Remove a root with all that is below; tasks remove the episode folders, the driver lists their names only. With `spare` (see
    `write_files`), the empty folders of episodes are kept there as well.
    """
    top = mounted(_absolute(root))
    splits = [f.path for f in os.scandir(top) if f.is_dir(follow_symlinks=False)]
    folders = [f.path for split in splits for f in os.scandir(split) if f.is_dir(follow_symlinks=False)]
    if folders:
        spark.sparkContext.parallelize(folders, min(len(folders), spark.sparkContext.defaultParallelism)).foreach(partial(remove_episode, spare=spare))
    shutil.rmtree(top, ignore_errors=True)


def _written(spark: SparkSession, path: str, splits: Sequence[str] | None, alias: str) -> DataFrame:
    rows = spark.read.parquet(path).withColumn("inst_alias", F.col("inst_alias").cast("string")).where(F.col("inst_alias") == alias)
    return rows if splits is None else rows.where(F.col("split").isin(list(splits)))


def existing(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """The rows at a path, None if nothing was written there yet."""
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _append_new(df: DataFrame, path: str, on: Sequence[str], kind: str, by: Sequence[str] = ()) -> None:
    """Append the rows whose keys are not there yet: what was written before always stays."""
    known = existing(df.sparkSession, path, kind)
    if known is not None:
        keys = known.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in on]).distinct()
        df = df.join(keys, list(on), "left_anti")
    df.write.mode("append").partitionBy(*by).format(kind).save(path)


def scan_action_labels(spark: SparkSession, root: str, files: Sequence[str] = ("0.json", "action.json"),
                       folder: str = "action", splits: Sequence[str] | None = None, episodes: Sequence[str] | None = None) -> DataFrame:
    """Labels per frame from the first of `files` an episode has."""
    rows = _episodes(spark, root, "first", folder, files, splits, episodes).select(*KEY, F.from_json("value", "array<int>").alias("_a"))
    return rows.select(*KEY, F.posexplode("_a").alias("_i", "action")).select(*KEY, F.col("_i").cast("long").alias(IDX), "action")


def scan_corpus(spark: SparkSession, path: str | Sequence[str], kind: str, lang_contains: str | None = None) -> DataFrame:
    """Instruction texts of an external corpus.

    `episodes`: documents with episodes[].instruction.instruction_text; `lists`:
    documents that are arrays of {instructions: []}; `lines`: one JSON object per line
    with `language` and `instruction`, filtered by `lang_contains`. Gzip is transparent.
    """
    source = _file_path().alias("path")
    if kind == "episodes":
        schema = "episodes array<struct<instruction:struct<instruction_text:string>>>"
        raw = spark.read.schema(schema).json(path, multiLine=True)
        return raw.select(source, F.posexplode("episodes").alias("pos", "_e")).select(
            "path", F.col("pos").cast("long").alias("pos"), F.col("_e.instruction.instruction_text").alias("text"))
    if kind == "lists":
        raw = spark.read.schema("instructions array<string>").json(path, multiLine=True)
        return raw.select(source, F.posexplode("instructions").alias("pos", "text"))
    if kind == "lines":
        raw = spark.read.schema("language string, instruction string").json(path)
        kept = raw.where(F.col("language").contains(lang_contains)) if lang_contains else raw
        return kept.select(source, "language", F.col("instruction").alias("text"))
    raise ValueError(f"unknown corpus kind {kind}")


def scan_submissions(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The log of survey submissions, as a batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(SUBMISSION).json(path)


def write_instructions(df: DataFrame, path: str) -> None:
    """Add instruction and info columns of the outputs (episode, alias, id) that are not there yet; none is ever replaced."""
    _append_new(df, path, [c for c in OUTPUT if c in df.columns], "parquet", ["inst_alias"])


def expand_outputs(episodes: DataFrame, alias: str, generate_num: int = 1) -> DataFrame:
    """Work items (episode, alias, i) for i < generate_num."""
    n = F.explode(F.array(*[F.lit(str(i)) for i in range(generate_num)]))
    return episodes.withColumn("inst_alias", F.lit(alias)).withColumn("inst_id", n)


def episode_lists(df: DataFrame, value: str, key: Sequence[str] = KEY, order: str = IDX) -> DataFrame:
    """Ordered list of a value per episode, for outputs that store one document per episode."""
    items = F.array_sort(F.collect_list(F.struct(order, value) if value != order else F.struct(order)))
    return df.groupBy(*key).agg(F.transform(items, lambda s: s[value]).alias(value))


def write_key_frames(df: DataFrame, path: str, key: Sequence[str] = KEY) -> None:
    """Add the key frames of the episodes that are not there yet."""
    _append_new(episode_lists(df, IDX, key), path, key, "json")


def write_actions(df: DataFrame, path: str, alias: str, key: Sequence[str] = KEY) -> None:
    """Add predicted actions, final stop included, of the episodes that the alias lacks."""
    _append_new(episode_lists(df, "action", key).withColumn("alias", F.lit(alias)), path, [*key, "alias"], "json", ["alias"])


def write_metrics(metrics: DataFrame, path: str, alias: str, kind: str, splits: Sequence[str]) -> None:
    """Store rows (metric, value) under alias, kind and the joined splits."""
    named = metrics.withColumns({"alias": F.lit(alias), "kind": F.lit(kind), "splits": F.lit("_".join(splits))})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("alias", "kind", "splits").parquet(path)


def metric_rows(wide: DataFrame) -> DataFrame:
    """A one-row metric table as rows (metric, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns])
    return wide.select(F.inline(pairs))


def append_timings(df: DataFrame, path: str) -> None:
    """Append stage seconds per episode to the log."""
    df.select(*STAGES, "steps", "steps_compact").write.mode("append").json(path)


def scan_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMING).json(path)


def timing_summary(df: DataFrame) -> DataFrame:
    """Mean seconds per stage and mean steps before and after compaction."""
    cols = [*STAGES, "steps", "steps_compact"]
    return df.agg(F.count(F.lit(1)).alias("episodes"), *[F.avg(c).alias(c) for c in cols])


def write_features(df: DataFrame, path: str, ids: Sequence[str] = (*KEY, "inst_id")) -> None:
    """Store pooled vectors, clustered by id so that rows of an episode share files."""
    df.repartition(*ids).sortWithinPartitions(*ids).write.mode("overwrite").parquet(path)


def scan_features(spark: SparkSession, path: str, ids: Sequence[str] = (*KEY, "inst_id")) -> DataFrame:
    """Stored vectors with their joined id `source@split@episode@inst`."""
    return spark.read.parquet(path).withColumn("feature_id", F.concat_ws("@", *ids))
