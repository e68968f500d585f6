"""Round trips: driver tables written by the sinks, or in a source's format, and read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline.operators.ordered import IDX, shared_folder
from wayline.plans import fixtures as X
from wayline.plans.catalog_base import query, using
from wayline.sources import files as S

KEYS = "source, split, episode_id"


@query("scan_corpus", """SELECT 'some lines' AS kind, lang AS language, md5(text) AS text FROM documents WHERE lang LIKE '%e%' UNION ALL
    SELECT 'lines', lang, md5(text) FROM documents UNION ALL SELECT 'lists', NULL, md5(text) FROM benchmark UNION ALL SELECT 'episodes', NULL, md5(text) FROM benchmark""")
def _scan_corpus(s, d):
    docs, items = X.table(s, d, "documents"), X.table(s, d, "benchmark")
    lines, lists, episodes = (shared_folder(s, k) for k in ("lines", "lists", "episodes"))
    docs.select(F.col("lang").alias("language"), F.col("text").alias("instruction")).write.option("compression", "gzip").json(lines)
    # a document, and a file, for each hundred items
    text = F.struct(F.struct(F.col("text").alias("instruction_text")).alias("instruction"))
    groups = items.groupBy(F.floor(F.col("item_id") / 100))
    groups.agg(F.to_json(F.array(F.struct(F.collect_list("text").alias("instructions")))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(lists)
    groups.agg(F.to_json(F.struct(F.collect_list(text).alias("episodes"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(episodes)
    none = F.lit(None).cast("string").alias("language")
    # all languages, and those whose name holds a text
    out = S.scan_corpus(s, lines, "lines").select(F.lit("lines").alias("kind"), "language", F.md5("text").alias("text"))
    out = out.unionByName(S.scan_corpus(s, lines, "lines", "e").select(F.lit("some lines").alias("kind"), "language", F.md5("text").alias("text")))
    for path, kind in ((lists, "lists"), (episodes, "episodes")):
        out = out.unionByName(S.scan_corpus(s, path, kind).select(F.lit(kind).alias("kind"), none, F.md5("text").alias("text")))
    return out


@query("scan_submissions", """SELECT CAST(user_id AS VARCHAR) AS "userId", event_id, event_type AS system, event_id % 2 = 0 AS multiple FROM events""")
def _scan_submissions(s, d):
    path, n = shared_folder(s, "submissions"), F.col("event_id").cast("string")
    X.table(s, d, "events").select(
        F.col("user_id").cast("string").alias("userId"), F.col("ts").cast("timestamp").alias("submissionTime"),
        F.struct((F.col("event_id") % 2 == 0).alias("allowMultipleChoices")).alias("config"),
        F.create_map(n, F.create_map(F.lit("0"), F.array("event_type"))).alias("answers")).write.json(path)
    return S.scan_submissions(s, path).select(
        "userId", F.col("config.allowMultipleChoices").alias("multiple"), F.explode("answers").alias("id", "a")).select(
        "userId", F.col("id").cast("bigint").alias("event_id"), F.element_at(F.col("a")["0"], 1).alias("system"), "multiple")


@query("write_actions", using("fx_frames", f"""SELECT {KEYS}, alias, string_agg(action, ',' ORDER BY frame_idx) AS actions
    FROM fx_frames, (SELECT unnest(['one', 'two']) AS alias) GROUP BY ALL"""))
def _write_actions(s, d):
    frames, path = X.frames(s, d), shared_folder(s, "actions")
    S.write_actions(frames.where(F.col("episode_id") % 2 == 0), path, "one")
    for alias in ("one", "two"):
        S.write_actions(frames, path, alias)
    return s.read.json(path).select("source", "split", "episode_id", "alias", F.array_join(F.col("action").cast("array<string>"), ",").alias("actions"))


@query("write_metrics", """SELECT metric, round(value, 6) AS value, alias, 'counts' AS kind, 'val_test' AS splits FROM (
    SELECT event_type AS alias, count(*)::DOUBLE AS events, count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY 1)
    UNPIVOT (value FOR metric IN (events, users))""")
def _write_metrics(s, d):
    e, path = X.table(s, d, "events"), shared_folder(s, "metrics")
    for alias in ("view", "click", "purchase", "signup", "error", "view"):  # a repeated report replaces its own rows only
        wide = e.where(F.col("event_type") == alias).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))
        S.write_metrics(S.metric_rows(wide), path, alias, "counts", ["val", "test"])
    return s.read.parquet(path).select("metric", F.round("value", 6).alias("value"), "alias", "kind", "splits")


@query("write_features", """SELECT concat('emb@', vec_id % 3, '@', vec_id, '@0') AS feature_id, len(embedding) AS size, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM embeddings""")
def _write_features(s, d):
    path = shared_folder(s, "features")
    e = X.table(s, d, "embeddings").select(
        F.lit("emb").alias("source"), (F.col("vec_id") % 3).cast("string").alias("split"), F.col("vec_id").cast("string").alias("episode_id"), F.lit("0").alias("inst_id"),
        F.lit("v").alias("side"), F.col("embedding").alias("vec"))
    S.write_features(e, path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return S.scan_features(s, path).select("feature_id", F.size("vec").cast("bigint").alias("size"), F.round(total, 3).alias("total"))


def _path(*parts):
    return F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


@query("scan_frames", using("fx_frames", f"""SELECT {KEYS}, frame_idx, concat(frame_idx, CASE WHEN episode_id % 3 = 0 THEN '_0.png' ELSE '_0.jpg' END) AS name, event_id
    FROM fx_frames"""))
def _scan_frames(s, d):
    # a file for each frame; a third of the episodes has png images only, another third has some beside its jpg images
    e = F.col("episode_id")
    png, jpg = e % 3 == 0, e % 3 == 1

    def through_files(f, root):
        stem = _path(F.col("split"), e, "rgb", F.concat(F.col(IDX).cast("string"), F.lit("_0")))
        body = F.encode(F.col("event_id").cast("string"), "UTF-8")
        names = F.when(png, F.array(F.concat(stem, F.lit(".png")))).when(jpg, F.array(F.concat(stem, F.lit(".jpg")))).otherwise(
            F.array(F.concat(stem, F.lit(".png")), F.concat(stem, F.lit(".jpg"))))
        S.write_files(f.select(names.alias("paths"), F.transform(names, lambda _: body).alias("contents")), root, S.spare_folder(root))
        back = S.scan_frames(s, root, content=True, per_task=128)
        return back.select("source", "split", e.cast("bigint").alias("episode_id"), IDX, "name", F.decode("content", "UTF-8").cast("bigint").alias("event_id"))

    frames = X.frames(s, d).select("split", "episode_id", IDX, "event_id")
    return S.in_rounds(frames, ["split", "episode_id"], F.when(png | jpg, 1).otherwise(2), "synth", through_files)


@query("scan_action_labels", using("fx_labels", f"SELECT {KEYS}, frame_idx, action FROM fx_labels"))
def _scan_action_labels(s, d):
    # half of the episodes has its labels under the second name, some have other labels under it
    e = F.col("episode_id")

    def through_files(lists, root):
        first, second = (_path(F.col("split"), e, "action", n) for n in ("0.json", "action.json"))
        wrong = F.encode(F.lit("[9]"), "UTF-8")
        S.write_files(lists.withColumn("actions", F.encode(F.to_json("action"), "UTF-8")).select(
            F.when(e % 2 == 0, F.array(first)).when(e % 3 == 0, F.array(second)).otherwise(F.array(second, first)).alias("paths"),
            F.when((e % 2 == 0) | (e % 3 == 0), F.array("actions")).otherwise(F.array(wrong, F.col("actions"))).alias("contents")), root, S.spare_folder(root))
        return S.scan_action_labels(s, root).select("source", "split", e.cast("bigint").alias("episode_id"), IDX, "action")

    # two files at most, and two folders
    lists = S.episode_lists(X.labels(s, d), "action").select("split", "episode_id", "action")
    return S.in_rounds(lists, ["split", "episode_id"], F.lit(4), "synth", through_files)


def _outputs(s, d, name):
    """The turns of conversations as outputs: an id for each turn, an alias for each role."""
    turns = X.turns(s, d).withColumns({"inst_alias": F.concat(F.lit("inst_"), F.col("inst_alias")), "split": F.when(F.col("episode_id") % 2 == 0, "val").otherwise("test")})
    rows = turns.withColumns({
        "scenes": F.create_map(F.col("inst_id").cast("string"), F.when(F.col("inst_id") % 2 == 0, F.md5("text"))), "actions": F.array(F.lit("stop"), F.col("inst_alias")),
        "instruction": F.col("text")})
    root = f"{shared_folder(s, name)}/synth"
    # two runs: the second finds some of its outputs there, and would write others
    S.write_outputs(rows.where(F.col("inst_id") % 3 == 0), root)
    S.write_outputs(rows.withColumns({c: F.when(F.col("inst_id") % 3 == 0, "replaced").otherwise(F.col(c)) for c in ("text", "instruction")}), root)
    return root


_TURNS = """SELECT 'synth' AS source, CASE WHEN conv_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, conv_id AS episode_id, 'inst_' || role AS inst_alias, turn AS inst_id,
    coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant')"""


@query("write_instructions", f"SELECT source, split, episode_id, inst_alias, inst_id, md5(text) AS text FROM ({_TURNS})")
def _write_instructions(s, d):
    root = _outputs(s, d, "texts")
    back = S.scan_instructions(s, root, ["val", "test"], "inst_user").unionByName(S.scan_instructions(s, root, ["val"], "inst_assistant")).unionByName(
        S.scan_instructions(s, root, ["test"], "inst_assistant"))
    return back.select("source", "split", F.col("episode_id").cast("bigint").alias("episode_id"), "inst_alias", F.col("inst_id").cast("bigint").alias("inst_id"), F.md5("text").alias("text"))


@query("scan_infos", f"""SELECT source, split, episode_id, inst_alias, inst_id, 'stop,' || inst_alias AS actions, md5(text) AS instruction,
    CASE WHEN inst_id % 2 = 0 THEN md5(text) END AS scene FROM ({_TURNS}) WHERE split = 'val'""")
def _scan_infos(s, d):
    root = _outputs(s, d, "infos")
    back = S.scan_infos(s, root, ["val"], "inst_user").unionByName(S.scan_infos(s, root, ["val", "nowhere"], "inst_assistant"))
    return back.select("source", "split", F.col("episode_id").cast("bigint").alias("episode_id"), "inst_alias", F.col("inst_id").cast("bigint").alias("inst_id"),
                       F.array_join("actions", ",").alias("actions"), F.md5("instruction").alias("instruction"), F.col("scenes")[F.col("inst_id")].alias("scene"))
