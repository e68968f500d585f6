"""Checkable queries: frames, actions, descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import actions as codec
from wayline.functions.random import hash_uniform
from wayline.operators import actions as A
from wayline.operators import descriptions as D
from wayline.operators import frames as FR
from wayline.operators import joins as J
from wayline.operators import models as M
from wayline.operators import motion as MO
from wayline.operators import sampling as SA
from wayline.functions.lexicon import ACTION_PHRASES
from wayline.operators.frames import KEY
from wayline.operators.ordered import IDX, cut, number_rows, sequence_block, shared_folder
from wayline.plans import fixtures as X
from wayline.plans.catalog_base import query, r6, u, using
from wayline.plans.flows import generate, generate_files, generate_missing
from wayline.sources import files

ROW = "source, split, episode_id, frame_idx"
KEYS = "source, split, episode_id"
U_KEY = ("source", "split", "CAST(episode_id AS VARCHAR)")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("hash_uniform", f"SELECT event_id, {u('demo', 'CAST(event_id AS VARCHAR)', 'event_type')} AS u FROM events")
def _hash_uniform(s, d):
    return X.table(s, d, "events").select("event_id", hash_uniform("event_id", "event_type", salt="demo").alias("u"))


_NAMES = """SELECT user_id, CASE event_id % 4 WHEN 0 THEN concat(CAST(floor(value) AS BIGINT), '_', event_id, '.jpg') WHEN 1 THEN concat('frame', event_id, '.jpg')
    WHEN 2 THEN concat(event_id % 7, '1234567890123456789012345', event_id, '.jpg') ELSE concat('frame.', event_id, 'x.jpg') END AS name FROM events"""


# numbers are compared as numbers here: 38 digits fit
@query("frame_order", rf"""SELECT user_id AS episode_id, name, row_number() OVER (PARTITION BY user_id ORDER BY
    list_transform(list_filter(regexp_extract_all(name, '[^0-9]*[0-9]*'), lambda p: p <> ''), lambda p:
      {{'t': regexp_extract(p, '^[^0-9]*'), 'n': coalesce(TRY_CAST(regexp_extract(p, '[0-9]+$') AS HUGEINT), -1)}}), name) - 1 AS frame_idx,
    row_number() OVER (PARTITION BY user_id ORDER BY TRY_CAST(regexp_extract(name, '^[0-9]+') AS BIGINT) NULLS LAST, name) - 1 AS number_idx FROM ({_NAMES})""")
def _frame_order(s, d):
    e, n = X.table(s, d, "events"), F.col("event_id")
    name = (
        F.when(n % 4 == 0, F.concat(F.floor("value").cast("string"), F.lit("_"), n, F.lit(".jpg"))).when(n % 4 == 1, F.concat(F.lit("frame"), n, F.lit(".jpg")))
        .when(n % 4 == 2, F.concat(n % 7, F.lit("1234567890123456789012345"), n, F.lit(".jpg"))).otherwise(F.concat(F.lit("frame."), n, F.lit("x.jpg"))))
    out = FR.frame_order(e.select(F.col("user_id").alias("episode_id"), name.alias("name")), ["episode_id"])
    return FR.frame_order(out.withColumnRenamed(IDX, "natural_idx"), ["episode_id"], by_number=True).select(
        "episode_id", "name", F.col("natural_idx").alias("frame_idx"), F.col(IDX).alias("number_idx"))


@query("limit_stride", using("fx_frames", f"""SELECT {KEYS}, frame_idx // 3 AS frame_idx, event_id FROM fx_frames
    WHERE frame_idx < 40 AND frame_idx % 3 = 0"""))
def _limit_stride(s, d):
    return FR.limit_stride(X.frames(s, d), 40, 3).select(*KEY, IDX, "event_id")


@query("stride_limit", using("fx_frames", f"""SELECT {KEYS}, frame_idx // 3 AS frame_idx, event_id FROM fx_frames
    WHERE frame_idx % 3 = 0 AND frame_idx // 3 < 15"""))
def _stride_limit(s, d):
    return FR.stride_limit(X.frames(s, d), 3, 15).select(*KEY, IDX, "event_id")


@query("auto_downsample", using("fx_frames", f"""SELECT {KEYS}, frame_idx // ds AS frame_idx, event_id FROM (
    SELECT *, 1 + count(*) OVER (PARTITION BY episode_id) // 20 AS ds FROM fx_frames)
    WHERE frame_idx % ds = 0 AND frame_idx // ds < 12"""))
def _auto_downsample(s, d):
    return FR.auto_downsample(X.frames(s, d), limit=20, cap=12).select(*KEY, IDX, "event_id")


@query("select_key_frames", using("fx_frames", f"""SELECT {ROW}, event_id FROM fx_frames f WHERE EXISTS (
    SELECT 1 FROM fx_frames g WHERE g.episode_id = f.episode_id AND g.frame_idx * 5 = f.frame_idx AND g.obj = 'view')"""))
def _select_key_frames(s, d):
    f = X.frames(s, d)
    marks = f.where("obj = 'view'").select(*KEY, (F.col(IDX) * 5).alias(IDX))
    return FR.select_key_frames(f, marks).select(*KEY, IDX, "event_id")


@query("complete_episodes", using("fx_frames", f"""SELECT {KEYS}, count(*) AS n_frames, count(*) FILTER (value < 250) AS n_labels,
    CASE WHEN count(*) FILTER (value < 250) = 0 THEN 'no labels' WHEN count(*) <> count(*) FILTER (value < 250) THEN 'length mismatch'
    ELSE 'ok' END AS status FROM fx_frames GROUP BY {KEYS}"""))
def _complete_episodes(s, d):
    f = X.frames(s, d)
    ok, bad = FR.complete_episodes(f, f.where("value < 250"))
    return ok.withColumn("status", F.lit("ok")).unionByName(bad.withColumnRenamed("reason", "status"))


@query("action_codec", """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'turn left' WHEN 'signup' THEN 'turn right' ELSE 'move forward' END AS phrase,
    CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 1 END AS code,
    CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS cls FROM events""")
def _action_codec(s, d):
    f = X.frames(s, d).withColumn("phrase", codec.action_phrase("action"))
    return f.select("event_id", "phrase", codec.action_code("phrase").alias("code"), codec.training_class("action").alias("cls"))


@query("thin_fps", using("fx_frames", f"SELECT {KEYS}, frame_idx // 4 AS frame_idx, event_id FROM fx_frames WHERE frame_idx % 4 = 0"))
def _thin_fps(s, d):
    return FR.thin_fps(X.frames(s, d), 30, 7).select(*KEY, IDX, "event_id")


_PAIRS = f"""SELECT * FROM (SELECT {ROW}, event_id AS first_item, lead(event_id) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS second_item,
    action FROM fx_frames) WHERE second_item IS NOT NULL"""


@query("frame_pairs", using("fx_frames", _PAIRS))
def _frame_pairs(s, d):
    return FR.frame_pairs(X.frames(s, d), block=X.block(s, d))


@query("pair_swap", using("fx_frames", f"""SELECT {ROW}, CASE WHEN sw THEN second_item ELSE first_item END AS first_item,
    CASE WHEN sw THEN first_item ELSE second_item END AS second_item, CASE WHEN sw THEN 3 - (action - 1) ELSE action - 1 END AS cls
    FROM (SELECT *, action > 1 AND {u('pair_swap', *U_KEY, 'CAST(frame_idx AS VARCHAR)')} < 0.5 AS sw FROM pairs)""", pairs=_PAIRS))
def _pair_swap(s, d):
    pairs = FR.frame_pairs(X.frames(s, d), block=X.block(s, d)).withColumn("cls", codec.training_class("action"))
    return FR.pair_swap(pairs)


@query("merge_frames_aug", using("fx_frames", f"""SELECT {KEYS}, g * 3 AS first_idx, g * 3 + 2 AS second_idx, action FROM (
    SELECT *, frame_idx // 3 AS g FROM fx_frames) GROUP BY {KEYS}, g, action HAVING count(*) = 3"""))
def _merge_frames_aug(s, d):
    return FR.merge_frames_aug(X.frames(s, d), f=2)


@query("label_frames", using("fx_labels", f"SELECT f.{ROW.replace(', ', ', f.')}, f.event_id, l.action AS label FROM fx_frames f JOIN fx_labels l USING (episode_id, frame_idx)"))
def _label_frames(s, d):
    f, lab = X.frames(s, d).select(*KEY, IDX, "event_id"), X.labels(s, d).select(*KEY, IDX, F.col("action").alias("label"))
    return J.label_frames(f, lab)


@query("append_stop", using("fx_labels", f"SELECT {ROW}, action FROM fx_labels"))
def _append_stop(s, d):
    f = X.frames(s, d).withColumn("action", F.col("action").cast("int"))
    return A.append_stop(f, block=X.block(s, d)).select(*KEY, IDX, "action")


@query("smooth_single_turn", using("fx_labels", f"""SELECT {ROW}, CASE WHEN p = 1 AND n = 1 AND action IN (2, 3) THEN 1 ELSE action END AS action
    FROM (SELECT *, lag(action) OVER w AS p, lead(action) OVER w AS n FROM fx_labels WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx))
    WHERE n IS NOT NULL"""))
def _smooth_single_turn(s, d):
    return A.smooth_single_turn(X.labels(s, d), block=X.block(s, d)).select(*KEY, IDX, "action")


def _aba(values: str, source: str = "fx_frames") -> dict[str, str]:
    return {
        "n0": f"SELECT *, lead(action) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS nx FROM {source}",
        "aba": f"""SELECT source, split, episode_id, frame_idx, action AS o FROM n0 WHERE frame_idx = 0 UNION ALL
            SELECT n0.source, n0.split, n0.episode_id, n0.frame_idx, CASE WHEN n0.nx IS NOT NULL AND aba.o = n0.nx AND aba.o <> n0.action
            AND aba.o IN {values} THEN aba.o ELSE n0.action END
            FROM aba JOIN n0 ON n0.episode_id = aba.episode_id AND n0.frame_idx = aba.frame_idx + 1""",
    }


def _majority(source: str, strict: bool = False) -> dict[str, str]:
    tie = "action" if strict else "first_label"
    return {
        "mj0": f"SELECT source, split, episode_id, frame_idx, action, action IN (2, 3) AS turn FROM {source}",
        "mj1": "SELECT *, frame_idx - row_number() OVER (PARTITION BY episode_id, turn ORDER BY frame_idx) AS island FROM mj0",
        "mj2": """SELECT *, sum((action = 2)::INT) OVER w AS nl, sum((action = 3)::INT) OVER w AS nr,
            first_value(action) OVER (PARTITION BY episode_id, turn, island ORDER BY frame_idx) AS first_label
            FROM mj1 WINDOW w AS (PARTITION BY episode_id, turn, island)""",
        "mj": f"""SELECT source, split, episode_id, frame_idx, CASE WHEN NOT turn THEN action WHEN nl > nr THEN 2 WHEN nr > nl THEN 3
            ELSE {tie} END AS action FROM mj2""",
    }


@query("smooth_aba", using("fx_frames", f"SELECT {ROW}, o AS action FROM aba", **_aba("(1, 2, 3)")))
def _smooth_aba(s, d):
    return A.smooth_aba(X.frames(s, d), block=X.block(s, d)).select(*KEY, IDX, "action")


@query("smooth_aba_forward", using("fx_frames", f"SELECT {ROW}, o AS action FROM aba", **_aba("(1)")))
def _smooth_aba_forward(s, d):
    return A.smooth_aba(X.frames(s, d), block=X.block(s, d), values=(1,)).select(*KEY, IDX, "action")


@query("smooth_turn_majority", using("fx_frames", f"SELECT {ROW}, action FROM mj", **_majority("fx_frames")))
def _smooth_turn_majority(s, d):
    return A.smooth_turn_majority(X.frames(s, d), block=X.block(s, d)).select(*KEY, IDX, "action")


@query("smooth_turn_majority_strict", using("fx_frames", f"SELECT {ROW}, action FROM mj", **_majority("fx_frames", True)))
def _smooth_turn_majority_strict(s, d):
    return A.smooth_turn_majority(X.frames(s, d), block=X.block(s, d), strict=True).select(*KEY, IDX, "action")


_SMOOTH = {**_aba("(1, 2, 3)"), "sm": "SELECT source, split, episode_id, frame_idx, o AS action FROM aba", **_majority("sm")}


@query("smooth_actions", using("fx_frames", f"SELECT {ROW}, action FROM mj", **_SMOOTH))
def _smooth_actions(s, d):
    return A.smooth_actions(X.frames(s, d), block=X.block(s, d)).select(*KEY, IDX, "action")


@query("action_runs", using("fx_runs", f"SELECT {KEYS}, action, head, tail, length, middle FROM fx_runs"))
def _action_runs(s, d):
    return A.action_runs(X.labels(s, d), block=X.block(s, d))


@query("compact_middle", using("fx_runs", f"SELECT {KEYS}, middle AS frame_idx, action FROM fx_runs"))
def _compact_middle(s, d):
    return A.compact_middle(A.action_runs(X.labels(s, d), block=X.block(s, d)))


@query("compact_levels", using("fx_runs", f"""SELECT DISTINCT {KEYS}, 1 AS level, tail AS frame_idx, action FROM fx_runs UNION ALL
    SELECT DISTINCT {KEYS}, 2, unnest([middle, tail]), action FROM fx_runs WHERE length >= 2 UNION ALL
    SELECT DISTINCT {KEYS}, 3, unnest([head, middle, tail]), action FROM fx_runs WHERE length >= 3 UNION ALL
    SELECT {KEYS}, -1, frame_idx, action FROM fx_labels"""))
def _compact_levels(s, d):
    runs = A.action_runs(X.labels(s, d), block=X.block(s, d))
    return _union([A.compact_levels(runs, lv).withColumn("level", F.lit(lv)) for lv in (1, 2, 3, -1)])


def _enter_sql(mode: str, short: str) -> str:
    ph = "CASE action WHEN 0 THEN 'stop' WHEN 1 THEN 'move forward' WHEN 2 THEN 'turn left' ELSE 'turn right' END"
    head = "CAST(head AS VARCHAR)"
    rest = "middle" if mode == "middle" else "tail"
    short_word = "'enter'" if short == "enter" or mode == "normal" else "phrase"
    return f"""SELECT {KEYS}, '{mode}_{short}' AS kind,
        CASE WHEN NOT gate OR tail - head < 2 THEN {rest} WHEN draw < 0.3334 THEN tail WHEN draw < 0.6667 THEN middle ELSE head END AS frame_idx,
        CASE WHEN NOT gate THEN phrase WHEN tail - head < 2 THEN {short_word} WHEN draw < 0.3334 THEN 'enter' WHEN draw < 0.6667 THEN 'pass'
        ELSE 'leave' END AS action FROM (SELECT *, {ph} AS phrase, action = 1 AND {u('enter_leave', *U_KEY, head)} < 0.5 AS gate,
        {u('enter_leave_kind', *U_KEY, head)} AS draw FROM fx_runs)"""


@query("enter_leave", using("fx_runs", " UNION ALL ".join(_enter_sql(m, x) for m, x in (("middle", "keep"), ("middle", "enter"), ("normal", "keep")))))
def _enter_leave(s, d):
    runs = A.action_runs(X.labels(s, d), block=X.block(s, d)).withColumn("action", codec.action_phrase("action"))
    return _union([A.enter_leave(runs, mode=m, short=x).withColumn("kind", F.lit(f"{m}_{x}"))
                   for m, x in (("middle", "keep"), ("middle", "enter"), ("normal", "keep"))])


_KEY_FRAMES = {
    **_majority("fx_frames"),
    "kl": "SELECT source, split, episode_id, frame_idx, CASE WHEN frame_idx = max(frame_idx) OVER (PARTITION BY episode_id) THEN 0 ELSE action END AS action FROM mj",
    "ki": "SELECT *, frame_idx - row_number() OVER (PARTITION BY episode_id, action ORDER BY frame_idx) AS island FROM kl",
    "kr": "SELECT source, split, episode_id, (min(frame_idx) + max(frame_idx)) // 2 AS frame_idx FROM ki GROUP BY source, split, episode_id, action, island",
}


@query("key_frames", using("fx_frames", f"SELECT {ROW} FROM kr UNION SELECT DISTINCT {KEYS}, CAST(0 AS BIGINT) FROM kr", **_KEY_FRAMES))
def _key_frames(s, d):
    return A.key_frames(X.frames(s, d), block=X.block(s, d))


@query("write_key_frames", using("fx_frames", f"""SELECT {KEYS}, string_agg(frame_idx, ',' ORDER BY frame_idx) AS frames
    FROM (SELECT {ROW} FROM kr UNION SELECT DISTINCT {KEYS}, CAST(0 AS BIGINT) FROM kr) GROUP BY {KEYS}""", **_KEY_FRAMES))
def _write_key_frames(s, d):
    found, path = cut(A.key_frames(X.frames(s, d), block=X.block(s, d))), shared_folder(s, "key-frames")
    # two runs: nothing of the first is lost, nothing comes twice
    files.write_key_frames(found.where(F.col("episode_id") % 2 == 0), path)
    files.write_key_frames(found, path)
    return s.read.json(path).select(*KEY, F.array_join(F.col(IDX).cast("array<string>"), ",").alias("frames"))


_POSES = {
    "h0": """SELECT *, sum(CASE action WHEN 2 THEN 15 WHEN 3 THEN -15 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS turned FROM fx_labels""",
    "h1": "SELECT *, CAST(((turned % 360) + 360) % 360 AS BIGINT) AS heading FROM h0",
    "h2": """SELECT *, sum(CASE WHEN action = 1 THEN 0.25::DOUBLE * cos(radians(heading)) ELSE 0 END) OVER w AS x,
        sum(CASE WHEN action = 1 THEN 0.25::DOUBLE * sin(radians(heading)) ELSE 0 END) OVER w AS y FROM h1 WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)""",
    "poses": f"""SELECT {KEYS}, frame_idx + 1 AS pose_idx, x, y, heading FROM h2 UNION ALL
        SELECT DISTINCT {KEYS}, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS BIGINT) FROM fx_labels""",
}


@query("dead_reckoning", using("fx_labels", f"SELECT {KEYS}, pose_idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, heading FROM poses", **_POSES))
def _dead_reckoning(s, d):
    return MO.dead_reckoning(X.labels(s, d), block=X.block(s, d)).select(*KEY, "pose_idx", r6("x"), r6("y"), "heading")


@query("step_distance", using("fx_labels", f"""SELECT {KEYS}, pose_idx, round(sqrt(power((x - px) * 10, 2) + power((y - py) * 10, 2)), 6) + 0.0 AS distance
    FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM poses WINDOW w AS (PARTITION BY episode_id ORDER BY pose_idx)) WHERE px IS NOT NULL""", **_POSES))
def _step_distance(s, d):
    return MO.step_distance(MO.dead_reckoning(X.labels(s, d), block=X.block(s, d)), block=X.block(s, d)).select(*KEY, "pose_idx", r6("distance"))


@query("motion_class", """SELECT vec_id, CASE WHEN b < -7 THEN 3 WHEN b > 7 THEN 2 ELSE 1 END AS action, round(b, 6) + 0.0 AS angle
    FROM (SELECT vec_id, degrees(-asin(CAST(embedding[7] AS DOUBLE))) AS b FROM embeddings)""")
def _motion_class(s, d):
    e = X.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = e.select("vec_id", F.array(F.slice("e", 1, 3), F.slice("e", 4, 3), F.slice("e", 7, 3)).alias("rotation"))
    return rows.select("vec_id", MO.motion_class("rotation").alias("action"), r6(MO.motion_angle("rotation"), "angle"))


@query("similar_runs", using("", f"""SELECT DISTINCT label AS episode_id, CAST(unnest([pick, last_idx]) AS BIGINT) AS frame_idx FROM (
    SELECT label, run, min_by(frame_idx, {u('similar_runs', 'CAST(label AS VARCHAR)', 'CAST(frame_idx AS VARCHAR)')}) AS pick, any_value(last_idx) AS last_idx
    FROM (SELECT *, sum(CASE WHEN sim > 0.2 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY frame_idx) AS run,
      max(frame_idx) OVER (PARTITION BY label) AS last_idx FROM sims) GROUP BY label, run)""",
    vecs="SELECT label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx FROM embeddings",
    sims="""SELECT label, frame_idx, list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))) AS sim FROM (
      SELECT *, lag(e) OVER (PARTITION BY label ORDER BY frame_idx) AS p FROM vecs)"""))
def _similar_runs(s, d):
    e = X.table(s, d, "embeddings").select(F.col("label").alias("episode_id"), "vec_id", F.col("embedding").alias("vec"))
    rows = number_rows(e, ["episode_id"], ["vec_id"], F.floor(F.col("vec_id") / 4096))
    return D.similar_runs(rows, ["episode_id"], threshold=0.2, block=sequence_block(e, ["episode_id"]))


_SCENES = f"""SELECT {KEYS}, n_frames, n_items, CASE WHEN n_frames >= 58 AND n_items >= 3 THEN
      [CAST(floor({u('pick_scenes_a', *U_KEY)} * (greatest(0, mid - 1) + 1)) AS BIGINT),
       mid + CAST(floor({u('pick_scenes_b', *U_KEY)} * (greatest(0, n_items - 2) - mid + 1)) AS BIGINT), n_items - 1]
      ELSE [CAST(floor({u('pick_scenes_a', *U_KEY)} * (greatest(0, n_items - 2) + 1)) AS BIGINT), greatest(0, n_items - 1)] END AS picks
    FROM (SELECT {KEYS}, max(tail) + 1 AS n_frames, count(*) AS n_items, (count(*) - 1) // 2 AS mid FROM fx_runs GROUP BY {KEYS})"""


@query("pick_scenes", using("fx_runs", f"SELECT DISTINCT {KEYS}, CAST(unnest(picks) AS BIGINT) AS pos FROM sc", sc=_SCENES))
def _pick_scenes(s, d):
    runs = A.action_runs(X.labels(s, d), block=X.block(s, d))
    counts = runs.groupBy(*KEY).agg((F.max("tail") + 1).alias("n_frames"), F.count(F.lit(1)).alias("n_items"))
    return D.pick_scenes(counts)


@query("mark_kept", using("fx_dialogue", """SELECT episode_id, frame_idx, CASE WHEN ks OR ko THEN action || ' @@' ELSE action END AS action,
    CASE WHEN ks THEN scene || ' @@' ELSE scene END AS scene, md5(CASE WHEN ko THEN object || ' @@' ELSE object END) AS object
    FROM (SELECT *, scene = 'user' AS ks, length(object) > 200 AS ko FROM fx_dialogue)"""))
def _mark_kept(s, d):
    t = X.dialogue(s, d)
    out = D.mark_kept(t, F.col("scene") == "user", F.length("object") > 200)
    return out.withColumn("object", F.md5("object"))


@query("trailing_window", using("fx_frames", f"""SELECT {ROW}, array_to_string(CASE WHEN frame_idx < 3 THEN firsts[1:4] ELSE latest END, ',') AS items FROM (
    SELECT *, list(event_id) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS latest,
      list(event_id) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS firsts FROM fx_frames)"""))
def _trailing_window(s, d):
    return D.trailing_window(X.frames(s, d), 4, block=X.block(s, d)).select(*KEY, IDX, F.array_join("items", ",").alias("items"))


@query("dedup_adjacent", using("fx_frames", f"""SELECT {ROW}, obj FROM (SELECT *, lag(obj) OVER w AS p FROM fx_frames
    WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)) WHERE p IS DISTINCT FROM obj"""))
def _dedup_adjacent(s, d):
    return D.dedup_adjacent(X.frames(s, d), col="obj", block=X.block(s, d)).select(*KEY, IDX, "obj")


def _say(c: str, on: str = "true") -> str:
    t = f"trim({c}, ' ')"
    return f"CASE WHEN {on} AND {t} <> '' THEN {t} || CASE WHEN ends_with({t}, '.') THEN ' ' ELSE '. ' END ELSE '' END"


def _describe(position: str, numbered: bool, kept: bool, obj: str = "object", scene: str = "scene") -> str:
    late = {"first": "false", "last": "true", "dynamic": "(coalesce(action, '') LIKE '%turn%')"}[position]
    ka, ks, ko = ("(ks OR ko)", "ks", "ko") if kept else ("true", "true", "true")
    num = "frame_idx || '. ' || " if numbered else ""
    return f"{num}{_say('action', f'NOT {late} AND {ka}')} || {_say(scene, ks)} || {_say(obj, ko)} || {_say('action', f'{late} AND {ka}')}"


_STYLES = [("first", False, False), ("last", True, False), ("dynamic", True, True)]


@query("frame_description", using("fx_dialogue", " UNION ALL ".join(
    f"SELECT episode_id, frame_idx, '{p}' AS style, {_describe(p, n, k)} AS description FROM k" for p, n, k in _STYLES),
    k="SELECT *, scene = 'user' AS ks, length(object) > 200 AS ko FROM fx_dialogue"))
def _frame_description(s, d):
    t = X.dialogue(s, d).withColumn("scene_kept", F.col("scene") == "user").withColumn("object_kept", F.length("object") > 200)
    return _union([D.frame_description(t, p, n, k).select("episode_id", IDX, F.lit(p).alias("style"), "description") for p, n, k in _STYLES])


@query("assemble", using("fx_dialogue", f"""SELECT episode_id, string_agg(x, chr(10) ORDER BY frame_idx) AS summary,
    replace(string_agg(x, chr(10) ORDER BY frame_idx), chr(10), ' ') AS instruction
    FROM (SELECT episode_id, frame_idx, {_describe('first', False, False)} AS x FROM fx_dialogue) GROUP BY 1"""))
def _assemble(s, d):
    return M.summarise(D.assemble(D.frame_description(X.dialogue(s, d)), ["episode_id"]))


@query("ablate", using("fx_dialogue", f"""SELECT episode_id, string_agg(x, chr(10) ORDER BY frame_idx) AS summary FROM (
    SELECT *, lag(x) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS p FROM (
      SELECT episode_id, frame_idx, {_describe('first', False, False)} AS x FROM (SELECT episode_id, frame_idx,
        CASE WHEN action IN ('enter', 'leave', 'pass') THEN 'move forward' ELSE action END AS action, scene, 'None' AS object FROM fx_dialogue)))
    WHERE p IS DISTINCT FROM x GROUP BY 1"""))
def _ablate(s, d):
    t = D.ablate(X.dialogue(s, d), obj=True, use_enter_leave=False)
    block = sequence_block(X.dialogue(s, d), ["episode_id"])
    return D.assemble(D.dedup_adjacent(D.frame_description(t), ["episode_id"], block=block), ["episode_id"])


@query("explode_entities", """SELECT conv_id, turn, frame_idx, row_number() OVER (PARTITION BY conv_id, turn ORDER BY frame_idx) - 1 AS pos, action, scene, object FROM (
    SELECT conv_id, turn, turn + 2 AS frame_idx, 'go' AS action, role AS scene, md5(text) AS object FROM conversations UNION ALL
    SELECT conv_id, turn, turn * 10 + 11, 'stop', upper(role), NULL FROM conversations)""")
def _explode_entities(s, d):
    low, high = (F.col("turn") + 2).cast("string"), (F.col("turn") * 10 + 11).cast("string")
    maps = {"actions_compact": ("go", "stop"), "scenes": (F.col("role"), F.upper("role")), "objects": (F.md5("text"), F.lit(None).cast("string"))}
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    # the later frame comes first in the stored map
    infos = X.table(s, d, "conversations").select("conv_id", "turn", *[F.create_map(high, lit(b), low, lit(a)).alias(n) for n, (a, b) in maps.items()])
    return D.explode_entities(infos, ["conv_id", "turn"])


_GEN = {
    **_aba("(1, 2, 3)", "fx_frames"), "sm": "SELECT source, split, episode_id, frame_idx, o AS action FROM aba", **_majority("sm"),
    "gl": "SELECT source, split, episode_id, frame_idx, CASE WHEN frame_idx = max(frame_idx) OVER (PARTITION BY episode_id) THEN 0 ELSE action END AS action FROM mj",
    "gi": "SELECT *, frame_idx - row_number() OVER (PARTITION BY episode_id, action ORDER BY frame_idx) AS island FROM gl",
    "gr": """SELECT source, split, episode_id, (min(frame_idx) + max(frame_idx)) // 2 AS frame_idx, CASE action WHEN 0 THEN 'stop' WHEN 1 THEN 'move forward'
        WHEN 2 THEN 'turn left' ELSE 'turn right' END AS action FROM gi GROUP BY source, split, episode_id, action, island""",
    "gs": f"SELECT {KEYS}, string_agg(action || '. ', chr(10) ORDER BY frame_idx) AS summary FROM gr GROUP BY {KEYS}",
}


@query("generate_instructions", using("fx_frames", f"SELECT {KEYS}, summary, replace(summary, chr(10), ' ') AS instruction FROM gs", **_GEN))
def _generate(s, d):
    return generate(X.frames(s, d), block=X.block(s, d))


@query("generate_resumed", using("fx_frames", f"SELECT {KEYS}, 'inst_x' AS inst_alias, '0' AS inst_id, summary, replace(summary, chr(10), ' ') AS instruction FROM gs", **_GEN))
def _generate_resumed(s, d):
    # two runs: the second finds half of its episodes done, and a third has nothing to do
    f, path = X.frames(s, d), shared_folder(s, "resumed")
    generate_missing(f.where(F.col("episode_id") % 2 == 0), path, "inst_x", block=X.block(s, d))
    generate_missing(f, path, "inst_x", block=X.block(s, d))
    return generate_missing(f, path, "inst_x", block=X.block(s, d)).select(*KEY, "inst_alias", "inst_id", "summary", "instruction")


@query("generate_files", using("fx_frames", f"""SELECT source, split, episode_id, inst_id, replace(summary, chr(10), ' ') AS text, summary
    FROM gs, (SELECT unnest(['0', '1']) AS inst_id)""", **_GEN))
def _generate_files(s, d):
    # episode folders of texts and documents; two runs: the second finds half of its episodes done
    f, root = X.frames(s, d), f"{shared_folder(s, 'outputs')}/synth"
    generate_files(f.where(F.col("episode_id") % 2 == 0), root, "inst_x", generate_num=2, block=X.block(s, d))
    texts = generate_files(f, root, "inst_x", generate_num=2, block=X.block(s, d)).select(*KEY, "inst_id", "text")
    infos = files.scan_infos(s, root, ["val_seen", "val_unseen"], "inst_x").select(*KEY, "inst_id", "summary")
    return texts.join(infos, [*KEY, "inst_id"]).withColumn("episode_id", F.col("episode_id").cast("bigint"))


def _lexicon_cte() -> str:
    rows = [f"('{a}', {i}, '{p}', {len(ps)})" for a, ps in ACTION_PHRASES.items() for i, p in enumerate(ps)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") l(action, i, phrase, n)"


def _diversify_sql(level: int) -> str:
    n, uu = "n", "u"
    pick = {
        1: "floor(u * least(n, greatest(1, CAST(round_even(lim * n + 0.5, 0) AS INT))))",
        2: "floor(u * n)",
        3: "least(floor(-ln(1 - u * (1 - exp(-(lim * 10 / n) * n))) / (lim * 10 / n)), n - 1)",
    }[level]
    return f"""SELECT {ROW}, {level} AS level, phrase AS action FROM (SELECT *, CAST({pick} AS INT) AS pick FROM draws) JOIN lex l USING (action, {n}) WHERE l.i = pick"""


@query("diversify_action", using("fx_labels", " UNION ALL ".join(_diversify_sql(lv) for lv in (1, 2, 3)), lex=_lexicon_cte(),
    draws=f"""SELECT {ROW}, a AS action, n, {u('diversify_action', *U_KEY, 'CAST(frame_idx AS VARCHAR)')} AS u, {u('diversify_limit', *U_KEY)} + 0.1 AS lim
      FROM (SELECT *, CASE action WHEN 0 THEN 'stop' WHEN 1 THEN 'move forward' WHEN 2 THEN 'turn left' ELSE 'turn right' END AS a FROM fx_labels)
      JOIN (SELECT DISTINCT action AS a, n FROM lex) USING (a)"""))
def _diversify_action(s, d):
    f = X.labels(s, d).select(*KEY, IDX, codec.action_phrase("action").alias("action"))
    return _union([SA.diversify_action(f, level=lv, offset=0.1).withColumn("level", F.lit(lv)) for lv in (1, 2, 3)])


@query("annotate", using("fx_frames", f"SELECT {ROW}, obj || ' of ' || action AS scene, CAST(NULL AS VARCHAR) AS object FROM fx_frames"))
def _annotate(s, d):
    M.register("scene", "label", lambda objs, acts: [f"{o} of {a}" for o, a in zip(objs, acts)])
    f = X.frames(s, d).select(*KEY, IDX, "obj", "action")
    out = M.annotate(M.annotate(f, "scene", "label", ["obj", "action"]), "object", "not registered", ["obj"])
    return out.select(*KEY, IDX, "scene", "object")
