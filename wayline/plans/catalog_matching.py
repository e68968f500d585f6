"""Checkable queries: joins, retrieval, judging, votes, images and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions.text import extract_score
from wayline.functions.vectors import l2_normalise
from wayline.operators import consistency as C
from wayline.operators import frames as FR
from wayline.operators import joins as J
from wayline.operators import ranking as RK
from wayline.operators import retrieval as R
from wayline.operators import survey as SV
from wayline.operators.ordered import shared_folder
from wayline.plans import fixtures as X
from wayline.plans.catalog_base import query, r6, u, using
from wayline.sources import files as S
from wayline.streaming import live

SYSTEMS = ["view", "click", "purchase", "signup", "error"]


@query("skip_existing", """WITH txt AS (SELECT DISTINCT user_id, event_id % 2 AS i FROM events WHERE value > 150),
    info AS (SELECT DISTINCT user_id, event_id % 2 AS i FROM events WHERE value < 0.5)
    SELECT DISTINCT user_id AS episode_id, i AS inst_id, k AS kind FROM (SELECT user_id, unnest([0, 1]) AS i FROM events) w, (SELECT unnest(['both', 'txt']) AS k)
    WHERE NOT EXISTS (SELECT 1 FROM txt t WHERE t.user_id = w.user_id AND t.i = w.i
      AND (k = 'txt' OR EXISTS (SELECT 1 FROM info x WHERE x.user_id = w.user_id AND x.i = w.i)))""")
def _skip_existing(s, d):
    e = X.table(s, d, "events").select(F.col("user_id").alias("episode_id"), (F.col("event_id") % 2).cast("int").alias("inst_id"), "value")
    on = ["episode_id", "inst_id"]
    work = e.select("episode_id").distinct().withColumn("inst_id", F.explode(F.array(F.lit(0), F.lit(1))))
    txt, info = e.where("value > 150").select(*on), e.where("value < 0.5").select(*on)
    return J.skip_existing(work, txt, info, on).withColumn("kind", F.lit("both")).unionByName(
        J.skip_existing(work, txt, None, on).withColumn("kind", F.lit("txt")))


@query("episode_manifest", using("fx_instructions", """SELECT inst_alias, episode_id, pos, pos // 32 AS batch_id FROM (
    SELECT *, row_number() OVER (ORDER BY md5(concat_ws('@', inst_alias, episode_id)), inst_alias, episode_id) - 1 AS pos FROM fx_instructions)"""))
def _episode_manifest(s, d):
    return J.episode_manifest(X.instructions(s, d).select("inst_alias", "episode_id"), ["inst_alias", "episode_id"])


@query("union_splits", using("fx_frames", "SELECT split, count(*) AS frames FROM fx_frames GROUP BY 1"))
def _union_splits(s, d):
    f = X.frames(s, d)
    return J.union_splits([f.where(F.col("split") == v) for v in ("val_seen", "val_unseen")]).groupBy("split").agg(F.count(F.lit(1)).alias("frames"))


@query("resume", using("fx_responses", """SELECT info_id AS info_key, 'cached' AS state, max(length(response)) AS score FROM fx_responses WHERE response LIKE '%5' GROUP BY 1
    UNION ALL SELECT DISTINCT info_id, 'todo', CAST(NULL AS BIGINT) FROM fx_responses WHERE info_id NOT IN (SELECT info_id FROM fx_responses WHERE response LIKE '%5')"""))
def _resume(s, d):
    r = X.responses(s, d)
    cache = r.where(F.col("response").endswith("5")).groupBy(F.col("info_id").alias("info_key")).agg(F.max(F.length("response")).cast("long").alias("score"))
    done, todo = J.resume(r.select(F.col("info_id").alias("info_key")).distinct(), cache)
    return done.withColumn("state", F.lit("cached")).unionByName(todo.withColumn("state", F.lit("todo")), allowMissingColumns=True)


@query("attach_instructions", using("fx_instructions", """SELECT path, system, CASE WHEN n IS NULL THEN '(Model instruction missing)' ELSE coalesce(md5(t), '(No instruction available)') END AS text
    FROM (SELECT DISTINCT split AS path FROM fx_instructions), (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS system)
    LEFT JOIN (SELECT split, inst_alias, count(*) AS n, min(text) FILTER (inst_alias <> 'es') AS t FROM fx_instructions GROUP BY 1, 2)
      ON split = path AND inst_alias = system"""))
def _attach_instructions(s, d):
    t = X.instructions(s, d).select(F.col("split").alias("path"), F.col("inst_alias").alias("system"), "text")
    # one system has its folders, but no text
    texts = t.where(F.col("system") != "es").groupBy("path", "system").agg(F.md5(F.min("text")).alias("text"))
    return J.attach_instructions(t.select("path").distinct(), ["de", "en", "es", "fr", "it"], t.select("path", "system").distinct(), texts)


def _manifest(s, d):
    return J.episode_manifest(X.feature_pairs(s, d), ["pair_id"])


@query("batch_pairs", using("fx_batch_pairs", "SELECT batch_id, q, d, round(score, 6) + 0.0 AS score, target FROM fx_batch_pairs"))
def _batch_pairs(s, d):
    return R.batch_pairs(_manifest(s, d)).select("batch_id", "q", "d", r6("score"), "target")


@query("similarity", using("fx_pairs", """SELECT pair_id, round(list_dot_product(v, t) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(t, t))) * exp(0.07), 6) + 0.0 AS cosine,
    round(list_dot_product(v, t) * exp(0.07), 6) + 0.0 AS dot, round(-list_sum(list_transform(list_zip(v, t), lambda p: power(p[1] - p[2], 2))) / len(v), 6) + 0.0 AS mse FROM fx_pairs"""))
def _similarity(s, d):
    return X.feature_pairs(s, d).select("pair_id", *[r6(R.similarity("v", "t", k), k) for k in ("cosine", "dot", "mse")])


@query("l2_normalise", """SELECT vec_id, i, round(e[i] / sqrt(list_dot_product(e, e)), 6) + 0.0 AS x FROM (
    SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def _l2_normalise(s, d):
    e = X.table(s, d, "embeddings").select("vec_id", l2_normalise("embedding").alias("e"))
    return e.select("vec_id", F.posexplode("e").alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), r6("x"))


@query("masked_mean_pool", """SELECT label AS episode_id, i, round(sum(x * m) / greatest(sum(m), 1e-9), 6) + 0.0 AS x FROM (
    SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i, (vec_id % 3 > 0)::INT::DOUBLE AS m FROM embeddings) GROUP BY 1, 2""")
def _masked_mean_pool(s, d):
    e = X.table(s, d, "embeddings").select(F.col("label").alias("episode_id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 3 > 0).cast("int").alias("mask"))
    out = R.masked_mean_pool(e, ["episode_id"])
    return out.select("episode_id", F.posexplode("vec").alias("i", "x")).select("episode_id", (F.col("i") + 1).cast("long").alias("i"), r6("x"))


@query("contrastive_loss", using("fx_batch_pairs", """SELECT batch_id, round((a + b) / 2, 6) AS loss FROM (
    SELECT batch_id, avg(ln(e) - s) AS a FROM (SELECT batch_id, q, sum(exp(score)) AS e, max(score) FILTER (q = d) AS s FROM fx_batch_pairs GROUP BY 1, 2) GROUP BY 1)
    JOIN (SELECT batch_id, avg(ln(e) - s) AS b FROM (SELECT batch_id, d, sum(exp(score)) AS e, max(score) FILTER (q = d) AS s FROM fx_batch_pairs GROUP BY 1, 2) GROUP BY 1) USING (batch_id)"""))
def _contrastive_loss(s, d):
    return R.contrastive_loss(R.batch_pairs(_manifest(s, d))).select("batch_id", r6("loss"))


def _metric_sql(source: str, group: str) -> dict[str, str]:
    by = f"{group}, " if group else ""
    return {
        "rk": f"""SELECT {by}q, score, target, row_number() OVER o AS rank, sum(target::INT) OVER (PARTITION BY {by}q) AS total,
            sum(target::INT) OVER (PARTITION BY {by}q ORDER BY score DESC, d ROWS UNBOUNDED PRECEDING) AS cum FROM {source} WINDOW o AS (PARTITION BY {by}q ORDER BY score DESC, d)""",
        "au": f"""SELECT {by}a.q, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auroc
            FROM rk a JOIN rk b ON {f'a.{group} = b.{group} AND ' if group else ''} a.q = b.q AND a.target AND NOT b.target AND a.rank <= 3 AND b.rank <= 3 GROUP BY ALL""".replace("SELECT batch_id, a.q", "SELECT a.batch_id, a.q"),
        "pq": f"""SELECT {by}q, any_value(total) AS r, count(*) FILTER (target AND rank <= 3) AS h, min(rank) FILTER (target AND rank <= 3) AS first,
            sum(cum / rank::DOUBLE) FILTER (target AND rank <= 3) AS ap, sum(1 / log2(rank + 1)) FILTER (target AND rank <= 3) AS gain,
            count(*) FILTER (target AND rank <= total) AS hr FROM rk GROUP BY ALL""",
        "mt": f"""SELECT {by}pq.q, CASE WHEN r > 0 THEN h / r::DOUBLE ELSE 0 END AS v2t_recall_3, h / 3.0::DOUBLE AS v2t_precision_3, least(h, 1)::DOUBLE AS v2t_hitrate_3,
            CASE WHEN h > 0 THEN ap / h ELSE 0 END AS v2t_map_3, coalesce(1.0::DOUBLE / first, 0) AS v2t_mrr_3,
            CASE WHEN r > 0 THEN coalesce(gain, 0) / (1 + CASE WHEN r >= 2 THEN 1 / log2(3) ELSE 0 END + CASE WHEN r >= 3 THEN 0.5 ELSE 0 END) ELSE 0 END AS v2t_ndcg_3,
            coalesce(auroc::DOUBLE, 0) AS v2t_auroc_3, CASE WHEN r > 0 THEN hr / r::DOUBLE ELSE 0 END AS v2t_rprecision FROM pq LEFT JOIN au USING ({by}q)""".replace("batch_id, pq.q", "batch_id, pq.q"),
    }


_NAMES = [f"v2t_{m}_3" for m in R.METRICS] + ["v2t_rprecision"]
_AVG = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _NAMES) + ", round(avg(v2t_rprecision), 6) AS v2t_similarity"


@query("retrieval_metrics", using("fx_batch_pairs", f"SELECT batch_id, {_AVG} FROM mt GROUP BY 1", **_metric_sql("fx_batch_pairs", "batch_id")))
def _retrieval_metrics(s, d):
    out = R.retrieval_metrics(R.batch_pairs(_manifest(s, d)))
    return out.select("batch_id", *[r6(c) for c in R.metric_columns(3, "v2t_")])


@query("batch_reduce", using("fx_batch_pairs", f"SELECT {_AVG} FROM (SELECT batch_id, {', '.join(f'avg({c}) AS {c}' for c in _NAMES)} FROM mt GROUP BY 1)",
                             **_metric_sql("fx_batch_pairs", "batch_id")))
def _batch_reduce(s, d):
    out = R.batch_reduce(R.retrieval_metrics(R.batch_pairs(_manifest(s, d))))
    return out.select(*[r6(c) for c in out.columns])


_ALL = {"ap": """SELECT a.pos AS q, b.pos AS d, a.pair_id = b.pair_id AS target, list_dot_product(a.v, b.t) * exp(0.07) AS score FROM fx_manifest a, fx_manifest b"""}


@query("all_pairs", using("fx_manifest", """SELECT q AS pos, round(max(score) FILTER (target), 6) + 0.0 AS own, max(rank) FILTER (target) AS rank, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM ap) GROUP BY 1""", **_ALL))
def _all_pairs(s, d):
    return R.matched_rank(X.feature_pairs(s, d), ["pair_id"]).select("pos", r6("own"), "rank", "n")


@query("full_metrics", using("fx_manifest", f"SELECT {_AVG} FROM mt", **_ALL, **_metric_sql("ap", "")))
def _full_metrics(s, d):
    out = R.full_metrics(X.feature_pairs(s, d), ["pair_id"])
    return out.select(*[r6(c) for c in out.columns])


@query("matched_similarity", using("fx_batch_pairs", "SELECT round((avg(score) FILTER (target) + 1.7) / 3.4, 6) AS similarity FROM fx_batch_pairs"))
def _matched_similarity(s, d):
    return R.matched_similarity(R.batch_pairs(_manifest(s, d))).select(r6("similarity"))


@query("pad_and_mask", """SELECT conv_id, turn, i, coalesce(xs[i], 0) AS x, coalesce(xs[i], 0) <> 0 AS mask FROM (SELECT conv_id, turn, xs, unnest(range(1, n + 1)) AS i FROM (
    SELECT conv_id, turn, xs, max(len(xs)) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, turn,
    list_transform(string_split(text, ' '), lambda w: CASE WHEN contains(w, 'e') THEN 0 ELSE length(w) END) AS xs FROM conversations)))""")
def _pad_and_mask(s, d):
    words = F.transform(F.split("text", " "), lambda w: F.array(F.when(w.contains("e"), 0).otherwise(F.length(w)).cast("long")))
    lists = X.table(s, d, "conversations").select("conv_id", "turn", words.alias("values"))
    out = R.pad_and_mask(lists, ["conv_id"])
    rows = out.select("conv_id", "turn", F.posexplode(F.arrays_zip("padded", "mask")).alias("i", "z"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("i"), F.col("z.padded")[0].alias("x"), F.col("z.mask").alias("mask"))


@query("classification_report", using("fx_labels", """SELECT sum(n)::BIGINT AS rows, round(sum(n) FILTER (p = t) / sum(n)::DOUBLE, 6) AS accuracy, round(sum(n) FILTER (p = t) / sum(n)::DOUBLE, 6) AS f1_micro,
    (SELECT round(avg(2 * tp / (np + nt)::DOUBLE), 6) FROM (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE p = c AND t = c), 0) AS tp, coalesce((SELECT sum(n) FROM cm WHERE p = c), 0) AS np,
      coalesce((SELECT sum(n) FROM cm WHERE t = c), 0) AS nt FROM (SELECT unnest([0, 1, 2, 3]) AS c)) WHERE np + nt > 0) AS f1_macro FROM cm""",
    cm="SELECT CASE WHEN value < 20 THEN 1 WHEN value < 40 THEN 2 ELSE 3 END AS p, action AS t, count(*) AS n FROM fx_labels GROUP BY 1, 2"))
def _classification_report(s, d):
    f = X.labels(s, d).withColumn("pred", F.when(F.col("value") < 20, 1).when(F.col("value") < 40, 2).otherwise(3)).withColumn("truth", F.col("action"))
    return R.classification_report(f).select("rows", r6("accuracy"), r6("f1_micro"), r6("f1_macro"))


_SCORED = r"""SELECT info_id, info_type, CASE WHEN x > 10 THEN 5.0 ELSE coalesce(x, 5.0) END::DOUBLE AS score FROM (SELECT info_id, info_type, TRY_CAST(coalesce(
    list_extract(regexp_extract_all(t, '<(\d+\.?\d*?)>', 1), -1), list_extract(regexp_extract_all(t, '(\d+\.?\d*?) out of 10', 1), -1),
    list_extract(regexp_extract_all(t, '<(\d+\.?\d*?)', 1), -1), list_extract(regexp_extract_all(t, 'a score of (\d+\.?\d*?)', 1), -1)) AS DOUBLE) AS x
    FROM (SELECT *, regexp_replace(replace(response, '*', ''), '^[^\n:]*:', '') AS t FROM fx_responses))"""
_WHOLE = "SELECT info_id FROM fx_responses GROUP BY 1 HAVING count(*) = 3"


@query("consistency_scores", using("fx_responses", """SELECT round(avg(score) FILTER (info_type = 'Scene'), 6) AS scene, round(avg(score) FILTER (info_type = 'Object'), 6) AS object,
    round(avg(score) FILTER (info_type = 'Action'), 6) AS action, round(avg(score), 6) AS average,
    (SELECT count(*) FROM (SELECT info_id FROM fx_responses GROUP BY 1 HAVING count(*) <> 3)) AS rejected FROM sc WHERE info_id IN (SELECT info_id FROM wh)""", sc=_SCORED, wh=_WHOLE))
def _consistency_scores(s, d):
    r = X.responses(s, d)
    sizes = r.groupBy("info_id").count()
    whole = sizes.where("count = 3").select("info_id")
    scored = r.join(whole, "info_id").select(F.col("info_id").alias("info_key"), "info_type", extract_score("response").alias("score"))
    out = C.consistency_scores(scored)
    rejected = sizes.where("count <> 3").agg(F.count(F.lit(1))).scalar()
    return out.select(*[r6(c) for c in out.columns], rejected.alias("rejected"))


_CELLS = {
    "cell": "SELECT rater, path, question, count(DISTINCT system) AS k FROM fx_votes GROUP BY 1, 2, 3",
    "ok": f"SELECT rater FROM cell GROUP BY 1 HAVING count(DISTINCT path) = 5 AND count(*) = 10 AND max(k) < {len(SYSTEMS)}",
    "tick": "SELECT DISTINCT rater, path, question, system FROM fx_votes WHERE rater IN (SELECT rater FROM ok)",
}


@query("vote_tally", using("fx_votes", """SELECT question, system, count(*) AS votes, round(count(*) / any_value(n)::DOUBLE, 6) AS share FROM tick
    JOIN (SELECT question, count(DISTINCT (rater, path)) AS n FROM tick GROUP BY 1) USING (question) GROUP BY 1, 2""", **_CELLS))
def _vote_tally(s, d):
    out = SV.vote_tally(X.votes(s, d), len(SYSTEMS))
    return out.select("question", "system", "votes", r6("share"))


def _draws(n: int) -> dict[str, str]:
    cte = {"it": "SELECT item_id, row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) - 1 AS pos, count(*) OVER () AS total FROM benchmark",
           "d0": "SELECT DISTINCT user_id AS rater, (SELECT count(*) FROM benchmark) AS total, []::BIGINT[] AS taken FROM events"}
    for j in range(n):
        t = f"CAST(floor({u('survey_item', 'CAST(rater AS VARCHAR)', repr(str(j)))} * (total - {n} + {j} + 1)) AS BIGINT)"
        cte[f"d{j + 1}"] = f"SELECT rater, total, list_append(taken, CASE WHEN list_contains(taken, {t}) THEN total - {n} + {j} ELSE {t} END) AS taken FROM d{j}"
    return cte


@query("survey_order", using("", f"""SELECT rater, CAST(item_rank AS INT) AS item_rank, path, CAST(row_number() OVER (PARTITION BY rater, path ORDER BY {u('survey_system', 'CAST(rater AS VARCHAR)', 'CAST(path AS VARCHAR)', 'system')}, system) - 1 AS INT) AS system_rank,
    system FROM (SELECT rater, row_number() OVER (PARTITION BY rater ORDER BY {u('survey_order', 'CAST(rater AS VARCHAR)', 'CAST(pos AS VARCHAR)')}, pos) - 1 AS item_rank, pos FROM (SELECT rater, unnest(taken) AS pos FROM d5))
    JOIN (SELECT item_id AS path, pos FROM it) USING (pos), (SELECT DISTINCT event_type AS system FROM events)""", **_draws(5)))
def _survey_order(s, d):
    systems = F.explode(F.array(*[F.lit(x) for x in SYSTEMS]))
    items = X.table(s, d, "benchmark").select(F.col("item_id").alias("path"), systems.alias("system"))
    raters = X.table(s, d, "events").select(F.col("user_id").alias("rater")).distinct()
    return SV.survey_order(items, raters)


_CELL = """(['far left side', 'far front', 'far right side', 'left side', 'front', 'right side', 'left side and very close', 'very close', 'right side and very close'])[
    least(greatest(floor(floor(cy) / (h // 3)), 0), 2)::INT * 3 + least(greatest(floor(floor(cx) / (w // 3)), 0), 2)::INT + 1]"""


@query("grid_position", using("fx_detections", f"SELECT image_id, det_id, {_CELL} AS position FROM fx_detections"))
def _grid_position(s, d):
    t = X.detections(s, d)
    return t.select("image_id", "det_id", RK.grid_position(F.col("w"), F.col("h"), F.floor("cx"), F.floor("cy")).alias("position"))


@query("top_objects", using("fx_detections", f"""SELECT o_orderkey AS image_id, coalesce(objects, 'No object.') AS objects FROM orders LEFT JOIN (
    SELECT image_id, string_agg(label || ': ' || {_CELL} || '. ', '' ORDER BY r) AS objects FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r
    FROM fx_detections WHERE score > 0.5) WHERE r <= 3 GROUP BY 1) ON image_id = o_orderkey"""))
def _top_objects(s, d):
    return RK.top_objects(X.detections(s, d), X.table(s, d, "orders").select(F.col("o_orderkey").alias("image_id")))


@query("top_classes", """SELECT vec_id AS item_id, string_agg(n_name, ', ' ORDER BY r) AS classes FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM (
    SELECT vec_id, unnest(embedding[1:25]) AS x, generate_subscripts(embedding[1:25], 1) - 1 AS i FROM embeddings)) JOIN nation ON n_nationkey = i WHERE r <= 5 GROUP BY 1""")
def _top_classes(s, d):
    e = X.table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    names = X.table(s, d, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name"))
    return RK.top_classes(e, names, 5, 25)


@query("resize_dims", using("fx_images", """SELECT image_id, CASE WHEN w < h THEN 224 ELSE CAST(floor(w * 224 / h) AS INT) END AS w,
    CASE WHEN w < h THEN CAST(floor(h * 224 / w) AS INT) ELSE 224 END AS h FROM fx_images"""))
def _resize_dims(s, d):
    w, h = FR.resize_dims("w", "h", 224)
    return X.images(s, d).select("image_id", w.alias("w"), h.alias("h"))


_TILES = {
    "gr": "SELECT c, r, row_number() OVER (ORDER BY c * r, c) AS n FROM (SELECT unnest(range(1, 13)) AS c), (SELECT unnest(range(1, 13)) AS r) WHERE c * r <= 12",
    "df": "SELECT image_id, w, h, c, r, n, abs(w / h::DOUBLE - c / r::DOUBLE) AS gap, min(abs(w / h::DOUBLE - c / r::DOUBLE)) OVER (PARTITION BY image_id) AS best FROM fx_images, gr",
    "cd": "SELECT *, min(n) OVER (PARTITION BY image_id) AS n0 FROM df WHERE gap = best",
    "ch": """SELECT image_id, CAST(arg_max(c, CASE WHEN n = n0 THEN 0 WHEN w::DOUBLE * h > 0.5 * 448 * 448 * c * r THEN n ELSE -1 END) AS INT) AS cols,
        CAST(arg_max(r, CASE WHEN n = n0 THEN 0 WHEN w::DOUBLE * h > 0.5 * 448 * 448 * c * r THEN n ELSE -1 END) AS INT) AS rows FROM cd GROUP BY 1""",
    "tl": "SELECT *, CAST(unnest(range(0, cols * rows + CASE WHEN cols * rows > 1 THEN 1 ELSE 0 END)) AS INT) AS tile FROM ch",
}


@query("tile_plan", using("fx_images", """SELECT image_id, cols, rows, tile, CASE WHEN tile = cols * rows THEN 0 ELSE tile % cols * 448 END AS x0, CASE WHEN tile = cols * rows THEN 0 ELSE tile // cols * 448 END AS y0,
    CASE WHEN tile = cols * rows THEN 448 ELSE (tile % cols + 1) * 448 END AS x1, CASE WHEN tile = cols * rows THEN 448 ELSE (tile // cols + 1) * 448 END AS y1, tile = cols * rows AS is_thumbnail FROM tl""", **_TILES))
def _tile_plan(s, d):
    return FR.tile_plan(X.images(s, d), thumbnail=True)


_EDGE = "CAST(CASE WHEN {0} = acc THEN vlen ELSE floor({0} * (vlen / acc::DOUBLE)) END AS BIGINT)"
_SLOT = f"SELECT *, {_EDGE.format('slot')} AS lo, {_EDGE.format('(slot + 1)')} - 1 AS hi FROM (SELECT *, least(pos, acc - 1) AS slot FROM (SELECT *, unnest(range(0, want)) AS pos FROM w))"
_DYN = "greatest(1, CAST(floor(vlen / fps / 8) AS BIGINT)) * 8"


def _sampled(want: str, low: str) -> dict[str, str]:
    return {"w": f"SELECT video_id, vlen, fps, greatest({low}, {want}) AS want, least(greatest({low}, {want}), vlen) AS acc FROM fx_videos", "sl": _SLOT}


@query("sample_frames_middle", using("fx_videos", "SELECT video_id, pos, CAST(floor((lo + hi) / 2) AS BIGINT) AS frame FROM sl", **_sampled("8", "1")))
def _sample_middle(s, d):
    return FR.sample_frames(X.videos(s, d), "middle", 8)


@query("sample_frames_start", using("fx_videos", "SELECT video_id, pos, lo + 1 AS frame FROM sl", **_sampled("6", "least(16, vlen)")))
def _sample_start(s, d):
    return FR.sample_frames(X.videos(s, d), "middle", 6, fix_start=1, min_frames=16)


@query("sample_frames_dynamic", using("fx_videos", "SELECT video_id, pos, CAST(floor((lo + hi) / 2) AS BIGINT) AS frame FROM sl",
                                      **_sampled(f"least({_DYN}, 64)", "CASE WHEN 16 > vlen THEN vlen // 8 * 8 ELSE 16 END")))
def _sample_dynamic(s, d):
    return FR.sample_frames(X.videos(s, d), "dynamic_fps1", min_frames=16, max_frames=64)


@query("sample_frames_rate", using("fx_videos", """SELECT video_id, pos, frame FROM (SELECT video_id, vlen, pos, CAST(round_even((1.0::DOUBLE + pos * 2.0) * fps, 0) AS BIGINT) AS frame
    FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((vlen / fps) / 2.0) AS BIGINT)))) AS pos FROM fx_videos)) WHERE frame < vlen AND pos < 50"""))
def _sample_rate(s, d):
    return FR.sample_frames(X.videos(s, d), "fps0.5", max_frames=50)


@query("sample_frames_segments", using("fx_videos", """SELECT video_id, pos, CAST(trunc(s + st / 2 + round_even(st * pos, 0)) AS BIGINT) AS frame FROM (SELECT *, (e - s) / 16.0::DOUBLE AS st, unnest(range(0, 16))::INT AS pos FROM (
    SELECT video_id, greatest(0, CAST(round_even(1.0::DOUBLE * fps, 0) AS BIGINT)) AS s, least(CAST(round_even(30.0::DOUBLE * fps, 0) AS BIGINT), vlen - 1) AS e FROM fx_videos))"""))
def _sample_segments(s, d):
    return FR.sample_segments(X.videos(s, d), segments=16, bound=(1.0, 30.0))


@query("sample_frames_rand", using("fx_videos", f"""SELECT video_id, pos, coalesce(drawn[slot + 1], CAST(lo + floor({u('sample_frames', 'CAST(video_id AS VARCHAR)', 'CAST(slot AS VARCHAR)')} * (hi - lo)) AS BIGINT)) AS frame FROM (
    SELECT *, CAST(floor(slot * (n / acc)) AS BIGINT) AS lo, CASE WHEN slot + 1 = acc THEN n ELSE CAST(floor((slot + 1) * (n / acc)) AS BIGINT) END - 1 AS hi FROM (
      SELECT *, least(pos, acc - 1) AS slot FROM (SELECT *, unnest(range(0, 8)) AS pos FROM v))) LEFT JOIN tight USING (video_id)""",
    v="SELECT video_id, vlen AS n, least(8, vlen) AS acc FROM fx_videos",
    tight=f"""SELECT video_id, list(i ORDER BY i) AS drawn FROM (SELECT video_id, acc, i, row_number() OVER (PARTITION BY video_id
      ORDER BY {u('sample_frames_tight', 'CAST(video_id AS VARCHAR)', 'CAST(i AS VARCHAR)')}, i) AS r FROM (SELECT *, unnest(range(0, n)) AS i FROM v WHERE n // acc < 2)) WHERE r <= acc GROUP BY 1"""))
def _sample_rand(s, d):
    return FR.sample_frames(X.videos(s, d), "rand", 8)


@query("stream_actions", using("fx_frames", """SELECT episode_id, frame_idx, obj AS item,
    lag(obj) OVER (PARTITION BY episode_id ORDER BY frame_idx) || ' to ' || obj AS action FROM fx_frames"""))
def _stream_actions(s, d):
    where = shared_folder(s, "stream")
    # the frames arrive shuffled, in files that are read one or two at a time
    rows = X.frames(s, d).select("episode_id", "frame_idx", F.col("obj").alias("item"))
    rows.repartition(6, F.xxhash64("episode_id", "frame_idx")).sortWithinPartitions(F.xxhash64("frame_idx", "item")).write.parquet(f"{where}/frames")
    frames = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/frames")
    out = live.stream_actions(frames, lambda a, b: [f"{x} to {y}" for x, y in zip(a, b)], ["episode_id"])
    with live.keyed_state(s):
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/rows")
        q.awaitTermination()
    return s.read.schema(out.schema).parquet(f"{where}/rows")


@query("stream_votes", """SELECT CAST(event_id % 2 AS VARCHAR) AS question, event_type AS system, count(*) AS votes FROM events GROUP BY 1, 2""")
def _stream_votes(s, d):
    schema = X.table(s, d, "events").schema
    e = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    answer = F.create_map((F.col("event_id") % 2).cast("string"), F.array("event_type"))
    subs = e.select(F.col("user_id").cast("string").alias("userId"), F.col("ts").alias("submissionTime"),
                    F.create_map((F.col("event_id") % 5).cast("string"), answer).alias("answers"))
    where = shared_folder(s, "stream")

    def keep(df, batch):
        df.write.mode("overwrite").parquet(f"{where}/rows")

    q = live.stream_votes(subs).writeStream.outputMode("complete").option("checkpointLocation", f"{where}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("question string, system string, votes bigint").parquet(f"{where}/rows")


# a submission for each event; some tick nothing, some all; a rater counts with two paths of two questions, each with one to four systems
@query("stream_tally", using("", """SELECT question, system, count(*) AS votes, round(count(*) / any_value(n)::DOUBLE, 6) AS share FROM tick
    JOIN (SELECT question, count(DISTINCT (rater, path)) AS n FROM tick GROUP BY 1) USING (question) GROUP BY question, system""",
    sub="""SELECT concat(user_id, '-', event_id % 8) AS rater, CAST((event_id // 8) % 2 AS VARCHAR) AS path, CAST((event_id // 16) % 2 AS VARCHAR) AS question,
        CASE event_id % 11 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['view', 'click', 'purchase', 'signup', 'error'] ELSE [event_type] END AS ticks FROM events""",
    cell="SELECT rater, path, question, len(list_distinct(flatten(list(ticks)))) AS d FROM sub GROUP BY ALL",
    ok="SELECT rater FROM cell GROUP BY 1 HAVING count(DISTINCT path) = 2 AND count(*) = 4 AND min(d) > 0 AND max(d) < 5",
    tick="SELECT DISTINCT rater, path, question, unnest(ticks) AS system FROM sub WHERE rater IN (SELECT rater FROM ok)"))
def _stream_tally(s, d):
    e, n = X.table(s, d, "events"), F.col("event_id")
    ticks = F.when(n % 11 == 0, F.array().cast("array<string>")).when(n % 11 == 1, F.array(*[F.lit(x) for x in SYSTEMS])).otherwise(F.array("event_type"))
    subs = e.select(
        F.concat_ws("-", "user_id", n % 8).alias("userId"), F.col("ts").cast("timestamp").alias("submissionTime"), F.struct(F.lit(True).alias("allowMultipleChoices")).alias("config"),
        F.create_map((F.floor(n / 8) % 2).cast("string"), F.create_map((F.floor(n / 16) % 2).cast("string"), ticks)).alias("answers"))
    where = shared_folder(s, "tally")
    # the log grows twice; the second call takes up what the first left
    for part in (0, 1):
        subs.where(n % 2 == part).write.mode("append").json(f"{where}/log")
        live.follow_votes(S.scan_submissions(s, f"{where}/log", True), where, len(SYSTEMS), 2, 2)
    return live.current_tally(s, where).select("question", "system", "votes", r6("share"))
