"""Registry of checkable queries and shared SQL fragments for their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

VIEWS = {
    "fx_frames": """SELECT 'synth' AS source, CASE WHEN user_id % 2 = 0 THEN 'val_seen' ELSE 'val_unseen' END AS split,
        user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
        CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 1 END AS action, event_type AS obj, event_id, value
        FROM events""",
    "fx_labels": """SELECT source, split, episode_id, frame_idx,
        CASE WHEN frame_idx = max(frame_idx) OVER (PARTITION BY episode_id) THEN 0 ELSE action END AS action,
        obj, event_id, value FROM fx_frames""",
    "fx_runs": """SELECT source, split, episode_id, action, head, tail, tail - head + 1 AS length,
        CAST(floor((head + tail) / 2) AS BIGINT) AS middle FROM (
          SELECT source, split, episode_id, action, min(frame_idx) AS head, max(frame_idx) AS tail FROM (
            SELECT *, frame_idx - row_number() OVER (PARTITION BY episode_id, action ORDER BY frame_idx) AS island FROM fx_labels)
          GROUP BY source, split, episode_id, action, island)""",
    "fx_instructions": "SELECT lang AS inst_alias, source AS split, doc_id AS episode_id, text FROM documents",
    "fx_tokens": r"""SELECT inst_alias, episode_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS t FROM fx_instructions""",
    "fx_responses": """SELECT event_id AS task_id, CAST(floor(event_id / 3) AS BIGINT) AS info_id,
        CASE event_id % 3 WHEN 0 THEN 'Action' WHEN 1 THEN 'Scene' ELSE 'Object' END AS info_type,
        CASE event_type
          WHEN 'view' THEN concat('Score here: fine <', CAST(CAST(floor(value) % 13 AS INT) AS VARCHAR), '>')
          WHEN 'click' THEN concat('I give a score of ', CAST(CAST(floor(value) % 13 AS INT) AS VARCHAR), '.5')
          WHEN 'purchase' THEN concat('**', CAST(CAST(floor(value) % 13 AS INT) AS VARCHAR), ' out of 10**')
          WHEN 'signup' THEN concat('<', CAST(CAST(floor(value) % 13 AS INT) AS VARCHAR), '/30>')
          ELSE 'no verdict' END AS response FROM events""",
    "fx_pairs": """SELECT vec_id // 2 AS pair_id, min(CASE WHEN vec_id % 2 = 0 THEN label END) AS episode_id,
        any_value(embedding::DOUBLE[]) FILTER (vec_id % 2 = 0) AS v, any_value(embedding::DOUBLE[]) FILTER (vec_id % 2 = 1) AS t
        FROM embeddings GROUP BY 1""",
    "fx_manifest": """SELECT *, pos // 32 AS batch_id FROM (
        SELECT *, row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR)), pair_id) - 1 AS pos FROM fx_pairs)""",
    "fx_batch_pairs": """SELECT a.batch_id, a.pos AS q, b.pos AS d, a.episode_id = b.episode_id AS target,
        list_dot_product(a.v, b.t) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.t, b.t))) * exp(0.07) AS score
        FROM fx_manifest a JOIN fx_manifest b USING (batch_id)""",
    "fx_detections": """SELECT l_orderkey AS image_id, l_linenumber * 10000000 + l_partkey AS det_id,
        concat(l_returnflag, l_linestatus) AS label, l_tax * 12 AS score, l_quantity * 10 AS cx, l_discount * 4800 AS cy,
        500 AS w, 480 AS h FROM lineitem""",
    "fx_votes": """SELECT user_id AS rater, CAST(event_id % 5 AS INT) AS path, CAST(event_id % 2 AS INT) AS question,
        event_type AS system, ts FROM events""",
    "fx_dialogue": """SELECT conv_id AS episode_id, turn AS frame_idx,
        CASE turn % 3 WHEN 0 THEN 'move forward' WHEN 1 THEN 'turn left' ELSE 'enter' END AS action, role AS scene, text AS object
        FROM conversations""",
    "fx_videos": """SELECT o_orderkey AS video_id, CAST(floor(o_totalprice) % 400 + 5 AS BIGINT) AS vlen,
        CAST(o_custkey % 6 + 1 AS DOUBLE) AS fps FROM orders""",
    "fx_images": """SELECT o_orderkey AS image_id, CAST(floor(o_totalprice) % 1900 + 100 AS INT) AS w,
        CAST(floor(o_totalprice / 7) % 1100 + 100 AS INT) AS h FROM orders""",
    "fx_paths": """SELECT doc_id, concat('/data/', source, '/val/', doc_id, '/inst_', lang, '/', doc_id % 3, '.txt') AS path FROM documents""",
}
NEEDS = {
    "fx_labels": ["fx_frames"], "fx_runs": ["fx_frames", "fx_labels"], "fx_tokens": ["fx_instructions"],
    "fx_manifest": ["fx_pairs"], "fx_batch_pairs": ["fx_pairs", "fx_manifest"],
}


def using(views: str, body: str, **ctes: str) -> str:
    """`WITH` the named views (and what they need), then extra CTEs, then the body."""
    names: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({s})" for n, s in ctes.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def u(salt: str, *cols: str, seed: int = 42) -> str:
    """SQL of `hash_uniform`."""
    args = ", ".join(["'%d'" % seed, *cols, f"'{salt}'"])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {args})), 1, 8)) AS UBIGINT) / CAST(4294967296 AS DOUBLE))"


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison between engines; adding 0 turns -0 into 0."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, digits) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep
