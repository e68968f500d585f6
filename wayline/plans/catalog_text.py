"""Checkable queries: text functions, corpora and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import text as T
from wayline.operators import consistency as C
from wayline.operators import diversity as DV
from wayline.operators import joins as J
from wayline.operators import models as M
from wayline.operators import sampling as SA
from wayline.operators.ordered import running_offsets
from wayline.plans import fixtures as X
from wayline.plans.catalog_base import ORACLE, VIEWS, query, r6, u, using
from wayline.sources import files as S

TOK = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


@query("episode_key", using("fx_paths", r"""SELECT doc_id, p[-5] AS source, p[-4] AS split, p[-3] AS episode_id, p[-2] AS inst_alias,
    regexp_replace(p[-1], '(.)\.[^.]*$', '\1') AS inst_id FROM (SELECT doc_id, string_split(path, '/') AS p FROM fx_paths)"""))
def _episode_key(s, d):
    path = F.concat(F.lit("/data/"), "source", F.lit("/val/"), "doc_id", F.lit("/inst_"), "lang", F.lit("/"), (F.col("doc_id") % 3), F.lit(".txt"))
    rows = X.table(s, d, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", *[c.alias(n) for n, c in T.episode_key("path").items()])


@query("swap_alias", using("fx_paths", r"SELECT doc_id, regexp_replace(path, '[^/]+/([^/]+)$', 'inst_new/\1') AS path FROM fx_paths"))
def _swap_alias(s, d):
    path = F.concat(F.lit("/data/"), "source", F.lit("/val/"), "doc_id", F.lit("/inst_"), "lang", F.lit("/"), (F.col("doc_id") % 3), F.lit(".txt"))
    return X.table(s, d, "documents").select("doc_id", T.swap_alias(path, "inst_new").alias("path"))


@query("join_values", """SELECT conv_id, turn, CASE WHEN text LIKE '%z%' THEN '' ELSE
    trim(lower(role), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') || '; ' || trim(lower(text), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') END AS joined
    FROM conversations""")
def _join_values(s, d):
    t = X.table(s, d, "conversations")
    values = F.array("role", F.when(~F.col("text").contains("z"), F.col("text")))
    return t.select("conv_id", "turn", T.join_values(values).alias("joined"))


def _prompt_sql(name: str) -> str:
    inst = "replace(text, chr(10), ' ')" if name == "llama" else "text"
    body = T.PROMPTS[name].replace("'", "''")
    return f"""SELECT conv_id, turn, '{name}' AS template, replace(replace(replace('{body}', '{{type}}', lower('Scene')), '{{info}}', role),
        '{{instruction}}', {inst}) AS prompt FROM conversations"""


@query("build_prompt", " UNION ALL ".join(_prompt_sql(n) for n in T.PROMPTS) + """ UNION ALL SELECT conv_id, turn, 'list',
    'Summarise.' || chr(10) || 'Here is the list:' || chr(10) || '0 ' || role || chr(10) || '1 ' || text FROM conversations""")
def _build_prompt(s, d):
    t = X.table(s, d, "conversations")
    parts = [t.select("conv_id", "turn", F.lit(n).alias("template"), T.build_prompt(F.lit("Scene"), "role", "text", n).alias("prompt")) for n in T.PROMPTS]
    parts.append(t.select("conv_id", "turn", F.lit("list").alias("template"),
                          T.build_list_prompt("Summarise.", F.array("role", "text")).alias("prompt")))
    return J.union_splits(parts)


@query("explode_tasks", """SELECT concat('/e/', conv_id, '/', turn) AS info_key, k AS info_type, concat('/e/', conv_id, '/', turn, '-', k) AS custom_id,
    CASE k WHEN 'Action' THEN role WHEN 'Scene' THEN upper(role) ELSE substr(text, 1, 20) END AS info, md5(text) AS instruction
    FROM conversations, (SELECT unnest(['Action', 'Scene', 'Object']) AS k)""")
def _explode_tasks(s, d):
    infos = X.table(s, d, "conversations").select(
        F.concat(F.lit("/e/"), "conv_id", F.lit("/"), "turn").alias("path"), F.col("role").alias("action_info"),
        F.upper("role").alias("scene_info"), F.substring("text", 1, 20).alias("object_info"), F.md5("text").alias("instruction"))
    return C.explode_tasks(infos)


def _score_sql(patterns, col: str) -> str:
    clean = r"""regexp_replace(regexp_replace(response, '["*]', '', 'g'), '^[^\n:]*:', '')"""
    tries = ", ".join(f"list_extract(regexp_extract_all({clean}, '{p}', 1), -1)" for p in patterns)
    return f"CASE WHEN TRY_CAST(coalesce({tries}) AS DOUBLE) > 10 THEN 5.0::DOUBLE ELSE coalesce(TRY_CAST(coalesce({tries}) AS DOUBLE), 5.0::DOUBLE) END AS {col}"


@query("extract_score", using("fx_responses", f"SELECT task_id, {_score_sql(T.SCORE_PATTERNS, 'score')}, {_score_sql(T.SCORE_PATTERNS_LLAMA, 'score_llama')} FROM fx_responses"))
def _extract_score(s, d):
    return X.responses(s, d).select("task_id", T.extract_score("response").alias("score"),
                                    T.extract_score("response", T.SCORE_PATTERNS_LLAMA).alias("score_llama"))


_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[\s\x0B]+', ''), '[\s\x0B]+$', '')"


def _unlist_sql(x: str) -> str:
    out = _strip(x)
    for p, by, g in ((r"\.+\s*\n\d\.\s*", ". ", "g"), (r"\.+\s*\n\-\s*", ". ", "g"), (r"^\-\s*", "", ""), (r"^\d\.\s*", "", ""),
                     (r"\n\d\.\s*", "", "g"), (r"\*", "", "g")):
        out = f"regexp_replace({out}, '{p}', '{by}', '{g}')" if g else f"regexp_replace({out}, '{p}', '{by}')"
    return _strip(f"replace({out}, 'The most significant object is a', 'A')")


_ANS = """SELECT doc_id, concat('1. There is ', text, '.', chr(10), '2. "tail" <', lang, '> [/INST] mid ASSISTANT: *', source, '* end') AS a,
    concat('<think>', chr(10), lang, chr(10), '</think>', chr(10), 'Note: "', text, '"', chr(10)) AS r FROM documents"""
_KINDS = {
    "unlist": _unlist_sql("a"),
    "lead_in": "upper(substr(b, 1, 1)) || lower(substr(b, 2))",
    "summary": _strip(r"""regexp_replace(replace(a, '"', ''), '^[^\n:]*:', '')"""),
    "prefix": rf"regexp_replace({_strip('a')}, '^[^\n:]*:', '')",
    "inst": "string_split(a, '[/INST]')[2]",
    "inst_unlist": _unlist_sql("string_split(a, '[/INST]')[2]"),
    "assistant": _strip("string_split(a, 'ASSISTANT:')[2]"),
    "brackets": r"coalesce(regexp_extract_all(a, '<([^\n]*?)>', 1)[1], 'None')",
    "sentence": _strip("a") + " || '.'",
    "answer": _strip(r"""regexp_replace(replace(trim(string_split(r, '</think>')[-1], chr(10)), '"', ''), '^[^\n:]*:', '')"""),
    "reasoning": "lang2",
}


@query("clean_answer", using("", "SELECT doc_id, " + ", ".join(f"md5({q}) AS {k}" for k, q in _KINDS.items()) + """ FROM (SELECT *,
    replace(replace(replace(replace(a, 'The most significant object is ', ''), 'There is ', ''), 'The most significant object in the image is ', ''),
    'The nearest object is ', '') AS b, d.lang AS lang2 FROM ans JOIN documents d USING (doc_id))""", ans=_ANS))
def _clean_answer(s, d):
    a = F.concat(F.lit("1. There is "), "text", F.lit('.\n2. "tail" <'), "lang", F.lit("> [/INST] mid ASSISTANT: *"), "source", F.lit("* end"))
    r = F.concat(F.lit("<think>\n"), "lang", F.lit('\n</think>\nNote: "'), "text", F.lit('"\n'))
    rows = X.documents(s, d).select("doc_id", a.alias("a"), r.alias("r"))
    return rows.select("doc_id", *[F.md5(T.clean_answer("r" if k in ("answer", "reasoning") else "a", k)).alias(k) for k in _KINDS])


@query("clean_sentences", rf"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace({_strip('text')}, '[\s\x0B]+([.,!?])', '\1', 'g'),
    '[^.!?]*[.!?]'), lambda x: upper(substr({_strip('x')}, 1, 1)) || lower(substr({_strip('x')}, 2))), lambda x: x <> ''), ' ')) AS text FROM documents""")
def _clean_sentences(s, d):
    return X.documents(s, d).select("doc_id", F.md5(T.clean_sentences("text")).alias("text"))


@query("data_url", "SELECT doc_id, md5('data:image/jpeg;base64,' || to_base64(encode(text))) AS url FROM documents")
def _data_url(s, d):
    return X.table(s, d, "documents").select("doc_id", F.md5(T.data_url(F.encode("text", "UTF-8"))).alias("url"))


@query("summarise", "SELECT doc_id, md5(replace(text, chr(10), ' ')) AS instruction FROM documents")
def _summarise(s, d):
    out = M.summarise(X.table(s, d, "documents").select("doc_id", "text"), text="text")
    return out.select("doc_id", F.md5("instruction").alias("instruction"))


@query("embed", "SELECT doc_id, length(text) AS n, length(replace(text, ' ', '')) AS letters FROM documents")
def _embed(s, d):
    M.register("embed", "lengths", lambda texts: [[float(len(t)), float(len(t.replace(" ", "")))] for t in texts])
    out = M.embed(X.table(s, d, "documents").select("doc_id", "text"), "lengths")
    return out.select("doc_id", F.col("vec")[0].cast("long").alias("n"), F.col("vec")[1].cast("long").alias("letters"))


@query("mean_length", using("fx_tokens", "SELECT inst_alias, round(avg(len(t)), 6) AS length FROM fx_tokens GROUP BY 1"))
def _mean_length(s, d):
    return DV.mean_length(X.instructions(s, d)).select("inst_alias", r6("length"))


_H = "md5(concat_ws('@', episode_id))"
_ID = ("episode_id",)


@query("global_positions", using("fx_tokens", f"""SELECT inst_alias, episode_id, CAST(coalesce(sum(len(t)) OVER (PARTITION BY inst_alias ORDER BY {_H}, episode_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM fx_tokens"""))
def _global_positions(s, d):
    t = X.instructions(s, d).select("inst_alias", "episode_id", T.token_count("text").alias("n"))
    return running_offsets(t, ["inst_alias"], ["episode_id"], F.col("n")).drop("n")


_SEQ = {
    "tk": f"SELECT inst_alias, episode_id, {_H} AS h, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM fx_tokens",
    "ps": "SELECT inst_alias, w, row_number() OVER (PARTITION BY inst_alias ORDER BY h, episode_id, i) - 1 AS p FROM tk",
}


@query("mattr", using("fx_tokens", """SELECT inst_alias, round(sum(greatest(0, least(p, n - w50) - greatest(q + 1, p - w50 + 1, 0) + 1)) / any_value(w50 * (n - w50 + 1)), 6) AS mattr
    FROM (SELECT *, least(50, n) AS w50 FROM (SELECT inst_alias, p, count(*) OVER (PARTITION BY inst_alias) AS n,
      coalesce(lag(p) OVER (PARTITION BY inst_alias, w ORDER BY p), -1) AS q FROM ps)) GROUP BY 1""", **_SEQ))
def _mattr(s, d):
    return DV.mattr(X.instructions(s, d), ids=_ID).select("inst_alias", r6("mattr"))


@query("hdd", using("fx_tokens", """SELECT inst_alias, round(sum((1 - list_reduce(list_prepend(1::DOUBLE, list_transform(range(0, 42), lambda j: greatest(n - c - j, 0) / (n - j)::DOUBLE)),
    lambda a, b: a * b)) / 42), 6) AS hdd FROM (SELECT inst_alias, c, sum(c) OVER (PARTITION BY inst_alias) AS n FROM (
    SELECT inst_alias, w, count(*) AS c FROM tk GROUP BY ALL)) GROUP BY 1""", **_SEQ))
def _hdd(s, d):
    return DV.hdd(X.instructions(s, d)).select("inst_alias", r6("hdd"))


_WORDS = {
    "wd": f"SELECT inst_alias, episode_id, {_H} AS h, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, string_split(text, ' ') AS ws FROM fx_instructions)",
    "seq": """SELECT inst_alias, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM wd
        WINDOW o AS (PARTITION BY inst_alias ORDER BY h, episode_id, i)""",
}


@query("ngram_diversity", using("fx_instructions", """SELECT inst_alias, round(
    count(DISTINCT w) / count(w)::DOUBLE + count(DISTINCT CASE WHEN w2 IS NOT NULL THEN w || ' ' || w2 END) / count(w2)::DOUBLE
    + count(DISTINCT CASE WHEN w3 IS NOT NULL THEN w || ' ' || w2 || ' ' || w3 END) / count(w3)::DOUBLE
    + count(DISTINCT CASE WHEN w4 IS NOT NULL THEN w || ' ' || w2 || ' ' || w3 || ' ' || w4 END) / count(w4)::DOUBLE, 6) AS ngd FROM seq GROUP BY 1""", **_WORDS))
def _ngram_diversity(s, d):
    return DV.ngram_diversity(X.instructions(s, d), ids=_ID).select("inst_alias", r6("ngd"))


_QUADS = {
    "quad": """SELECT inst_alias, episode_id, t[i] AS a, t[i + 1] || ' ' || t[i + 2] AS m, t[i + 3] AS z, count(*) AS c
        FROM (SELECT inst_alias, episode_id, t, unnest(range(1, len(t) - 2)) AS i FROM fx_tokens) GROUP BY ALL""",
    "gram": "SELECT DISTINCT inst_alias, a, m, z FROM quad",
}


def _self_rep_sql(match: str) -> str:
    on = "ends_with(q.a, g.a) AND starts_with(q.z, g.z)" if match == "substring" else "q.a = g.a AND q.z = g.z"
    return f"""SELECT inst_alias, round(coalesce(total, 0) / n, 6) AS self_rep FROM (SELECT inst_alias, count(*) AS n FROM fx_instructions GROUP BY 1)
        LEFT JOIN (SELECT inst_alias, sum(s) AS total FROM (SELECT inst_alias, episode_id, ln(1 + sum(c * (k - 1))) AS s FROM quad JOIN (
          SELECT g.inst_alias, g.a, g.m, g.z, count(DISTINCT q.episode_id) AS k FROM gram g JOIN quad q ON q.inst_alias = g.inst_alias AND q.m = g.m AND {on}
          GROUP BY ALL) USING (inst_alias, a, m, z) GROUP BY 1, 2) GROUP BY 1) USING (inst_alias)"""


@query("self_repetition", using("fx_tokens", _self_rep_sql("substring"), **_QUADS))
def _self_repetition(s, d):
    return DV.self_repetition(X.instructions(s, d), ids=_ID).select("inst_alias", r6("self_rep"))


@query("self_repetition_token", using("fx_tokens", _self_rep_sql("token"), **_QUADS))
def _self_repetition_token(s, d):
    return DV.self_repetition(X.instructions(s, d), ids=_ID, match="token").select("inst_alias", r6("self_rep"))


def _grams(source: str) -> dict[str, str]:
    cte = {
        "gc": " UNION ALL ".join(
            f"SELECT inst_alias, episode_id, {m} AS m, array_to_string(t[i:i + {m - 1}], ' ') AS g, count(*) AS c "
            f"FROM (SELECT inst_alias, episode_id, t, unnest(range(1, len(t) - {m - 2})) AS i FROM {source}) GROUP BY ALL" for m in (1, 2, 3, 4)),
        "ln": f"SELECT inst_alias, episode_id, len(t) AS len FROM {source}",
    }
    return cte


_BLEU = {
    **_grams("fx_tokens"),
    "tp": """SELECT inst_alias, m, g, c, max(c) OVER (PARTITION BY inst_alias, m, g) AS c1, k FROM (
        SELECT inst_alias, m, g, c, count(*) AS k FROM gc GROUP BY ALL)""",
    "bs": """SELECT inst_alias, m, g, max(c) AS c1, max(CASE WHEN c = c1 THEN k END) AS k1, coalesce(max(CASE WHEN c < c1 THEN c END), 0) AS c2
        FROM tp GROUP BY 1, 2, 3""",
    "hits": """SELECT inst_alias, episode_id, m, sum(least(c, CASE WHEN c = c1 AND k1 = 1 THEN c2 ELSE c1 END)) AS h
        FROM gc JOIN bs USING (inst_alias, m, g) GROUP BY 1, 2, 3""",
    "hi": "SELECT inst_alias, len, count(*) AS k FROM ln GROUP BY 1, 2",
    "rf": """SELECT inst_alias, len, CASE WHEN k > 1 THEN len WHEN lo IS NULL THEN up WHEN up IS NULL THEN lo WHEN len - lo <= up - len THEN lo ELSE up END AS ref
        FROM (SELECT *, lag(len) OVER w AS lo, lead(len) OVER w AS up FROM hi WINDOW w AS (PARTITION BY inst_alias ORDER BY len))""",
    "sc": """SELECT l.inst_alias, l.episode_id, any_value(l.len) AS len, any_value(ref) AS ref,
        max(CASE WHEN m = 1 THEN h ELSE 0 END) AS h1, max(CASE WHEN m = 2 THEN h ELSE 0 END) AS h2,
        max(CASE WHEN m = 3 THEN h ELSE 0 END) AS h3, max(CASE WHEN m = 4 THEN h ELSE 0 END) AS h4
        FROM ln l JOIN rf r ON r.inst_alias = l.inst_alias AND r.len = l.len LEFT JOIN hits x ON x.inst_alias = l.inst_alias AND x.episode_id = l.episode_id GROUP BY 1, 2""",
}


def _bleu_sql(ref: str, hyp: str) -> str:
    logs = " + ".join(f"ln(CASE WHEN h{m} > 0 THEN h{m}::DOUBLE ELSE 0.1 END / greatest({hyp} - {m - 1}, 1))" for m in (1, 2, 3, 4))
    return f"CASE WHEN h1 > 0 THEN exp(least(0, 1 - {ref}::DOUBLE / greatest({hyp}, 1)) + ({logs}) / 4) ELSE 0 END"


@query("self_bleu", using("fx_tokens", f"SELECT inst_alias, round(avg({_bleu_sql('ref', 'len')}), 6) AS self_bleu FROM sc GROUP BY 1", **_BLEU))
def _self_bleu(s, d):
    return DV.self_bleu(X.instructions(s, d), ids=_ID).select("inst_alias", r6("self_bleu"))


# several texts for each episode: the turns of a conversation, told apart by the default ids
_MANY = "SELECT role AS inst_alias, 'conv' AS split, conv_id, turn, coalesce(text, '') AS text FROM conversations"


@query("ngram_diversity_many", using("", """SELECT inst_alias, round(
    count(DISTINCT w) / count(w)::DOUBLE + count(DISTINCT CASE WHEN w2 IS NOT NULL THEN w || ' ' || w2 END) / count(w2)::DOUBLE, 6) AS ngd FROM seq GROUP BY 1""",
    mn=_MANY, wd="SELECT inst_alias, md5(concat_ws('@', split, conv_id, turn)) AS h, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, string_split(text, ' ') AS ws FROM mn)",
    seq="SELECT inst_alias, w, lead(w, 1) OVER (PARTITION BY inst_alias ORDER BY h, i) AS w2 FROM wd"))
def _ngram_diversity_many(s, d):
    return DV.ngram_diversity(X.turns(s, d), 2).select("inst_alias", r6("ngd"))


_MANY_TOKENS = f"SELECT inst_alias, concat(conv_id, '/', turn) AS episode_id, regexp_extract_all(text, '{TOK}') AS t FROM mn"


@query("self_bleu_many", using("", f"SELECT inst_alias, round(avg({_bleu_sql('ref', 'len')}), 6) AS self_bleu FROM sc GROUP BY 1",
                               mn=_MANY, mt=_MANY_TOKENS, **{k: v.replace("fx_tokens", "mt") for k, v in _BLEU.items()}))
def _self_bleu_many(s, d):
    return DV.self_bleu(X.turns(s, d)).select("inst_alias", r6("self_bleu"))


@query("self_repetition_many", using("", _self_rep_sql("token").replace("fx_instructions", "mn"), mn=_MANY, mt=_MANY_TOKENS,
                                     **{k: v.replace("fx_tokens", "mt") for k, v in _QUADS.items()}))
def _self_repetition_many(s, d):
    return DV.self_repetition(X.turns(s, d), match="token").select("inst_alias", r6("self_rep"))


_SMALL = {"st": f"SELECT 'benchmark' AS inst_alias, item_id AS episode_id, regexp_extract_all(text, '{TOK}') AS t FROM benchmark", **_grams("st")}
_HOM = {
    **_SMALL,
    "ov": """SELECT r.episode_id AS i, h.episode_id AS j, r.m, sum(least(r.c, h.c)) AS h FROM gc r JOIN gc h ON h.m = r.m AND h.g = r.g
        AND h.episode_id <> r.episode_id GROUP BY ALL""",
    "pr": """SELECT i, j, max(CASE WHEN m = 1 THEN h ELSE 0 END) AS h1, max(CASE WHEN m = 2 THEN h ELSE 0 END) AS h2,
        max(CASE WHEN m = 3 THEN h ELSE 0 END) AS h3, max(CASE WHEN m = 4 THEN h ELSE 0 END) AS h4 FROM ov GROUP BY i, j""",
}


@query("homogenization_bleu", using("", f"""SELECT 'benchmark' AS inst_alias, round(sum({_bleu_sql('a.len', 'b.len')}) /
    (SELECT count(*) * (count(*) - 1) FROM benchmark), 6) AS hom_bleu FROM pr JOIN ln a ON a.episode_id = i JOIN ln b ON b.episode_id = j""", **_HOM))
def _homogenization_bleu(s, d):
    return DV.homogenization_bleu(X.small_corpus(s, d)).select("inst_alias", r6("hom_bleu"))


# one row of the table of common lengths for each token of the shorter named text, as a running maximum over the other's tokens
_ROUGE = {
    **_SMALL,
    "rt": "SELECT episode_id AS e, unnest(range(1, len(t) + 1)) AS i, lower(unnest(t)) AS w FROM st",
    "lcs": """SELECT a.episode_id AS x, rt.e AS y, CAST(0 AS BIGINT) AS i, rt.i AS j, CAST(0 AS BIGINT) AS v FROM st a JOIN rt ON a.episode_id < rt.e
        UNION ALL SELECT x, y, i + 1, j, max(step) OVER (PARTITION BY x, y ORDER BY j) FROM (
          SELECT l.x, l.y, l.i, l.j, CASE WHEN p.w = q.w THEN coalesce(lag(v) OVER (PARTITION BY l.x, l.y ORDER BY l.j), 0) + 1 ELSE v END AS step
          FROM lcs l JOIN rt p ON p.e = l.x AND p.i = l.i + 1 JOIN rt q ON q.e = l.y AND q.i = l.j)""",
    "rp": "SELECT x, y, max(v) AS common FROM lcs GROUP BY x, y",
}


@query("homogenization_rougel", using("", """SELECT 'benchmark' AS inst_alias, round(2 * sum(2 * common / (a.len + b.len)::DOUBLE) /
    (SELECT count(*) * (count(*) - 1) FROM benchmark), 6) AS hom_rougel FROM rp JOIN ln a ON a.episode_id = x JOIN ln b ON b.episode_id = y""", **_ROUGE))
def _homogenization_rougel(s, d):
    return DV.homogenization_rougel(X.small_corpus(s, d)).select("inst_alias", r6("hom_rougel"))


def _report_sql() -> str:
    """All statistics of the small corpus: the SQL of each one over that corpus, side by side."""
    names = {"mean_length": "length", "mattr": "mattr", "hdd": "hdd", "ngram_diversity": "ngd", "self_repetition": "self_rep", "self_bleu": "self_bleu",
             "homogenization_bleu": "hom_bleu", "homogenization_rougel": "hom_rougel"}
    small = "SELECT 'benchmark' AS inst_alias, 'all' AS split, item_id AS episode_id, text FROM benchmark"
    parts = [f"({ORACLE[n].replace(VIEWS['fx_instructions'], small)}) AS r{i}" for i, n in enumerate(names)]
    cols = [f"CAST({c if c not in ('cr', 'cr_pos') else 'NULL'} AS DOUBLE) AS {c}" for c in DV.REPORT]
    joined = parts[0] + "".join(f" LEFT JOIN {p} USING (inst_alias)" for p in parts[1:])
    return f"SELECT inst_alias, {', '.join(cols)} FROM {joined}"


@query("diversity_report", _report_sql())
def _diversity_report(s, d):
    return DV.diversity_report(X.small_corpus(s, d), rouge=True).select("inst_alias", *[r6(c) for c in DV.REPORT])


@query("merge_reports", using("fx_instructions", """SELECT split AS alias, avg(length(text)) AS length, CAST(count(*) AS DOUBLE) AS "hdd ↑", CAST(NULL AS DOUBLE) AS "mattr ↑",
    CAST(NULL AS DOUBLE) AS "ngd ↑", CAST(NULL AS DOUBLE) AS "cr ↓", CAST(NULL AS DOUBLE) AS "cr_pos ↓", CAST(NULL AS DOUBLE) AS "self_rep ↓",
    CAST(NULL AS DOUBLE) AS "self_bleu ↓", CAST(NULL AS DOUBLE) AS "hom_bleu ↓", CAST(NULL AS DOUBLE) AS "hom_rougel ↓" FROM fx_instructions GROUP BY 1"""))
def _merge_reports(s, d):
    t = X.instructions(s, d).groupBy(F.col("split").alias("alias")).agg(F.avg(F.length("text")).alias("length"), F.count(F.lit(1)).cast("double").alias("hdd"))
    return DV.merge_reports(DV.report_rows(t, "alias"))


@query("sample_rows", using("fx_instructions", f"""SELECT inst_alias, episode_id, kind FROM (SELECT *, 'ratio' AS kind, row_number() OVER (ORDER BY uu, episode_id) AS r, count(*) OVER () AS n FROM s)
    WHERE r <= greatest(1, floor(n * 0.1)) UNION ALL
    SELECT inst_alias, episode_id, 'count' FROM (SELECT *, row_number() OVER (ORDER BY uu, episode_id) AS r FROM s) WHERE r <= 77 UNION ALL
    SELECT inst_alias, episode_id, 'all' FROM s""", s=f"SELECT *, {u('sample_rows', 'CAST(episode_id AS VARCHAR)')} AS uu FROM fx_instructions"))
def _sample_rows(s, d):
    t = X.instructions(s, d).select("inst_alias", "episode_id")
    return J.union_splits([SA.sample_rows(t, r, ["episode_id"]).withColumn("kind", F.lit(k)) for r, k in ((0.1, "ratio"), (77, "count"), (1.0, "all"))])


@query("random_instruction", using("fx_instructions", rf"""SELECT path, system, inst_id, md5(array_to_string(list_filter(list_transform(regexp_extract_all(
    regexp_replace({_strip('text')}, '[\s\x0B]+([.,!?])', '\1', 'g'), '[^.!?]*[.!?]'), lambda x: upper(substr({_strip('x')}, 1, 1)) || lower(substr({_strip('x')}, 2))),
    lambda x: x <> ''), ' ')) AS text FROM (SELECT split AS path, inst_alias AS system, episode_id AS inst_id, text,
    row_number() OVER (PARTITION BY split, inst_alias ORDER BY {u('random_instruction', 'split', 'inst_alias', 'CAST(episode_id AS VARCHAR)')}, episode_id) AS r FROM fx_instructions) WHERE r = 1"""))
def _random_instruction(s, d):
    t = X.instructions(s, d).select(F.col("split").alias("path"), F.col("inst_alias").alias("system"), F.col("episode_id").alias("inst_id"), "text")
    return SA.random_instruction(t).withColumn("text", F.md5("text"))


_PATHS = {
    "sp": "SELECT CAST(user_id AS VARCHAR) AS name, min(event_id) AS base, event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS source_rank FROM events GROUP BY ALL",
    "un": "SELECT name, max(source_rank) AS source_rank, max_by(base, source_rank) AS base FROM sp GROUP BY 1",
}


@query("sample_paths", using("", f"""SELECT name, source_rank, base FROM (SELECT *, row_number() OVER (ORDER BY {u('sample_paths', 'name')}, name) AS r FROM un)
    WHERE r <= 90 AND (SELECT count(*) FROM sp) >= 90 UNION ALL SELECT name, source_rank, base FROM sp WHERE (SELECT count(*) FROM sp) < 90""", **_PATHS))
def _sample_paths(s, d):
    kind = F.col("event_type")
    rank = F.coalesce(*[F.when(kind == k, i) for i, k in enumerate(("view", "click", "purchase", "signup"))], F.lit(4))
    rows = X.table(s, d, "events").groupBy(F.col("user_id").cast("string").alias("name"), rank.alias("source_rank")).agg(F.min("event_id").alias("base"))
    return SA.sample_paths(rows, 90)


_SYN = """SELECT * FROM (VALUES ('user', 0, 'walker'), ('user', 1, 'guest'), ('user', 2, 'visitor'), ('assistant', 0, 'helper'), ('assistant', 1, 'guide')) v(word, rank, replacement)"""


@query("diversify_element", using("fx_dialogue", f"""SELECT f.episode_id, f.frame_idx, coalesce('the ' || replacement, 'the ' || scene) AS scene FROM (
    SELECT *, {u('diversify_element', 'CAST(episode_id AS VARCHAR)', 'CAST(frame_idx AS VARCHAR)')} AS uu FROM fx_dialogue) f
    LEFT JOIN (SELECT word, count(*) AS n FROM syn GROUP BY 1) k ON k.word = f.scene
    LEFT JOIN syn ON syn.word = f.scene AND syn.rank = CAST(floor(uu * n) AS INT)""", syn=_SYN))
def _diversify_element(s, d):
    syn = s.createDataFrame([("user", 0, "walker"), ("user", 1, "guest"), ("user", 2, "visitor"), ("assistant", 0, "helper"), ("assistant", 1, "guide")],
                            "word string, rank int, replacement string")
    tags = s.createDataFrame([("the", "DT")], "word string, tag string")
    t = X.dialogue(s, d).select("episode_id", "frame_idx", F.concat(F.lit("the "), "scene").alias("scene"))
    return SA.diversify_element(t, syn, ["episode_id"], level=2, col="scene", tags=tags)


@query("timing_summary", """SELECT CAST(count(*) AS BIGINT) AS episodes, round(avg(l_quantity), 6) AS actions, round(avg(l_discount), 6) AS scenes, round(avg(l_tax), 6) AS objects,
    round(avg(l_extendedprice), 4) AS summary, round(avg(l_quantity + l_discount), 6) AS total, round(avg(l_linenumber), 6) AS steps, round(avg(l_linenumber // 2), 6) AS steps_compact FROM lineitem""")
def _timing_summary(s, d):
    t = X.table(s, d, "lineitem").select(
        F.col("l_quantity").alias("actions"), F.col("l_discount").alias("scenes"), F.col("l_tax").alias("objects"), F.col("l_extendedprice").alias("summary"),
        (F.col("l_quantity") + F.col("l_discount")).alias("total"), F.col("l_linenumber").alias("steps"), F.floor(F.col("l_linenumber") / 2).alias("steps_compact"))
    out = S.timing_summary(t)
    return out.select("episodes", *[r6(c, digits=4 if c == "summary" else 6) for c in out.columns[1:]])
