"""Seeded sampling and lexical variation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.lexicon import ACTION_PHRASES
from wayline.functions.random import hash_uniform
from wayline.functions.text import clean_sentences, tokens
from wayline.operators.frames import KEY
from wayline.operators.ordered import IDX


def _first_by_hash(df: DataFrame, n: Column | int, ids: Sequence[str], seed: int, salt: str, slices: int = 4096) -> DataFrame:
    """Exactly n rows, the ones with the smallest draws.

    Draws are uniform, so counting rows per slice of [0, 1) locates the slice that holds
    the n-th draw. Slices below it are taken whole and only that one is ranked: no
    global sort, and n may be of any size.
    """
    rows = df.withColumn("_u", hash_uniform(*ids, seed=seed, salt=salt)).withColumn("_s", F.floor(F.col("_u") * slices))
    below = F.coalesce(F.sum("_m").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most `slices` rows
    counts = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_m")).select("_s", "_m", below.alias("_below"))
    wanted = n if isinstance(n, Column) else F.lit(n)
    share = counts.withColumn("_take", wanted - F.col("_below")).where(F.col("_take") > 0)
    chosen = rows.join(F.broadcast(share), "_s")
    whole = chosen.where(F.col("_m") <= F.col("_take"))
    edge = chosen.where(F.col("_m") > F.col("_take"))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_u", *ids))
    edge = edge.withColumn("_r", rank).where(F.col("_r") <= F.col("_take"))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def sample_rows(df: DataFrame, ratio: float, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """ratio < 1: max(1, int(N * ratio)) rows; > 1: that many rows; 1: all."""
    if ratio == 1.0:
        return df
    if ratio > 1.0:
        return _first_by_hash(df, int(ratio), ids, seed, "sample_rows")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.greatest(F.lit(1), F.floor(total * max(0.0, ratio)))
    return _first_by_hash(df, n, ids, seed, "sample_rows")


def random_instruction(instructions: DataFrame, by: Sequence[str] = ("path", "system"), inst_id: str = "inst_id",
                       text: str = "text", seed: int = 42) -> DataFrame:
    """One instruction per episode and system, with tidy sentences.

    Only ids are compared; the text rides along as the value of the winner.
    """
    u = hash_uniform(*by, inst_id, seed=seed, salt="random_instruction")
    pick = F.min_by(F.struct(inst_id, text), F.struct(u, F.col(inst_id)))
    rows = instructions.groupBy(*by).agg(pick.alias("_p"))
    return rows.select(*by, F.col(f"_p.{inst_id}").alias(inst_id), clean_sentences(F.col(f"_p.{text}")).alias(text))


def sample_paths(paths: DataFrame, n: int = 400, name: str = "name", rank: str = "source_rank", seed: int = 42) -> DataFrame:
    """Fewer than n paths: all, with repeats. Otherwise one per name (the last source wins), and n of them."""
    total = paths.agg(F.count(F.lit(1)).alias("n")).scalar()
    values = [c for c in paths.columns if c != name]
    last = F.max_by(F.struct(*values), F.col(rank)).alias("_v")
    unique = paths.where(total >= n).groupBy(name).agg(last).select(name, *[F.col(f"_v.{c}").alias(c) for c in values])
    picked = _first_by_hash(unique, n, [name], seed, "sample_paths")
    return paths.where(total < n).unionByName(picked.select(*paths.columns))


def _choice(n: Column, u: Column, level: int, limit: Column) -> Column:
    """Index in [0, n) by level: 1 a prefix whose size grows with `limit`, 2 uniform, 3 decaying weights."""
    if level == 1:
        # round half to even, as in the definition of the prefix
        size = F.least(n, F.greatest(F.lit(1), F.bround(limit * n + 0.5).cast("int")))
        return F.floor(u * size).cast("int")
    if level == 2:
        return F.floor(u * n).cast("int")
    if level == 3:
        # weights exp(-10 * limit * i / n) are geometric: invert their cumulative sum
        rate = limit * 10 / n
        inverse = -F.log(1 - u * (1 - F.exp(-rate * n))) / F.greatest(rate, F.lit(1e-12))
        uniform = F.floor(u * n)
        return F.least(F.when(rate > 1e-9, F.floor(inverse)).otherwise(uniform), n - 1).cast("int")
    raise ValueError("level is 0, 1, 2 or 3")


def episode_limit(key: Sequence[str], offset: float = 0.0, seed: int = 42) -> Column:
    """One draw per episode plus an offset; scales how adventurous phrases get."""
    return hash_uniform(*key, seed=seed, salt="diversify_limit") + offset


def diversify_action(df: DataFrame, key: Sequence[str] = KEY, level: int = 1, offset: float = 0.0,
                     lexicon: Mapping[str, Sequence[str]] = ACTION_PHRASES, col: str = "action", idx: str = IDX,
                     seed: int = 42) -> DataFrame:
    """Replace an action by one of its phrases; unknown actions stay."""
    if not level:
        return df
    table = F.create_map(*[x for a, p in lexicon.items() for x in (F.lit(a), F.array(*[F.lit(w) for w in p]))])
    phrases = F.try_element_at(table, F.col(col))
    u = hash_uniform(*key, idx, seed=seed, salt="diversify_action")
    pick = _choice(F.size(phrases), u, level, episode_limit(key, offset, seed))
    return df.withColumn(col, F.when(phrases.isNull(), F.col(col)).otherwise(F.get(phrases, pick)))


def diversify_element(df: DataFrame, synonyms: DataFrame, key: Sequence[str] = KEY, level: int = 1, offset: float = 0.0,
                      col: str = "object", idx: str = IDX, tags: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Replace one eligible word of a phrase by a synonym.

    `synonyms` has (word, rank, replacement), rank counting from 0 per word; `tags` has
    (word, tag). Proper nouns (NNP), determiners (DT) and punctuation are not eligible.
    Only the drawn word is joined, so a row never leaves as more than one row.
    """
    if not level:
        return df
    ids = [*key, idx]
    words = df.withColumn("_w", tokens(col))
    open_words = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                          lambda s: s["w"].rlike(r"^[\p{L}\p{N}]"))
    if tags is not None:
        closed = tags.where(F.col("tag").isin("NNP", "DT")).select("word").distinct()
        rows = words.select(*ids, F.inline(open_words).alias("w", "i")).join(closed.withColumnRenamed("word", "w"), "w", "left_anti")
        eligible = rows.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("_e"))
        words = words.join(eligible, ids, "left")
    else:
        words = words.withColumn("_e", open_words)
    n = F.size("_e")
    pick = F.get("_e", F.floor(hash_uniform(*ids, seed=seed, salt="diversify_word") * n).cast("int"))
    drawn = words.withColumn("_p", F.when(n > 0, pick)).withColumn("word", F.col("_p.w")).drop("_e")
    # rows without a word meet nothing: spread them instead of sending all to the task of null
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*ids), F.lit(4096)).cast("string"))
    drawn = drawn.withColumn("_k", F.coalesce("word", spread))
    counts = synonyms.groupBy(F.col("word").alias("_k")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    u = hash_uniform(*ids, seed=seed, salt="diversify_element")
    ranked = drawn.join(counts, "_k", "left").withColumn("rank", _choice(F.col("_n"), u, level, episode_limit(key, offset, seed)))
    swapped = ranked.join(synonyms.select(F.col("word").alias("_k"), F.col("rank").cast("int").alias("rank"), "replacement"), ["_k", "rank"], "left")
    new = F.concat(F.slice("_w", F.lit(1), F.col("_p.i")), F.array("replacement"),
                   F.slice("_w", F.col("_p.i") + 2, F.size("_w")))
    text = F.regexp_replace(F.array_join(new, " "), r" ([.,!?;:])", "$1")
    return swapped.withColumn(col, F.when(F.col("replacement").isNotNull(), text).otherwise(F.col(col))).select(*df.columns)
