"""Corpus diversity statistics, one value per group of texts (`inst_alias`).

Input: a text table with an id column. "Corpus order" is the hash order of the ids:
fixed, arbitrary and evenly spread. No statistic sends a whole group, a frequent
token or a frequent n-gram through a single task.
"""

from __future__ import annotations

import gzip
import lzma
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions.text import token_count, tokens
from wayline.operators import grams as G
from wayline.operators.ordered import cut, neighbours, running_offsets
from wayline.operators.sampling import sample_rows

GROUP = ("inst_alias",)
#: What tells texts apart, as far as a table has it: episode names repeat over sources and splits, and an episode may have several texts.
IDS = ("source", "split", "episode_id", "inst_id")
TOKEN_BLOCK = 2048
TEXT_BLOCK = 512
#: Texts, and bytes, of a block that meets others pair by pair.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 4 << 20
REPORT = ["length", "mattr", "hdd", "ngd", "cr", "cr_pos", "self_rep", "self_bleu", "hom_bleu", "hom_rougel"]

# Headings of the merged report; arrows tell which direction is more diverse.
HEADINGS = {
    "length": "length", "mattr": "mattr ↑", "hdd": "hdd ↑", "ngd": "ngd ↑", "cr": "cr ↓", "cr_pos": "cr_pos ↓",
    "self_rep": "self_rep ↓", "self_bleu": "self_bleu ↓", "hom_bleu": "hom_bleu ↓", "hom_rougel": "hom_rougel ↓",
}


def _ids(df: DataFrame, ids: Sequence[str] | None) -> list[str]:
    return list(ids) if ids is not None else [c for c in IDS if c in df.columns]


def check_ids(df: DataFrame, group: Sequence[str], ids: Sequence[str]) -> None:
    """Fail if an id has several texts, for they would be merged or multiplied. Only the id columns are read and moved."""
    twice = df.groupBy(*group, *ids).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several texts have the ids {'@'.join(str(v) for v in twice[0][:-1])}")


class Corpus:
    """A corpus tokenized and written once, for several statistics: rows (group, ids, text, number of the text, tokens).

    The n-grams of its texts are counted and written, packed, when a statistic first needs them.
    """

    def __init__(self, df: DataFrame, group: Sequence[str] = GROUP, ids: Sequence[str] | None = None, text: str = "text"):
        self.group, self.ids = list(group), _ids(df, ids)
        check_ids(df, self.group, self.ids)
        rows = df.select(*self.group, *self.ids, F.col(text).alias("text"), F.monotonically_increasing_id().alias("_x"), tokens(text).alias("_t"))
        self.words = cut(rows)
        self._counts: dict[int, DataFrame] = {}

    def counts(self, n: int) -> DataFrame:
        """The packed counts of all 1..n-grams."""
        if n not in self._counts:
            self._counts[n] = cut(_gram_counts(self.words, self.group, n))
        return self._counts[n]


def _numbered(df: DataFrame, group: list[str], ids: list[str], text: str) -> DataFrame:
    """Rows (group, text number, tokens) for one statistic: what it counts is written, so every use sees the same numbers."""
    check_ids(df, group, ids)
    return cut(df.select(*group, F.monotonically_increasing_id().alias("_x"), tokens(text).alias("_t")))


def mean_length(df: DataFrame | Corpus, group: Sequence[str] = GROUP, text: str = "text") -> DataFrame:
    if isinstance(df, Corpus):
        return df.words.groupBy(*df.group).agg(F.avg(F.size("_t")).alias("length"))
    return df.groupBy(*group).agg(F.avg(token_count(text)).alias("length"))


def _tokens(df: DataFrame | Corpus, text: str) -> tuple[DataFrame, Column]:
    return (df.words, F.col("_t")) if isinstance(df, Corpus) else (df, tokens(text))


def _token_blocks(df: DataFrame | Corpus, group: Sequence[str], ids: Sequence[str], text: str, before: int,
                  lemma: DataFrame | None) -> DataFrame:
    """Cut the concatenated corpus into blocks of TOKEN_BLOCK tokens, as hashes, plus the `before` tokens ahead of each.

    Texts are cut at block borders and travel as array slices, so the shuffle carries
    arrays, not one row per token. The end of the corpus may leave a last block of
    context only.
    """
    rows, split = _tokens(df, text)
    words = rows.select(*group, *ids, split.alias("_t"))
    if lemma is not None:
        words = _relabel(words, [*group, *ids], "_t", lemma, "lemma", keep_unknown=True)
    words = words.withColumn("_t", G.hashed("_t"))
    placed = running_offsets(words.where(F.size("_t") > 0), group, ids, F.size("_t"), "_o", rows.count())
    size = F.size("_t").cast("long")
    first, last = F.floor(F.col("_o") / TOKEN_BLOCK), F.floor((F.col("_o") + size - 1 + before) / TOKEN_BLOCK)
    lo = F.greatest(F.col("_o"), F.col("_b") * TOKEN_BLOCK - before)
    hi = F.least(F.col("_o") + size, (F.col("_b") + 1) * TOKEN_BLOCK)
    pieces = (
        placed.withColumn("_b", F.explode(F.sequence(first, last)))
        .select(*group, "_b", lo.alias("_lo"), F.slice("_t", (lo - F.col("_o") + 1).cast("int"), (hi - lo).cast("int")).alias("_p"))
    )
    return pieces.groupBy(*group, "_b").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_lo", "_p"))), lambda s: s["_p"])).alias("_t"))


def _block_types(group: list[str], w: int, before: int, size: int):
    """For every block, the types that its own tokens add to windows, its last position, and (p, q) of its last w tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, flat = b.column("_t").offsets.to_numpy().astype(np.int64), b.column("_t").values.to_numpy(zero_copy_only=False)
            block = b.column("_b").to_numpy(zero_copy_only=False)
            sums, last, tails, cuts = [], [], [], [0]
            for i, at in enumerate(block.tolist()):
                t = flat[ends[i] : ends[i + 1]]
                halo = min(before, at * size)
                base = at * size - halo
                order = np.argsort(t, kind="stable")
                seen = np.full(len(t), -1, np.int64)
                same = t[order[1:]] == t[order[:-1]]
                seen[order[1:][same]] = order[:-1][same] + base
                p = np.arange(base, base + len(t))
                first = np.maximum(np.maximum(seen + 1, p - w + 1), 0)
                sums.append(int((p - first + 1)[halo:].sum()))
                last.append(base + len(t) - 1)
                tails.append(np.stack([p, seen], 1)[-w:])
                cuts.append(cuts[-1] + len(tails[-1]))
            tail = np.concatenate(tails) if tails else np.zeros((0, 2), np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(tail[:, 0]), pa.array(tail[:, 1])], names=["p", "q"])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in group], b.column("_b"), pa.array(sums, pa.int64()), pa.array(last, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)], names=[*group, "_b", "_g", "_p", "_tail"])

    return run


def _relabel(words: DataFrame, ids: Sequence[str], col: str, table: DataFrame, to: str, keep_unknown: bool,
             default: str = "NN") -> DataFrame:
    """Replace every token of an array column by its entry in a (word, `to`) table."""
    rows = words.select(*ids, F.posexplode(col).alias("_i", "word"))
    found = rows.join(table.select("word", to), "word", "left")
    new = F.coalesce(F.col(to), F.col("word") if keep_unknown else F.lit(default))
    lists = found.groupBy(*ids).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", new.alias("_w")))), lambda s: s["_w"]).alias(col))
    return lists


def mattr(df: DataFrame | Corpus, window: int = 50, group: Sequence[str] = GROUP, ids: Sequence[str] | None = None, text: str = "text",
          lemma: DataFrame | None = None) -> DataFrame:
    """Moving-average type-token ratio of the concatenated corpus.

    A token at p whose previous occurrence is at q adds one type to each window that
    starts after q and covers p: starts max(q+1, p-w+1, 0) .. min(p, N-w). Only a q
    among the last w-1 positions matters, so a block needs a little context and no
    window is ever materialised. The cut at N-w concerns the last w tokens only: every
    block returns its last w (p, q), and the group keeps those of the block that owns
    the last token.
    Fewer than w tokens: plain type-token ratio.
    """
    w = window
    before = 2 * (w - 1)  # exact q also for the w-1 tokens ahead of the block
    blocks = _token_blocks(df, group, df.ids if isinstance(df, Corpus) else _ids(df, ids), text, before, lemma)
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    keep = ", ".join(f"`{c}` {types[c]}" for c in group)
    # a block is a row of numbers, worked on where it is: no token becomes a row
    sums = blocks.mapInArrow(_block_types(list(group), w, before, TOKEN_BLOCK), f"{keep}, _b long, _g long, _p long, _tail array<struct<p:bigint,q:bigint>>")

    def first(p: Column, q: Column) -> Column:
        return F.greatest(q + 1, p - w + 1, F.lit(0))

    whole = sums.groupBy(*group).agg(
        F.sum("_g").alias("_g"), (F.max("_p") + 1).alias("_N"), F.max_by("_tail", F.struct(F.col("_p"), -F.col("_b"))).alias("_tail"))
    end = F.col("_N") - w  # last window start

    def over(s: Column) -> Column:
        f = first(s["p"], s["q"])
        return F.when(s["p"] > end, F.greatest(F.lit(0), end - f + 1) - (s["p"] - f + 1)).otherwise(0)

    clipped = F.col("_g") + F.aggregate("_tail", F.lit(0).cast("long"), lambda a, s: a + over(s))
    types = F.size(F.filter("_tail", lambda s: s["q"] < 0))
    score = F.when(end >= 0, clipped / (w * F.greatest(end + 1, F.lit(1)))).otherwise(types / F.col("_N"))
    return whole.select(*group, score.alias("mattr"))


def hdd(df: DataFrame | Corpus, draws: int = 42, group: Sequence[str] = GROUP, text: str = "text") -> DataFrame:
    """Mean over `draws` of the chance to see each type in a draw without replacement; null for short corpora.

    Types with the same count contribute the same, so the product over draws is
    evaluated once per distinct count.
    """
    rows, split = _tokens(df, text)
    types = rows.select(*group, F.explode(split).alias("_w")).groupBy(*group, "_w").agg(F.count(F.lit(1)).alias("_c"))
    counts = types.groupBy(*group, "_c").agg(F.count(F.lit(1)).alias("_types"))
    total = counts.groupBy(*group).agg(F.sum(F.col("_c") * F.col("_types")).alias("_N"))
    n, c = F.col("_N"), F.col("_c")
    steps = F.sequence(F.lit(0), F.lit(draws - 1))
    none = F.aggregate(steps, F.lit(1.0), lambda a, j: a * F.greatest(n - c - j, F.lit(0)) / F.greatest(n - j, F.lit(1)))
    return (
        counts.join(total, list(group)).groupBy(*group)
        .agg(F.when(F.max("_N") >= draws, F.sum(F.col("_types") * (1 - none) / draws)).alias("hdd"))
    )


def compression_ratio(df: DataFrame, algorithm: str = "gzip", group: Sequence[str] = GROUP, ids: Sequence[str] | None = None,
                      text: str = "text", block_bytes: int = 32 << 20, name: str = "cr") -> DataFrame:
    """Bytes of the texts joined by blanks over their compressed bytes (gzip is applied twice).

    The corpus is cut, in corpus order, into runs of whole texts of about
    `block_bytes`; each is compressed on its own and sizes are summed. A corpus below
    the block size is one stream; beyond, the compressor's 32 KiB look-back makes the
    loss at block borders negligible.
    """
    if algorithm not in ("gzip", "xz"):
        raise ValueError("algorithm is gzip or xz")
    ids = _ids(df, ids)
    data = df.select(*group, *ids, F.coalesce(text, F.lit("")).alias("_x"))
    sized = running_offsets(data, group, ids, F.octet_length("_x") + 1, "_o", df.count())
    blocks = sized.withColumn("_b", F.floor(F.col("_o") / block_bytes))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{g}` {types[g]}" for g in group) + ", raw long, packed long"

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        body = " ".join(pdf.sort_values("_o")["_x"]).encode()
        if algorithm == "gzip":
            packed = len(gzip.compress(gzip.compress(body, mtime=0), mtime=0))
        else:
            packed = len(lzma.compress(body))
        return pd.DataFrame([[*key[:-1], len(body), packed]], columns=[*group, "raw", "packed"])

    sizes = blocks.groupBy(*group, "_b").applyInPandas(pack, schema)
    joins = F.count(F.lit(1)) - 1  # blanks between blocks
    return sizes.groupBy(*group).agg(((F.sum("raw") + joins) / F.sum("packed")).alias(name))


def compression_ratio_pos(df: DataFrame, tag_lexicon: DataFrame, group: Sequence[str] = GROUP,
                          ids: Sequence[str] | None = None, text: str = "text", default: str = "NN", **kw) -> DataFrame:
    """Compression ratio of the tag sequences of white-space tokens; unknown words get `default`."""
    ids = _ids(df, ids)
    words = df.select(*group, *ids, F.filter(F.split(text, r"\s+"), lambda t: t != "").alias("_t"))
    tagged = _relabel(words, [*group, *ids], "_t", tag_lexicon, "tag", False, default)
    whole = words.select(*group, *ids).join(tagged, [*group, *ids], "left")
    tags = whole.select(*group, *ids, F.coalesce(F.array_join("_t", " "), F.lit("")).alias("_tags"))
    return compression_ratio(tags, group=group, ids=ids, text="_tags", name="cr_pos", **kw)


def ngram_diversity(df: DataFrame | Corpus, n: int = 4, cross_text: bool = True, group: Sequence[str] = GROUP,
                    ids: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Sum over 1..n of distinct over total n-grams of the texts joined and split by single blanks.

    N-grams run across text borders. A text needs only the n-1 words that follow it,
    and every text has at least one (maybe empty) word, so the next n-1 texts suffice.
    The heads of texts are all that is ordered. N-grams are told apart by hashes and shuffled
    packed, each once for a piece of a task (see `grams`).
    """
    if isinstance(df, Corpus):
        df, ids, text = df.words, df.ids, "text"
    else:
        ids = _ids(df, ids)
        if cross_text:
            check_ids(df, group, ids)
    words = df.select(*group, *ids, G.hashed(F.split(F.coalesce(text, F.lit("")), " ")).alias("_w"))
    count = G.buckets(words, F.size("_w"))
    if cross_text:
        words = _with_following(words, group, ids, n - 1)
    else:
        words = words.withColumn("_after", F.array().cast("array<bigint>"))
    seed = F.xxhash64(*group).alias("_g")
    rows = words.select(seed, F.size("_w").alias("_s"), F.concat("_w", "_after").alias("_h"))
    parts = G.distinct_grams(rows, n, count).groupBy("_g", "_m").agg((F.sum("kinds") / F.sum("total")).alias("_r"))
    ratio = parts.groupBy("_g").agg(F.sum("_r").alias("ngd"))
    return df.select(*group).distinct().withColumn("_g", seed).join(ratio, "_g").select(*group, "ngd")


def _with_following(words: DataFrame, group: Sequence[str], ids: Sequence[str], need: int) -> DataFrame:
    """Add `_after`: the `need` words that follow each text in corpus order."""
    key = list(group)
    # always blocked: windows over the whole group would leave every later step partitioned by group
    heads = running_offsets(words.select(*group, *ids, F.slice("_w", 1, need).alias("_head")), group, ids, F.lit(1), "_pos", words.select(*group).count())
    near = neighbours(heads, key, {f"_h{i}": ("_head", i) for i in range(1, need + 1)}, "_pos", TEXT_BLOCK)
    nothing = F.array().cast("array<bigint>")
    after = F.slice(F.concat(*[F.coalesce(F.col(f"_h{i}"), nothing) for i in range(1, need + 1)]), 1, need)
    # both sides grow with the data; a merge join also keeps the texts spread out for what follows
    return words.join(near.select(*group, *ids, after.alias("_after")).hint("merge"), [*group, *ids])


def self_repetition(df: DataFrame | Corpus, n: int = 4, match: str = "substring", group: Sequence[str] = GROUP,
                    ids: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Mean over texts of ln(1 + sum over its n-grams of the texts containing it - number of its n-grams).

    With `substring`, a text contains t1..tn when it has tokens x1 t2 .. t(n-1) xn with
    x1 ending in t1 and xn starting with tn. Comparing n-grams that share their inner
    tokens would be quadratic for frequent ones. Instead outer tokens are cut to the
    shorter forms that occur beside the same inner tokens and looked up, so work stays
    linear in the tokens.

    N-grams that may match meet in one bucket and are shuffled packed (see `grams`). Only those of very many texts
    are taken apart and joined as rows, with the most frequent ones by broadcast (see `_on_grams`).
    """
    substring = match == "substring"
    if n < 3 and substring:
        raise ValueError("substring matching needs n >= 3")
    g, words = (df.group, df.words) if isinstance(df, Corpus) else (list(group), _numbered(df, list(group), _ids(df, ids), text))
    seeded = _seeded(words, g)
    count = G.buckets(words, F.size("_t"))
    # a key has no more rows than all texts have n-grams
    frequent = G.frequent_keys(seeded, n, substring, count, FREQUENT) if (words.agg(F.sum(F.size("_t"))).first()[0] or 0) > FREQUENT else np.empty(0, np.uint64)
    parts = G.repeated(seeded, n, substring, count, frequent)
    if len(frequent):
        parts = parts.unionByName(_repeated_rows(cut(G.plain_grams(seeded, n, substring, frequent)), substring))
    per_text = parts.groupBy("_x").agg(F.log(1 + F.sum("s")).alias("_s"))
    sums = words.select(*g, "_x").join(per_text, "_x").groupBy(*g).agg(F.sum("_s").alias("_sum"))
    sizes = words.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.join(sums, g, "left").select(*g, (F.coalesce("_sum", F.lit(0.0)) / F.col("_n")).alias("self_rep"))


def _seeded(words: DataFrame, g: Sequence[str]) -> DataFrame:
    """Texts as `grams` takes them: a seed for each group, and hashes of the tokens."""
    return words.select("_x", F.xxhash64(*g).alias("_g"), G.hashed("_t").alias("_h"), F.coalesce("_t", F.array().cast("array<string>")).alias("_t"))


def _repeated_rows(rows: DataFrame, substring: bool) -> DataFrame:
    """Rows (text number, count of an n-gram times the other texts that contain it) of n-grams as rows.

    Join keys start with the n-gram: sorting compares leading columns first, and the group is the same for most rows.
    """
    g = ["_g"]
    gram = ["m", "a", "z", *g]
    spread = rows.groupBy(*gram).agg(F.count(F.lit(1)).alias("_texts"))
    if substring:
        spread = _add_containing(cut(spread), rows, g)
    # an n-gram of a single text adds nothing
    shared = cut(spread.where(F.col("_texts") > 1))
    return _on_grams(rows, shared, gram).select("_x", (F.col("_c") * (F.col("_texts") - 1)).alias("s"))


#: N-grams that may match and have more rows than this are frequent: a bucket holds the rows of all others. Of the frequent ones,
#: those of more texts than this are broadcast; of more than a 65536th of all rows if that is more, so no more than 65536 are.
FREQUENT = 1_000_000


def _on_grams(rows: DataFrame, table: DataFrame, gram: list[str]) -> DataFrame:
    """The rows of the n-grams in a written table, joined.

    A key holds a row for each text of an n-gram. Frequent n-grams are broadcast, and their rows never meet in one task;
    all others are joined by shuffle.
    """
    limit = max(FREQUENT, rows.count() >> 16)
    frequent = table.where(F.col("_texts") > limit)
    if frequent.isEmpty():
        return _join(rows, table, gram)
    rest = rows.join(F.broadcast(frequent.select(*gram).distinct()), gram, "left_anti")
    return rows.join(F.broadcast(frequent), gram).unionByName(_join(rest, table.where(F.col("_texts") <= limit), gram))


def _add_containing(spread: DataFrame, rows: DataFrame, g: list[str]) -> DataFrame:
    """Text counts including the texts that hold a longer form of the n-gram's outer tokens."""
    gram = ["m", "a", "z", *g]
    grams = spread.select(*gram, "_texts")
    left = _shorter(cut(grams.select(*g, "a", "m").distinct()), g, "a", True).withColumnRenamed("to", "a2")
    right = _shorter(cut(grams.select(*g, "m", "z").distinct()), g, "z", False).withColumnRenamed("to", "z2")
    known = grams.select(*g, F.col("a").alias("a2"), "m", F.col("z").alias("z2"))
    by_left = _join(grams, left, ["m", "a", *g])
    cols = [*gram, "_texts", "a2", "z2"]
    longer = (
        by_left.withColumn("z2", F.col("z")).select(*cols)
        .unionByName(_join(by_left, right, ["m", "z", *g]).select(*cols))
        .unionByName(_join(grams, right, ["m", "z", *g]).withColumn("a2", F.col("a")).select(*cols))
    )
    longer = cut(_join(longer, known, ["m", "a2", "z2", *g], "left_semi"))
    found = _on_grams(rows, longer, gram).select(*g, "_x", F.col("a2").alias("a"), "m", F.col("z2").alias("z")).distinct()
    # texts that hold only the longer form
    new = _join(found, rows.select("_x", *gram), ["_x", "m", "a", "z", *g], "left_anti").groupBy(*gram).agg(F.count(F.lit(1)).alias("_more"))
    return _join(spread, new, gram, "left").withColumn("_texts", F.col("_texts") + F.coalesce("_more", F.lit(0))).drop("_more")


def _shorter(pairs: DataFrame, g: list[str], edge: str, suffix: bool) -> DataFrame:
    """For each (edge, inner) pair, the shorter ends `to` of the edge that form a known pair with the same inner tokens.

    An end of one character is looked up as it is. For others the last two characters are matched with the lengths
    first: few edges share both with another one beside the same inner tokens, and a very long token
    is only cut at lengths that occur there.
    """
    whole = F.length(edge)

    def end(size: Column) -> Column:
        return F.substring(F.col(edge), whole - size + 1, size) if suffix else F.substring(F.col(edge), F.lit(1), size)

    known = pairs.where(whole > 1).withColumn("_e", end(F.lit(2)))
    sizes = known.select("_e", "m", *g, whole.alias("_l")).distinct()
    fits = _join(known, sizes, ["_e", "m", *g]).where(F.col("_l") < whole)
    there = known.select(*g, "m", F.col(edge).alias("to"))
    longer = _join(fits.select(*g, "m", edge, end(F.col("_l")).alias("to")), there, ["m", "to", *g], "left_semi")
    ones = pairs.where(whole == 1).select(*g, "m", F.col(edge).alias("to"))
    return longer.unionByName(_join(known.withColumn("to", end(F.lit(1))).select(*g, "m", edge, "to"), ones, ["m", "to", *g], "left_semi"))


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on texts, sorted by their hash: numbers differ early, texts of a corpus late."""
    key = F.xxhash64(*on).alias("_k")
    return left.select("*", key).join(right.select("*", key), ["_k", *on], how).drop("_k")


def _gram_counts(words: DataFrame, g: list[str], n: int = 4) -> DataFrame:
    """Top counts of the 1..n-grams of the texts, packed (see `grams.top_counts`)."""
    return G.top_counts(_seeded(words, g), n, G.buckets(words, F.size("_t")))


def _bleu(hits: list[Column], totals: list[Column], ref_len: Column, hyp_len: Column) -> Column:
    """BLEU with .1 in place of a zero numerator and 0 without any unigram match."""
    logs = [F.log(F.when(h > 0, h.cast("double")).otherwise(F.lit(0.1)) / F.greatest(t, F.lit(1))) for h, t in zip(hits, totals)]
    mean = reduce(lambda a, b: a + b, logs) / len(logs)
    brevity = F.least(F.lit(0.0), 1 - ref_len / F.greatest(hyp_len, F.lit(1)))
    return F.when(hits[0] > 0, F.exp(brevity + mean)).otherwise(0.0)


def self_bleu(df: DataFrame | Corpus, group: Sequence[str] = GROUP, ids: Sequence[str] | None = None, text: str = "text",
              n: int = 4) -> DataFrame:
    """Mean BLEU of each text against all others of the group.

    The clip of an n-gram is its highest count in another text. So a text loses hits by an n-gram only
    if it alone has the top count, and then the distance to the runner-up: every n-gram takes from one
    text at most. Losses are read off the n-grams and summed for their texts, so no row of a text
    goes back to its n-grams. Top and runner-up merge, so a piece of a task sends an n-gram once (see `grams`).
    The reference length is the nearest other length (shorter on a tie), read off the histogram of
    lengths. Nothing is compared pairwise.
    """
    corpus = df if isinstance(df, Corpus) else None
    g = corpus.group if corpus else list(group)
    words = corpus.words if corpus else _numbered(df, g, _ids(df, ids), text)
    counts = corpus.counts(n) if corpus else _gram_counts(words, g, n)
    losses = G.losses(counts, G.buckets(words, F.size("_t")))
    orders = range(1, n + 1)
    lost = losses.groupBy("_x").agg(*[F.sum(F.when(F.col("m") == m, F.col("loss")).otherwise(0)).alias(f"_d{m}") for m in orders])
    lengths = words.select(*g, "_x", F.size("_t").cast("long").alias("_len"))
    hist = lengths.groupBy(*g, "_len").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*g).orderBy("_len")
    lo, hi = F.lag("_len").over(w), F.lead("_len").over(w)
    near = F.when(F.col("_k") > 1, F.col("_len")).when(lo.isNull(), hi).when(hi.isNull(), lo).when(
        F.col("_len") - lo <= hi - F.col("_len"), lo).otherwise(hi)
    refs = hist.select(*g, "_len", near.alias("_ref"))
    scored = lengths.join(refs, [*g, "_len"]).join(lost, "_x", "left").na.fill(0, [f"_d{m}" for m in orders])
    totals = [F.greatest(F.col("_len") - (m - 1), F.lit(0)) for m in orders]
    score = _bleu([t - F.col(f"_d{m}") for m, t in zip(orders, totals)], totals, F.col("_ref"), F.col("_len"))
    # an empty text, or a text without any other, scores 0
    return scored.groupBy(*g).agg(F.avg(F.when(F.col("_len") > 0, F.coalesce(score, F.lit(0.0))).otherwise(0.0)).alias("self_bleu"))


def _pairwise_mean(df: DataFrame | Corpus, score, group: Sequence[str], text: str, name: str, block: int) -> DataFrame:
    """Mean of score(reference, hypothesis) over ordered pairs of different texts.

    The statistic is defined over all pairs. Equal texts are merged first and weighted, so copies cost
    nothing. The rest is cut into blocks of up to `block` texts and `BLOCK_BYTES`. Every two blocks meet
    once, for both directions, and return one partial sum, so no pair is ever a row and a text
    is sent to each other block once.
    """
    g = list(group)
    rows, split = _tokens(df, text)
    texts = rows.select(*g, F.array_join(split, " ").alias("_x")).groupBy(*g, "_x").agg(F.count(F.lit(1)).alias("_k"))
    weight = F.greatest(F.least(F.octet_length("_x"), F.lit(BLOCK_BYTES)), F.lit(BLOCK_BYTES // block))
    placed = cut(running_offsets(texts, g, ["_x"], weight, "_o", rows.select(*g).count()).withColumn("_b", F.floor(F.col("_o") / BLOCK_BYTES)).drop("_o"))
    counts = placed.groupBy(*g).agg((F.max("_b") + 1).alias("_nb"), F.sum("_k").alias("_n"))
    others = F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)
    meets = F.transform(others, lambda o: F.struct(F.least("_b", o).alias("_lb"), F.greatest("_b", o).alias("_rb"), (F.col("_b") <= o).alias("_left")))
    sent = placed.join(counts, g).select(*g, "_x", "_k", F.inline(meets))
    schema = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in g) + ", part double"

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["_left"]], pdf[~pdf["_left"]]
        own = left["_k"].to_numpy(float)
        if key[-2] == key[-1]:
            part, _ = score(left["_x"].tolist(), left["_x"].tolist())
            total = (part * (np.outer(own, own) - np.diag(own))).sum()
        else:
            weights = np.outer(own, right["_k"].to_numpy(float))
            total = sum((p * weights).sum() for p in score(left["_x"].tolist(), right["_x"].tolist()))
        return pd.DataFrame([[*key[: len(g)], float(total)]], columns=[*g, "part"])

    sums = sent.groupBy(*g, "_lb", "_rb").applyInPandas(meet, schema)
    n = F.col("_n").cast("double")
    return (
        sums.groupBy(*g).agg(F.sum("part").alias("_s")).join(counts, g)
        .select(*g, F.when(n > 1, F.col("_s") / (n * (n - 1))).alias(name))
    )


def _codes(texts: list[str], stem=None) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each token of the texts one after the other, where each text ends, how many there are."""
    split = [t.split(" ") if t else [] for t in texts]
    flat = [w for t in split for w in t]
    code, names = pd.factorize(np.array(flat if stem is None else [stem(w.lower()) for w in flat], object))
    return code.astype(np.int64), np.cumsum([0, *map(len, split)]), len(names)


def _postings(code: np.ndarray, ends: np.ndarray, kinds: int, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order 1..m, the distinct (n-gram, text) with their counts, ordered by n-gram."""
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    gram, at = code, np.arange(len(code))
    for order in range(1, m + 1):
        if order > 1:
            inside = at + order - 1 < ends[owner[at] + 1]
            gram, at = gram[inside], at[inside]
            gram = pd.factorize(gram * kinds + code[at + order - 1])[0].astype(np.int64)
        pair, count = np.unique(gram * (len(ends) - 1) + owner[at], return_counts=True)
        yield pair // (len(ends) - 1), pair % (len(ends) - 1), count


def _bleu_block(left: list[str], right: list[str], n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """BLEU of every right text against every left one as reference, and the other way round.

    Clipped overlaps are the same both ways. Those of one right text with all left ones are summed from the
    postings of its n-grams: which left texts have them, and how often.
    """
    a, b = len(left), len(right)
    code, ends, kinds = _codes([*left, *right])
    size = np.diff(ends).astype(float)
    hits = np.zeros((n, a, b))
    for m, (gram, text, count) in enumerate(_postings(code, ends, kinds, n)):
        is_left = text < a
        lg, lt, lc = gram[is_left], text[is_left], count[is_left]
        order = np.argsort(text[~is_left], kind="stable")
        rg, rt, rc = (x[~is_left][order] for x in (gram, text, count))
        first, last = np.searchsorted(lg, rg, "left"), np.searchsorted(lg, rg, "right")
        cuts = np.searchsorted(rt, a + np.arange(b + 1))
        for j in range(b):
            own = slice(cuts[j], cuts[j + 1])
            f, k = first[own], last[own] - first[own]
            if k.sum():
                at = np.repeat(f - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
                hits[m, :, j] = np.bincount(lt[at], np.minimum(lc[at], np.repeat(rc[own], k)), a)

    def bleu(hyp: np.ndarray, ref: np.ndarray) -> np.ndarray:
        logs = sum(np.log(np.where(hits[m] > 0, hits[m], 0.1) / np.maximum(hyp - m, 1.0)) for m in range(n))
        return np.where(hits[0] > 0, np.exp(np.minimum(0.0, 1 - ref / np.maximum(hyp, 1.0)) + logs / n), 0.0)

    return bleu(size[None, a:], size[:a, None]), bleu(size[:a, None], size[None, a:])


def homogenization_bleu(df: DataFrame | Corpus, group: Sequence[str] = GROUP, ids: Sequence[str] | None = None, text: str = "text",
                        block: int = BLOCK_TEXTS, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Mean BLEU over ordered pairs of different texts. Quadratic by definition: `sample` takes that many texts of a large corpus."""
    return _pairwise_mean(_sampled(df, sample, group, ids, seed), _bleu_block, group, text, "hom_bleu", block)


def _sampled(df: DataFrame | Corpus, sample: int | None, group: Sequence[str], ids: Sequence[str] | None, seed: int) -> DataFrame | Corpus:
    if not sample:
        return df
    rows, ids = (df.words.drop("_t", "_x"), df.ids) if isinstance(df, Corpus) else (df, _ids(df, ids))
    return sample_rows(rows, sample, [*group, *ids], seed)


def _common(references: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common subsequence of every reference with every text.

    The references lie side by side in one long bit vector, a bit for each token and a guard bit that
    stops carries after each reference. A token of a text then takes a few whole-vector operations for all of
    them; bits that turned 0 count the common tokens.
    """
    starts = np.cumsum([0, *[len(r) + 1 for r in references]])
    masks: dict[int, int] = {}
    guard = 0
    for start, r in zip(starts.tolist(), references):
        for i, w in enumerate(r.tolist()):
            masks[w] = masks.get(w, 0) | 1 << (start + i)
        guard |= 1 << (start + len(r))
    free = ((1 << int(starts[-1])) - 1) ^ guard
    out = np.zeros((len(references), len(texts)), np.int64)
    for j, t in enumerate(texts):
        state = free
        for w in t.tolist():
            match = masks.get(w)
            if match is not None:
                met = state & match
                state = ((state + met) | (state - met)) & free
        bits = np.unpackbits(np.frombuffer((state ^ free).to_bytes(int(starts[-1]) // 8 + 1, "little"), np.uint8), bitorder="little")
        seen = np.concatenate([[0], np.cumsum(bits[: int(starts[-1])], dtype=np.int64)])
        out[:, j] = seen[starts[1:]] - seen[starts[:-1]]
    return out


#: References side by side in one bit vector.
ABREAST = 64


def _rouge_block(left: list[str], right: list[str], stem=None) -> tuple[np.ndarray, np.ndarray]:
    """ROUGE-L F1 of every pair, which is the same in both directions."""
    code, ends, _ = _codes([*left, *right], stem or (lambda w: w))
    texts = [code[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    refs, hyps = texts[: len(left)], texts[len(left):]
    common = [_common(refs[i : i + ABREAST], hyps) for i in range(0, len(refs), ABREAST)]
    lcs = np.concatenate(common) if common else np.zeros((0, len(hyps)))
    sizes = np.diff(ends)
    total = sizes[: len(left), None] + sizes[None, len(left):]
    f1 = 2 * lcs / np.maximum(total, 1)  # 2 p q / (p + q) with p = lcs / hypothesis, q = lcs / reference
    return f1, f1


def homogenization_rougel(df: DataFrame | Corpus, group: Sequence[str] = GROUP, ids: Sequence[str] | None = None, text: str = "text",
                          block: int = BLOCK_TEXTS, stem=None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Mean ROUGE-L F1 over ordered pairs of different texts, or of `sample` of them; `stem` maps a token to its stem."""
    def score(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _rouge_block(left, right, stem)

    return _pairwise_mean(_sampled(df, sample, group, ids, seed), score, group, text, "hom_rougel", block)


def diversity_report(df: DataFrame, tag_lexicon: DataFrame | None = None, group: Sequence[str] = GROUP,
                     ids: Sequence[str] | None = None, text: str = "text", n: int = 4, pairwise: bool = True,
                     rouge: bool = False, compression: bool = False, sample: int | None = None) -> DataFrame:
    """One row per group with all statistics; null for those switched off.

    The corpus is tokenized once, its n-grams are counted once, and all statistics read these tables.
    The pairwise ones are quadratic: `sample` says how many texts of the table they take.
    """
    kw, ids = {"group": group, "text": text}, _ids(df, ids)
    corpus = Corpus(df, group, ids, text)
    parts = [mean_length(corpus, group), mattr(corpus, group=group), hdd(corpus, group=group),
             ngram_diversity(corpus, n, group=group), self_repetition(corpus, n), self_bleu(corpus)]
    if compression:
        parts.append(compression_ratio(df, ids=ids, **kw))
    if compression and tag_lexicon is not None:
        parts.append(compression_ratio_pos(df, tag_lexicon, ids=ids, **kw))
    if pairwise:
        parts.append(homogenization_bleu(corpus, group, sample=sample))
    if rouge:
        parts.append(homogenization_rougel(corpus, group, sample=sample))
    wide = reduce(lambda a, b: a.join(b, list(group), "left"), parts)
    return wide.select(*group, *[(F.col(m) if m in wide.columns else F.lit(None)).cast("double").alias(m) for m in REPORT])


def report_rows(wide: DataFrame, name: str = "inst_alias") -> DataFrame:
    """A wide report as rows (alias, metric, value)."""
    return wide.unpivot([name], [c for c in REPORT if c in wide.columns], "metric", "value").withColumnRenamed(name, "alias")


def merge_reports(metrics: DataFrame) -> DataFrame:
    """Rows (alias, metric, value) to one wide, sorted table with fixed columns and arrow headings."""
    wide = metrics.groupBy("alias").pivot("metric", REPORT).agg(F.first("value"))
    return wide.select("alias", *[F.col(c).cast("double").alias(HEADINGS[c]) for c in REPORT]).orderBy("alias")
