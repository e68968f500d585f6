"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed to k-grams; of every `span - k + 1` k-grams in a row the smallest hash is kept. Two
texts that share `span` words share all k-grams of one such window, hence its smallest: every shared
span is found. Documents whose kept hashes meet none of the benchmark are done after one scan
without a shuffle of texts. For the others all positions of the benchmark's k-grams are looked up, and
each hit is extended: along its diagonal the words of item and document are compared one by one, and
runs of equal words that are as long as a window mark what they cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import broadcast_if_small, written

SPAN = 13
GRAM = 8
#: Item words that are broadcast at most; more are joined by shuffle.
BROADCAST_WORDS = 1_000_000
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEPT = "0123456789abcdefghijklmnopqrstuvwxyz"
_OTHER = "".join(chr(i) for i in range(128) if chr(i) not in _KEPT + _LETTERS + " ")


def word_array(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), _LETTERS + _OTHER, _LETTERS.lower() + " " * len(_OTHER))
    return F.array_remove(F.split(plain, " "), "")


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.size(a))


def _paired(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add g<n>, the hashes of n words from every position, for the lengths; the last ones of a text are of fewer words."""
    df = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    n = 1
    while n * 2 <= max(lengths):
        df = df.withColumn(f"g{2 * n}", _paired(F.col(f"g{n}"), _shifted(F.col(f"g{n}"), n)))
        n *= 2
    for want in lengths:
        if f"g{want}" in df.columns:
            continue
        out, done = None, 0
        for bit in (1 << i for i in range(want.bit_length() - 1, -1, -1)):
            if want & bit:
                part = _shifted(F.col(f"g{bit}"), done)
                out = part if out is None else _paired(out, part)
                done += bit
        df = df.withColumn(f"g{want}", out)
    return df


def _smallest(a: Column, width: int) -> Column:
    """Minimum of `width` elements from every position on, by windows of doubled width."""
    n = 1
    while 2 * n <= width:
        a, n = F.zip_with(a, _shifted(a, n), lambda x, y: F.least(x, y)), 2 * n
    return a if n == width else F.zip_with(a, _shifted(a, width - n), lambda x, y: F.least(x, y))


def winnowed(df: DataFrame, span: int = SPAN, gram: int = GRAM, short: list[int] | None = None) -> DataFrame:
    """Add `kept`: the winnowed hashes of `words`, and all grams of the lengths in `short`."""
    short = short or []
    df = _grams(df, [gram, *short])
    kept = F.array_distinct(_smallest(F.col(f"g{gram}"), span - gram + 1))
    for n in short:
        kept = F.concat(kept, F.array_distinct(f"g{n}"))
    return df.withColumn("kept", kept)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, text_hash, n_words, n_hit, items) per document: xxhash64 of the text, words, words inside a window of an item, sorted ids of those items.

    A window is `span` words of an item in a row, or all words of a shorter one. Null and blank texts
    have no words; blank items no windows. Rows come back as often as they are given; a repeated id
    keeps its texts apart. Items with a null id are listed as the empty string, repeated items once.
    Other columns are not read. Empty tables give no rows or no hits.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), word_array(F.col(item_text_col).cast("string")).alias("words"))
    items = written(items.where(F.size("words") > 0).distinct().select("*", F.xxhash64("item", "words").alias("piece"), F.size("words").alias("m")), "items")
    short = sorted(r[0] for r in items.where(F.col("m") < span).select("m").distinct().collect())  # at most span - 1 numbers
    total = items.agg(F.sum("m")).first()[0] or 0
    marked = winnowed(items, span, gram, short)
    long_kept = marked.where(F.col("m") >= span)
    # positions of the kept k-grams of long items; a short item is one gram at its start
    places = (long_kept.select("piece", F.posexplode(f"g{gram}").alias("q", "h"))
              .join(long_kept.select("piece", F.explode(_smallest(F.col(f"g{gram}"), span - gram + 1)).alias("h")).distinct(), ["piece", "h"], "left_semi"))
    for n in short:
        places = places.unionByName(marked.where(F.col("m") == n).select("piece", F.lit(0).alias("q"), F.element_at(f"g{n}", 1).alias("h")))
    places = written(places, "places")
    known = broadcast_if_small(places.select("h").distinct())

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = winnowed(rows.select("id", F.xxhash64("text").alias("t"), word_array(F.col("text")).alias("words")), span, gram, short)
    each = hashed.select("id", "t", F.size("words").alias("n_words"), F.size("kept").alias("f"), F.explode_outer("kept").alias("h"))
    met = each.join(known.withColumn("found", F.lit(1)), "h", "left")
    scanned = met.groupBy("id", "t", "n_words", "f").agg(F.count("*").alias("rows"), F.max("found").alias("found"))
    scanned = written(scanned.select("id", "t", F.col("n_words").cast("bigint").alias("n_words"),
                                     (F.col("rows") / F.greatest("f", F.lit(1))).cast("bigint").alias("copies"), "found"), "scanned")

    wanted = broadcast_if_small(scanned.where("found = 1").select(F.col("id").alias("i"), F.col("t").alias("u")))
    texts = rows.withColumn("t", F.xxhash64("text"))
    texts = texts.join(wanted, texts.id.eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left_semi")
    # one row per document under one key, so that repeated rows are worked on once
    near = written(texts.select(F.xxhash64("id", "text").alias("k"), "id", "t", word_array(F.col("text")).alias("words")).dropDuplicates(["id", "t"]), "near")
    lengths = _grams(near.select("id", "t", "k", "words"), [gram, *short])
    seen = None
    for n in sorted({gram, *short}):
        part = lengths.select("id", "t", F.posexplode(f"g{n}").alias("p", "h"))
        seen = part if seen is None else seen.unionByName(part)
    spots = F.broadcast(places) if total <= BROADCAST_WORDS else places
    lines = seen.join(spots, "h").select("id", "t", "piece", (F.col("p") - F.col("q")).alias("d")).distinct()

    sides = items.select("piece", "item", F.col("words").alias("own"), "m")
    lines = lines.join(F.broadcast(sides) if total <= BROADCAST_WORDS else sides, "piece")
    both = lines.alias("l").join(near.alias("n"), F.col("l.id").eqNullSafe(F.col("n.id")) & (F.col("l.t") == F.col("n.t"))).select(
        "n.id", "n.t", "l.piece", "l.item", "l.m", "l.d", F.greatest(F.col("l.d"), F.lit(0)).alias("from"),
        F.slice("n.words", F.greatest(F.col("l.d"), F.lit(0)) + 1, F.col("l.m") + F.least(F.col("l.d"), F.lit(0))).alias("a"),
        F.slice("l.own", 1 - F.least(F.col("l.d"), F.lit(0)), F.col("l.m")).alias("b"))
    need = F.least("m", F.lit(span))
    same = both.withColumn("same", F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))).drop("a", "b")
    equal = same.select("id", "t", "piece", "item", "d", need.alias("need"), "from", F.posexplode("same").alias("o", "s")).where("s")
    line = Window.partitionBy("id", "t", "piece", "d").orderBy("o")
    runs = (equal.withColumn("run", F.col("o") - F.row_number().over(line))
            .groupBy("id", "t", "piece", "item", "d", "need", "run").agg(F.min(F.col("from") + F.col("o")).alias("a"), F.max(F.col("from") + F.col("o")).alias("b"))
            .where(F.col("b") - F.col("a") + 1 >= F.col("need")))
    runs = written(runs.select("id", "t", "item", "a", "b"), "runs")
    covered = runs.select("id", "t", F.explode(F.sequence("a", "b")).alias("p")).distinct().groupBy("id", "t").agg(F.count("*").alias("n_hit"))
    listed = runs.groupBy("id", "t").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = covered.alias("c").join(listed.alias("i"), F.col("c.id").eqNullSafe(F.col("i.id")) & (F.col("c.t") == F.col("i.t"))).select(
        F.col("c.id").alias("hid"), F.col("c.t").alias("ht"), "n_hit", "items")
    out = scanned.join(hits, scanned.id.eqNullSafe(F.col("hid")) & (F.col("t") == F.col("ht")), "left")
    return out.select("id", F.col("t").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_")).drop("_")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
