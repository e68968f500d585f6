"""Language identification with interpolated Kneser-Ney character models.

A text is the sequence of its words (runs of letters and marks, lower-cased); each word is padded
with blanks and scored character by character from the ORDER - 1 characters before. Counts of
character n-grams per language come from all training rows: tasks count theirs, Spark adds them up.
The lower orders use continuation counts, the discounts come from the counts of counts; every n-gram
counts, whatever their number.

The estimates are never gathered in one place: Spark derives them order by order for the windows of
ORDER characters that occur in the texts, and writes a row of log-probabilities for each window. The
workers hold the rows of the most frequent windows and sum them up for each text; the rest of a text's
windows is joined. Log-probabilities are fixed-point numbers, so sums do not depend on which way a window
takes. A text gets the language of lowest cross-entropy per character. One in APART training texts, copies
included, is not counted but set apart: on these, which the models have not seen, the temperature is fitted (on about
CALIBRATION of them) and the rejection limits are set (on all of them).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import mix, slices, small_batches, spread_join, written

ORDER = 5
#: Windows, about, whose log-probabilities every worker holds; others are joined, with the same result.
HEAD = 1 << 17
#: Log-probabilities are stored as whole numbers of 1 / FIXED.
FIXED = 1 << 26
#: Of so many training texts one is set apart; rows, about, that the temperature is fitted on.
APART, CALIBRATION = 8, 4000
#: Share of the texts set apart that may lie above the limit of their language, before the margin.
FALSE_REJECTIONS = 0.001
#: A text is rejected when its entropy is MARGIN + FEW / sqrt(n) times that limit, of n texts set apart,
MARGIN, FEW = 1.5, 2.0
#: and by the factor 1 + WIDER / n more, for a text of n letters: entropies of short texts vary more.
WIDER = 10
#: Worker memory of word scores; emptied when full.
WORD_CACHE = 50_000
UNKNOWN = "und"


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the code of every word, and the row offsets."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    split = pc.ascii_split_whitespace(clean)
    ends = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py()
    keep = codes != empty if empty >= 0 else np.ones(len(codes), bool)
    seen = np.concatenate([[0], np.cumsum(keep)])
    return coded.dictionary.to_pylist(), codes[keep], seen[ends - ends[0]]


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every window of ORDER characters over the padded words, and windows per word."""
    pad = " " * (ORDER - 1)
    flat = np.frombuffer((pad + f" {pad}".join(words) + " ").encode("utf-32-le"), np.uint32)
    count = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(count + ORDER - 1)[:-1]])
    first = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    return flat[first[:, None] + np.arange(ORDER)], count


def _hash(points: np.ndarray, kind: int) -> np.ndarray:
    """Hash of the rows of a matrix of code points; kind tells n-grams from contexts."""
    out = np.full(len(points), 2 * points.shape[1] + kind, np.uint64)
    for i in range(points.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + points[:, i].astype(np.uint64))
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, c) of the whole task, merged as it goes; a null lang counts as one."""
    total: dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for b in slices(batches, "text"):
        words, codes, ends = _words(b.column("text"))
        if not words:
            continue
        points, count = _windows(words)
        key, at, back = np.unique(_hash(points, 0), return_index=True, return_inverse=True)
        points = points[at]
        owner = np.repeat(np.arange(len(words)), count)
        langs = b.column("lang").dictionary_encode(null_encoding="encode")
        row_lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(ends))
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            times = np.bincount(codes[row_lang == i], minlength=len(words))
            c = np.bincount(back, weights=times[owner], minlength=len(key)).astype(np.int64)
            own = np.flatnonzero(c)
            new = (key[own], points[own], c[own])
            if lang in total:
                k, p, n = (np.concatenate(x) for x in zip(total[lang], new))
                k, first, inv = np.unique(k, return_index=True, return_inverse=True)
                new = (k, p[first], np.bincount(inv, weights=n).astype(np.int64))
            total[lang] = new
    for lang, (_, points, c) in total.items():
        for i in range(0, len(c), 50_000):
            grams = np.ascontiguousarray(points[i : i + 50_000]).view(f"<U{ORDER}")[:, 0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(c[i : i + 50_000])], names=["lang", "gram", "c"])


@dataclass
class Model:
    """The languages by name, and (lang, gram, c) of the training rows."""

    langs: list[str]
    counts: DataFrame

    def log_prob(self, points: np.ndarray) -> np.ndarray:
        """Natural log of each window's last character given the others, one column for each language."""
        grams = ["".join(map(chr, row)) for row in points.tolist()]
        asked = self.counts.sparkSession.createDataFrame([(None, g, 1) for g in grams], self.counts.schema)
        windows = _windows_scored(self.counts.unionByName(asked), self.langs)
        found = {r.gram: r.lp for r in windows.join(F.broadcast(asked.select("gram").distinct()), "gram").collect()}
        return np.array([found[g] for g in grams], np.float64) / FIXED


def _languages(counts: DataFrame) -> list[str]:
    return sorted(r.lang for r in counts.where("lang IS NOT NULL").select("lang").distinct().collect())


def _windows_scored(counts: DataFrame, langs: list[str]) -> DataFrame:
    """(gram, n, lp): every window with its count and its log-probabilities, interpolated Kneser-Ney.

    From rows (lang, gram, c); windows of null lang are scored too, but do not count.
    """
    each = range(len(langs))
    seen = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("c"))), F.lit(0)).alias(f"c{i}") for i, x in enumerate(langs)]
    table = written(counts.groupBy("gram").agg(F.sum("c").alias("n"), *seen), f"grams{ORDER}")
    orders = {ORDER: table}
    for n in range(ORDER - 1, 0, -1):
        # continuation counts: windows that end in the n-gram
        types = [F.count(F.when(F.col(f"c{i}") > 0, 1)).alias(f"c{i}") for i in each]
        orders[n] = written(orders[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(*types), f"grams{n}")
    lower = None
    for n in range(1, ORDER + 1):
        table = orders[n]
        facts = [f(F.col(f"c{i}")).alias(f"{k}{i}") for i in each for k, f in (
            ("one", lambda c: F.count(F.when(c == 1, 1))), ("two", lambda c: F.count(F.when(c == 2, 1))),
            ("some", lambda c: F.count(F.when(c > 0, 1))), ("least", lambda c: F.min(F.when(c > 0, c))))]
        got = table.agg(*facts).first().asDict()
        # an order without any discounted mass must still leave some to the lower ones
        discount = [got[f"one{i}"] / (got[f"one{i}"] + 2 * got[f"two{i}"]) if got[f"one{i}"] else 0.5 for i in each]
        kept = [float(min(d, got[f"least{i}"])) for i, d in enumerate(discount)]
        context = F.substring("gram", 1, n - 1)
        totals = [f.alias(f"{k}{i}") for i in each for k, f in (("sum", F.sum(f"c{i}")), ("types", F.count(F.when(F.col(f"c{i}") > 0, 1))))]
        contexts = table.groupBy(context.alias("context")).agg(*totals)
        rows = table.withColumn("context", context).join(contexts, "context")
        if lower is None:
            below = [F.lit(1.0 / (got[f"some{i}"] + 1)) for i in each]
        else:
            rows = rows.withColumn("tail", F.substring("gram", 2, n - 1)).join(lower, "tail")
            below = [F.col(f"q{i}") for i in each]
        p = [F.when(F.col(f"sum{i}") > 0, (F.greatest(F.col(f"c{i}") - discount[i], F.lit(0.0)) + F.greatest(F.col(f"types{i}") * kept[i], F.lit(1e-6)) * below[i]) / F.col(f"sum{i}"))
             .otherwise(below[i]) for i in each]
        lower = rows.select(F.col("gram").alias("tail"), *[x.alias(f"q{i}") for i, x in enumerate(p)], *(["n"] if n == ORDER else []))
    logs = F.array(*[F.round(F.log(f"q{i}") * FIXED).cast("bigint") for i in each])
    return written(lower.select(F.col("tail").alias("gram"), "n", logs.alias("lp")), "windows")


class _Head:
    """Log-probabilities of the windows that the workers hold: sorted hashes and a column for each language."""

    def __init__(self, windows: DataFrame, langs: list[str]):
        size = windows.count()
        self.whole, self.width = size <= HEAD, len(langs)
        if not self.whole:
            least = windows.approxQuantile("n", [1 - HEAD / size], 0.1 * HEAD / size)[0]
            windows = windows.where(F.col("n") > least)
        got = windows.select("gram", "lp").toArrow()
        points = np.frombuffer("".join(got.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        lp = got.column("lp").combine_chunks().flatten().to_numpy().reshape(-1, self.width)
        self.keys, at = np.unique(_hash(points, 0), return_index=True)
        self.values = lp[at]

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each window, of zeros if it is not held, and whether it is."""
        keys = _hash(points, 0)
        if not len(self.keys):
            return np.zeros((len(keys), self.width), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = self.keys[at] == keys
        return np.where(held[:, None], self.values[at], 0), held

    def words(self, words: list[str], cache: dict[str, tuple]) -> None:
        """Add to the cache of words: sums of the windows held, and the windows that are not."""
        fresh = [w for w in words if w and w not in cache]
        if not fresh:
            return
        points, count = _windows(fresh)
        _, at, back = np.unique(_hash(points, 0), return_index=True, return_inverse=True)
        values, held = self.find(points[at])
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        sums = np.add.reduceat(values[back], first, axis=0)
        rest: list[tuple] = [()] * len(fresh)
        for k in np.flatnonzero(~np.logical_and.reduceat(held[back], first)).tolist():
            own = np.arange(first[k], first[k] + count[k])
            rest[k] = tuple("".join(map(chr, points[j].tolist())) for j in own[~held[back[own]]].tolist())
        if len(cache) + len(fresh) > WORD_CACHE:
            old = {w: cache[w] for w in words if w in cache}
            cache.clear()
            cache.update(old)
        cache.update(zip(fresh, zip(sums, rest)))


def train(rows: DataFrame) -> Model | None:
    """Count rows (id, lang, text); null languages and texts are passed over. None if nothing is left."""
    small_batches(rows.sparkSession)
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = rows.mapInArrow(_count_grams, "lang string, gram string, c bigint")
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "counts")
    langs = _languages(counts)
    return Model(langs, counts) if langs else None


def _sums(rows: DataFrame, windows: DataFrame, langs: list[str]) -> DataFrame:
    """(id, lang, digest, known, letters, chars, s0, s1, ...): sums of the log-probabilities of each text, a column for each language."""
    head = _Head(windows, langs)
    shared = rows.sparkSession.sparkContext.broadcast(head)
    names = ["id", "lang", "digest", "known", "letters", "chars", "sums", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        blank = np.zeros(m.width, np.int64)
        for b in slices(batches, "text"):
            text = b.column("text")
            known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)
            words, codes, ends = _words(text)
            m.words(words, cache)
            table = np.array([cache[w][0] if w else blank for w in words], np.int64).reshape(len(words), m.width)
            length = np.fromiter((len(w) for w in words), np.int64, len(words))
            running = np.vstack([blank, np.cumsum(table[codes], axis=0)])
            letters = np.concatenate([[0], np.cumsum(length[codes])])
            size = np.concatenate([[0], np.cumsum(length[codes] + 1)])
            rest: list[list[dict]] = [[] for _ in range(b.num_rows)]
            odd = [] if m.whole else [i for i, w in enumerate(words) if w and cache[w][1]]
            if odd:
                has = np.zeros(len(words), bool)
                has[odd] = True
                places = np.flatnonzero(has[codes])
                owner = np.searchsorted(ends, places, side="right") - 1
                for row in np.unique(owner).tolist():
                    found = Counter(g for c in codes[places[owner == row]].tolist() for g in cache[words[c]][1])
                    rest[row] = [{"gram": g, "k": k} for g, k in found.items()]
            sums = running[ends[1:]] - running[ends[:-1]]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("lang"), b.column("digest"), known, pa.array(letters[ends[1:]] - letters[ends[:-1]]),
                pa.array(size[ends[1:]] - size[ends[:-1]]), pa.array(sums.tolist(), pa.list_(pa.int64())),
                pa.array(rest, pa.list_(pa.struct([("gram", pa.string()), ("k", pa.int64())])))], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "lang", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")).mapInArrow(
        run, f"id {kind}, lang string, digest binary, known boolean, letters bigint, chars bigint, sums array<bigint>, rest array<struct<gram: string, k: bigint>>")
    out = written(out, "sums")
    shared.destroy()
    own = [F.col("sums")[i] for i in range(len(langs))]
    if not head.whole:
        # the other windows, once for each distinct text
        rest = out.select("digest", F.explode("rest").alias("r")).select("digest", "r.gram", "r.k").distinct()
        more = rest.join(windows.select("gram", "lp"), "gram").groupBy("digest").agg(*[F.sum(F.col("lp")[i] * F.col("k")).alias(f"m{i}") for i in range(len(langs))])
        out = spread_join(out, more, "digest", "left")
        own = [s + F.coalesce(F.col(f"m{i}"), F.lit(0)) for i, s in enumerate(own)]
    return out.select(*names[:6], *[s.alias(f"s{i}") for i, s in enumerate(own)])


def judge(rows: DataFrame) -> DataFrame:
    """(id, digest, lang_pred, score, entropy, rejected) for rows (id, lang, text), trained on those with a language.

    `digest` is the MD5 of the text, on which the other columns depend only. `und`, score 0 and
    rejected for null texts and texts without a letter, and for all texts if nothing can be learnt.
    Equal entropies go to the first language by name. Rejected as well: texts whose entropy is above
    the limit of their language (lang_pred still names the best one); a language without any text set apart
    takes the widest limit of the others. Copies are judged alike. Texts of any length are taken whole; an empty table gives no rows; other columns are
    not read.
    """
    small_batches(rows.sparkSession)
    # by the text, so that copies of a text set apart are not counted either
    apart = F.pmod(F.xxhash64("text"), F.lit(APART)) == 0
    # a language keeps its texts if it had no other
    whole = rows.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.min(apart).alias("all")).where("all").collect()
    apart = apart & ~F.col("lang").isin([r.lang for r in whole]) if whole else apart
    seen = rows.where("text IS NOT NULL").select(F.when(~apart, F.col("lang")).alias("lang"), "text")
    counts = seen.mapInArrow(_count_grams, "lang string, gram string, c bigint")
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "counts")
    langs = _languages(counts)
    if not langs:
        return rows.select("id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    sums = _sums(rows.withColumn("lang", F.when(apart & F.col("lang").isin(langs), F.col("lang"))), _windows_scored(counts, langs), langs)
    h = F.array(*[-F.col(f"s{i}") / (FIXED * F.greatest("chars", F.lit(1))) for i in range(len(langs))])
    got = written(sums.select("id", "lang", "digest", "known", "letters", h.alias("h")).withColumn("low", F.array_min("h")), "entropies")
    got = got.withColumn("best", F.array_position("h", F.col("low")).cast("int"))
    # the texts set apart still have their language here
    learnt = got.where(F.col("lang").isNotNull() & (F.col("letters") > 0))
    # far beyond what texts of the language reach: a text that mixes languages should stay
    tops = {r.best: (MARGIN + FEW / r.n**0.5) * r.top for r in learnt.groupBy("best").agg(
        F.percentile_approx("low", 1 - FALSE_REJECTIONS, 100_000).alias("top"), F.count("*").alias("n")).collect()}
    limits = F.array(*[F.lit(tops.get(i + 1, max(tops.values(), default=float("inf")))) for i in range(len(langs))])
    heat = _heat(learnt, langs)
    near = F.transform("h", lambda x: F.exp((F.col("low") - x) * heat))
    score = 1 / F.aggregate(near, F.lit(0.0), lambda a, x: a + x)
    far = F.col("low") > F.element_at(limits, F.col("best")) * (1 + WIDER / F.greatest("letters", F.lit(1)))
    names = F.array(*[F.lit(x) for x in langs])
    return got.select(
        "id", "digest", F.when(F.col("known"), F.element_at(names, F.col("best"))).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("known"), score).otherwise(0.0).alias("score"),
        F.when(F.col("known"), F.col("low")).alias("entropy"), (~F.col("known") | far).alias("rejected"))


def _heat(learnt: DataFrame, langs: list[str]) -> float:
    """The temperature that explains a sample of the training rows best."""
    every = max(1, learnt.count() // CALIBRATION)
    got = learnt.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("lang", "h").toArrow()
    if not got.num_rows:
        return 20.0
    h = np.array(got.column("h").to_pylist())
    truth = np.array([langs.index(x) for x in got.column("lang").to_pylist()])
    gap = h - h.min(axis=1, keepdims=True)

    def loss(heat: float) -> float:
        e = np.exp(-heat * gap)
        return float(-np.log(np.maximum(e[np.arange(len(h)), truth] / e.sum(axis=1), 1e-12)).mean())

    return min((1.0, 2.0, 5.0, 10.0, 20.0, 40.0), key=loss)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows whose id's fold is not 0 and predict all: (id, held_out, lang_pred, score, entropy, rejected).

    Rows with a null id are neither trained on nor held out. Repeated rows count each. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learn = F.when(fold(F.col("id")) != 0, F.col("lang"))
    held_out = F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out")
    return judge(rows.withColumn("lang", learn)).select("id", held_out, "lang_pred", "score", "entropy", "rejected")
