"""Document fingerprints by a randomised edit embedding.

One random walk, shared by all texts, copies a text into a longer one: at every step it writes the
character it stands on and, by a coin that depends on step and character, stays or goes on. Texts of
small edit distance get copies of small Hamming distance, for walks meet again after an edit. The
fingerprint samples the copy: a symbol of four bits from one step in each stretch of 2**level steps,
with the level set by the length, so that there are about SAMPLES / 2 to SAMPLES of them. The steps
sampled at a level are among those of the level below, so fingerprints of any lengths compare.

Bands of adjacent samples bring similar documents together; the likeness of fingerprints verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import broadcast_if_small, mix, slices, small_batches, written

SAMPLES = 512
#: Coins repeat after so many steps; characters share coins in so many classes.
PERIOD, CLASSES = 4096, 64
#: Walks go side by side while there are so many, then one by one.
LANES = 64
#: Samples of a band.
BAND = 8
#: Members of a band that are compared in one piece, about.
GROUP = 500
#: Bytes of text in one ordered part, about, and parts at most.
PART_BYTES, PARTS = 32 << 20, 50_000
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(1)
def _jumps() -> tuple[np.ndarray, list[list[int]]]:
    """Steps that the walk stays on a character of a class from a step on: until its first coin that says go."""
    i = np.arange(CLASSES * PERIOD, dtype=np.uint64)
    go = (mix(i + np.uint64(0x5EED)) & np.uint64(1)).astype(bool).reshape(CLASSES, PERIOD)
    go[:, PERIOD - 1] = True
    at = np.where(go, np.arange(PERIOD), PERIOD)
    after = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    table = (after - np.arange(PERIOD) + 1).astype(np.int64)
    return table.ravel(), table.tolist()


def _classes(points: np.ndarray) -> np.ndarray:
    return (mix(points.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % CLASSES


def _symbols(points: np.ndarray) -> np.ndarray:
    return (mix(points.astype(np.uint64) + np.uint64(0xC0FFEE)) & np.uint64(15)).astype(np.uint8)


@lru_cache(64)
def _steps(level: int, to: int = 0) -> np.ndarray:
    """Of each stretch of 2**level steps, the sampled one, as a stretch number at level `to`."""
    at = np.arange(4 * SAMPLES, dtype=np.uint64)
    for n in range(level, to, -1):
        at = 2 * at + (mix(at + np.uint64(n << 48)) & np.uint64(1))
    return at.astype(np.int64)


def level_of(chars: int) -> int:
    """Least level at which the copy, of about two steps a character, has no more than SAMPLES stretches."""
    level = 0
    while 2 * chars > SAMPLES << level:
        level += 1
    return level


def walk(kinds: list[np.ndarray], start: list[int]) -> list[np.ndarray]:
    """For each text, as classes of characters, the step at which each character begins, and the end."""
    flat_table, rows = _jumps()
    out = [np.empty(len(k) + 1, np.int64) for k in kinds]
    for o, s in zip(out, start):
        o[0] = s
    order = sorted(range(len(kinds)), key=lambda i: -len(kinds[i]))
    size = [len(kinds[i]) for i in order]
    together = size[LANES - 1] if len(size) >= LANES else 0
    if together:
        # all lanes up to the length of the LANES-th longest text, one column for each character
        ends = np.concatenate([[0], np.cumsum([min(n, together) for n in size])])
        flat = np.concatenate([kinds[i][:together] for i in order])
        steps, at = np.empty(len(flat), np.int64), np.array([start[i] for i in order], np.int64)
        live = np.searchsorted(-np.array(size), -np.arange(1, together + 1), side="right")
        first = ends[:-1]
        for c, n in enumerate(live.tolist()):
            where = first[:n] + c
            own = at[:n]
            own += flat_table[flat[where] * PERIOD + (own & (PERIOD - 1))]
            steps[where] = own
        for k, i in enumerate(order):
            out[i][1 : 1 + min(size[k], together)] = steps[ends[k] : ends[k + 1]]
    for i in order:
        if len(kinds[i]) <= together:
            break
        p, own = int(out[i][together]), []
        for c in kinds[i][together:].tolist():
            p += rows[c][p & 4095]
            own.append(p)
        out[i][together + 1 :] = own
    return out


def sample(points: np.ndarray, steps: np.ndarray) -> str:
    """Fingerprint: two hex digits of the level, then one for each sampled step of the copy."""
    level = level_of(len(points))
    at = _steps(level)
    at = at[: np.searchsorted(at >> level, (int(steps[-1]) + (1 << level) - 1) >> level)]
    at = at[at < steps[-1]]
    own = _symbols(points[np.searchsorted(steps, at, side="right") - 1])
    return f"{level:02x}" + _HEX[own].tobytes().decode()


def likeness(a: str, b: str) -> float:
    """Share of equal samples at the coarser level of the two; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (m, x), (n, y) = ((int(f[:2], 16), np.frombuffer(f[2:].encode(), np.uint8)) for f in (a, b))
    if m > n:
        (m, x), (n, y) = (n, y), (m, x)
    if m < n:
        at = _steps(n, m)
        x = x[at[at < len(x)]]
    both, most = min(len(x), len(y)), max(len(x), len(y))
    return float((x[:both] == y[:both]).sum() / most) if most else 1.0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprint_texts(texts: list[str]) -> list[str]:
    points = [_points(t) for t in texts]
    return [sample(p, s) for p, s in zip(points, walk([_classes(p) for p in points], [0] * len(points)))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text; null is the empty text, whose fingerprint is "00". Other columns aren't read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = fingerprint_texts(pc.fill_null(b.column("text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, fingerprint string")


def similar(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) from rows (id, fingerprint): links that tie all similar documents that share a band.

    Bands are BAND adjacent samples, taken at the own level and the next, so that texts on either side of
    a level meet. Members of a band meet in blocks of about GROUP, each block every other; pairs that the
    links of a block already tie are passed over, the others are compared. So the documents tied are those
    of all pairs, but no group becomes all its pairs. Equal fingerprints are tied to their smallest id
    beforehand. Null ids are passed over, rows that repeat an id are compared each. An empty table gives no links;
    columns but id and fingerprint are not read.
    """
    rows = prints.where("id IS NOT NULL")
    classes = written(rows.groupBy("fingerprint").agg(F.min("id").alias("first")), "classes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, marks = [], [], []
            for i, f in zip(b.column("first").to_pylist(), b.column("fingerprint").to_pylist()):
                level, own = int(f[:2], 16), f[2:]
                at = _steps(level + 1, level)
                coarse = "".join(own[k] for k in at[at < len(own)].tolist())
                for n, s in ((level, own), (level + 1, coarse)):
                    for k in range(0, max(1, len(s) - BAND + 1), BAND):
                        ids.append(i)
                        keys.append(f"{n}:{k}:{s[k : k + BAND]}")
                        marks.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(marks, pa.string())], names=["id", "key", "mark"])

    keyed = written(classes.select("first", "fingerprint").mapInArrow(bands, "id bigint, key string, mark string"), "bands")
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    big = sizes.where(F.col("n") > GROUP).select("key", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks"))
    met = keyed.join(sizes.select("key"), "key", "left_semi").join(broadcast_if_small(big), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "mark", "block")

    def links(members: list[tuple], within: bool) -> Iterator[tuple[int, int, float]]:
        root = list(range(len(members)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, (a, x, p) in enumerate(members):
            for j in range(i + 1, len(members)):
                b, y, q = members[j]
                if a != b and (within or p != q) and top(i) != top(j) and (score := likeness(x, y)) >= least:
                    root[top(j)] = top(i)
                    yield a, b, score

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []

        def done():
            found = list(links(members, group[1] == group[2]))
            columns = list(zip(*found)) if found else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "likeness"])

        for batch in batches:
            for *key, i, f, block in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "id", "mark", "block"))):
                if key != group:
                    if len(members) > 1:
                        yield done()
                    group, members = key, []
                members.append((i, f, block))
        if len(members) > 1:
            yield done()

    dealt = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id", "mark")
    pairs = dealt.mapInArrow(verify, "a bigint, b bigint, likeness double").distinct()
    copies = rows.join(classes, "fingerprint").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("likeness")).distinct()
    return pairs.unionByName(copies)


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text has the last floor(n / 2) code points replaced by the first as many, or all, of the
    next row by descending id; the last row's next is the first. Null texts are empty, a null id is the
    smallest, rows of one id go by text. A single row is its own next. An empty table gives no rows. Texts of any length
    are walked whole. Other columns are not read. Texts are shuffled once, into ranges of ids of about PART_BYTES;
    the row before a range comes along as a guest, so that no row misses its next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(low)).alias("key"), F.col(id_col).cast("bigint").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = rows.select("key")
    parts = int(max(1, min(PARTS, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))))
    cuts = sorted({int(x) for x in keys.approxQuantile("key", [i / parts for i in range(1, parts)], 1 / (20 * parts))}) if parts > 1 else []
    bounds = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.searchsorted(bounds.value, b.column("key").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=[*b.schema.names, "part"])

    # the largest key of each range, and the range above that has it as a guest (no more rows than ranges)
    tops = keys.distinct().mapInArrow(place, "key bigint, part int").groupBy("part").agg(F.max("key").alias("key")).toArrow()
    top = sorted(zip(tops.column("part").to_pylist(), tops.column("key").to_pylist()))
    guest_of = {key: top[(i + 1) % len(top)][0] for i, (_, key) in enumerate(top)}
    guests = spark.sparkContext.broadcast(guest_of)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "text", "part", "guest"]
        for b in slices(batches, "text"):
            key = b.column("key").to_numpy()
            part = np.searchsorted(bounds.value, key).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(np.zeros(len(key), bool))], names=names)
            also = [i for i, k in enumerate(key.tolist()) if k in guests.value]
            if also:
                own = b.take(pa.array(also))
                to = pa.array([guests.value[key[i]] for i in also], pa.int32())
                yield pa.RecordBatch.from_arrays([*own.columns, to, pa.array([True] * len(also))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, mark = None, "", ""
        for b in slices(batches, "text"):
            texts, guest, owner = b.column("text").to_pylist(), b.column("guest").to_pylist(), b.column("part").to_pylist()
            points = [_points(t) for t in texts]
            kinds = [_classes(p) for p in points]
            steps = walk(kinds, [0] * len(texts))
            prints = [sample(p, s) for p, s in zip(points, steps)]
            follow, ahead = [], []
            for i, t in enumerate(texts):
                if owner[i] != part:
                    part, before, mark = owner[i], "", ""
                follow.append(before)
                ahead.append(mark)
                before, mark = t, prints[i]
            real = [i for i, g in enumerate(guest) if not g]
            half = [len(points[i]) - len(points[i]) // 2 for i in real]
            tails = [_points(follow[i][: len(points[i]) // 2]) for i in real]
            moved = walk([_classes(t) for t in tails], [int(steps[i][h]) for i, h in zip(real, half)])
            edited = [sample(np.concatenate([points[i][:h], t]), np.concatenate([steps[i][:h], m])) for i, h, t, m in zip(real, half, tails, moved)]
            digest = [hashlib.sha256((texts[i][:h] + follow[i][: len(points[i]) // 2]).encode()).hexdigest() for i, h in zip(real, half)]
            own = [prints[i] for i in real]
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(real, pa.int64())), pa.array([len(points[i]) for i in real], pa.int64()), pa.array(digest, pa.string()),
                pa.array(own, pa.string()), pa.array(edited, pa.string()), pa.array([likeness(x, y) for x, y in zip(own, edited)], pa.float64()),
                pa.array([likeness(x, ahead[i]) for x, i in zip(own, real)], pa.float64()),
            ], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = rows.mapInArrow(deal, "key bigint, id bigint, text string, part int, guest boolean")
    # guests go first in their range; of several rows with the top key the last by text is next to it
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.desc("guest"), "key", F.desc("text"))
    return dealt.select("id", "text", "part", "guest").mapInArrow(
        run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
