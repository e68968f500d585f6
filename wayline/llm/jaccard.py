"""N-gram Jaccard join with signature trees.

Each distinct shingle set gets a signature: its size and a bitmap with about one bit per shingle.
Sets that can reach the threshold must share one of their first n - ceil(t n) + 1 shingles in any
fixed order; the order used puts frequent shingles last, then goes by hash. Within the sets that
share such a shingle a signature tree is built: inner nodes hold the OR of their bitmaps and the
range of their sizes, and a dual traversal drops node pairs whose largest possible overlap is too
small. What survives is compared exactly.

Hot groups: equal sets count once from the start. Each set is first compared with one partner, the
best connected set of the group that it meets most often, so that a mass of near copies becomes one
component; the traversal passes over node pairs inside one component. Larger groups use bitmaps of
several bits per shingle, whose bounds are close to the true overlap. Groups above BLOCK members are
cut into blocks by size, and only block pairs whose size ranges and components allow a new link are
traversed, each in a task of its own. No group is ever sorted in one task: sets of a frequent shingle are
dealt by their digest too, and members are numbered through ranges. No pair is dropped, nothing is capped:
the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import broadcast_if_small, components, shingle_sets, slices, small_batches, written

#: Frequent shingles put last in the order (8 bytes each); only the order depends on it, never the result.
FREQUENT = 65_536
#: A shingle is frequent when this many sets of one batch hold it.
LOCAL_COPIES = 8
#: A set is compared with its best partner early if they share this many keys; others wait for the traversal.
EARLY_KEYS = 3
#: Groups with more sets than this use the wide bitmaps.
WIDE_FROM = 32
#: Bits per shingle of a wide bitmap, at least.
WIDE = 4
#: Sets of one group that a single tree holds.
BLOCK = 4096
#: Members of large groups that one range holds, about, while they are numbered.
RANGE_ROWS = 65_536
FAN = 8


def _bitmap(own: np.ndarray, per: int = 1) -> bytes:
    """`per` bits per shingle and up, a power of two wide, so that halves can be folded onto each other."""
    bits = max(8, 1 << (per * len(own) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _set_digest(own: np.ndarray, seed: int) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes(), seed)).astype(np.int64))


def _signatures(ids: str, text: str, width: int):
    """Rows of kind 0: id, size, digests and bitmap of a document; of kind 1: a locally frequent shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            sizes, one, two, maps, wide, fresh = [], [], [], [], [], {}
            for own in shingle_sets(b.column(text), width):
                d = _set_digest(own, 1)
                sizes.append(len(own))
                one.append(d)
                two.append(_set_digest(own, 2))
                maps.append(_bitmap(own) if len(own) else b"")
                wide.append(_bitmap(own, WIDE) if len(own) else b"")
                fresh.setdefault(d, own)
            every = np.sort(np.concatenate(list(fresh.values())))
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1], [True]])) if len(every) else np.zeros(1, int)
            count = np.diff(edge)
            hot = count >= LOCAL_COPIES
            m = int(hot.sum())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * n + [1] * m, pa.int32()),
                pa.concat_arrays([b.column(ids).cast(pa.int64()), pa.nulls(m, pa.int64())]),
                pa.array(sizes + count[hot].tolist(), pa.int64()),
                pa.array(one + every[edge[:-1][hot]].astype(np.int64).tolist(), pa.int64()),
                pa.array(two + [0] * m, pa.int64()),
                pa.array(maps + [None] * m, pa.binary()),
                pa.array(wide + [None] * m, pa.binary()),
            ], names=["kind", "id", "n", "dig", "dig2", "bits", "wide"])

    return run


def _prefixes(text: str, width: int, num: int, den: int, frequent: np.ndarray):
    """Rows (key, part, dig, n): the first shingles of every set in the common order, equal sets of a batch once.

    `part` deals the sets of a frequent shingle over tasks: their digest, null for any other shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            seen, keys, late_keys, digs, sizes, counts = set(), [], [], [], [], []
            for own in shingle_sets(b.column(text), width):
                n = len(own)
                d = _set_digest(own, 1) if n else 0
                if not n or d in seen:
                    continue
                seen.add(d)
                take = n - (num * n + den - 1) // den + 1
                head = own[: 2 * take + 64]
                rare = head[~_within(head, frequent)][:take]
                early = take
                if len(rare) < take:
                    late = _within(own, frequent)
                    early = min(take, n - int(late.sum()))
                    rare = np.concatenate([own[~late], own[late]])[:take]
                keys.append(rare)
                late_keys.append(np.arange(take) >= early)
                counts.append(take)
                digs.append(d)
                sizes.append(n)
            if keys:
                dig = np.repeat(np.array(digs, np.int64), counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(dig, mask=~np.concatenate(late_keys)),
                    pa.array(dig),
                    pa.array(np.repeat(np.array(sizes, np.int32), counts)),
                ], names=["key", "part", "dig", "n"])

    return run


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class _Node:
    """OR of the bitmaps below, range of sizes, most shingles beyond the bits, range of components."""

    __slots__ = ("bits", "low", "high", "extra", "first", "last", "kids", "dig")

    def __init__(self, kids, dig=None, bits=0, n=0, extra=0, comp=0):
        self.kids, self.dig = kids, dig
        if kids is None:
            self.bits, self.low, self.high, self.extra, self.first, self.last = bits, n, n, extra, comp, comp
        else:
            self.bits = 0
            for k in kids:
                self.bits |= k.bits
            self.low, self.high = min(k.low for k in kids), max(k.high for k in kids)
            self.extra = max(k.extra for k in kids)
            self.first, self.last = min(k.first for k in kids), max(k.last for k in kids)


def _fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def _tree(members: list[tuple], to: int) -> _Node:
    """members: (component, n, dig, width, bits); neighbours in that order share a leaf."""
    level = []
    for comp, n, dig, width, bits in sorted(members, key=lambda m: m[:3]):
        folded = _fold(bits, width, to)
        level.append(_Node(None, dig, folded, n, n - folded.bit_count(), comp))
    while len(level) > 1:
        level = [_Node(level[i : i + FAN]) for i in range(0, len(level), FAN)]
    return level[0]


def _dual(left: _Node, right: _Node, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets of different components that the bitmaps and sizes don't rule out."""
    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        if a.first == a.last == b.first == b.last or a.high * den < num * b.low or b.high * den < num * a.low:
            continue
        most = min((a.bits & b.bits).bit_count() + min(a.extra, b.extra), a.high, b.high)
        if most * (num + den) < num * (a.low + b.low):
            continue
        if a.kids is None and b.kids is None:
            if a.dig != b.dig:
                yield (a.dig, b.dig) if a.dig < b.dig else (b.dig, a.dig)
        elif a is b:
            stack += [(a.kids[i], a.kids[j]) for i in range(len(a.kids)) for j in range(i, len(a.kids)) if i != j or a.kids[i].kids]
        elif b.kids is None or a.kids is not None and a.high - a.low >= b.high - b.low:
            stack += [(k, b) for k in a.kids]
        else:
            stack += [(a, k) for k in b.kids]


def _join_sides(left: list[tuple], right: list[tuple] | None, num: int, den: int) -> set[tuple[int, int]]:
    """Trees for each bitmap width; a width meets itself and, folded, the next larger ones that sizes allow."""

    def by_width(side):
        out: dict[int, list] = {}
        for m in side:
            out.setdefault(m[3], []).append(m)
        return out

    found: set[tuple[int, int]] = set()
    one = by_width(left)
    two = one if right is None else by_width(right)
    for w, a in one.items():
        for v, b in two.items():
            if right is None and v < w:
                continue
            low, high = (a, b) if w <= v else (b, a)
            if max(m[1] for m in low) * den < num * min(m[1] for m in high):
                continue
            to = min(w, v)
            tree = _tree(a, to)
            found.update(_dual(tree, tree if right is None and v == w else _tree(b, to), num, den))
    return found


def _traverse(num: int, den: int):
    """Rows sorted by (key, i, j): each run is one tree join; side 1 holds the rows of the second block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, left, right, out = None, [], [], set()

        def close():
            if cell is not None:
                out.update(_join_sides(left, right if cell[1] != cell[2] else None, num, den))

        def flush():
            a = sorted(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in a], pa.int64()), pa.array([p[1] for p in a], pa.int64())], names=["a", "b"])

        for b in batches:
            d = b.to_pydict()
            for key, i, j, side, dig, n, comp, bits in zip(*(d[c] for c in ("key", "i", "j", "side", "dig", "n", "comp", "bits"))):
                if (key, i, j) != cell:
                    close()
                    cell, left, right = (key, i, j), [], []
                    if len(out) > 50_000:
                        yield flush()
                (right if side else left).append((comp, n, dig, 8 * len(bits), int.from_bytes(bits, "little")))
        close()
        yield flush()

    return run


def _screen(num: int, den: int):
    """Drop pairs that the wide bitmaps rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, w, m, v in zip(*(b.column(c).to_pylist() for c in ("na", "wa", "nb", "wb"))):
                to = 8 * min(len(w), len(v))
                x, y = _fold(int.from_bytes(w, "little"), 8 * len(w), to), _fold(int.from_bytes(v, "little"), 8 * len(v), to)
                most = min((x & y).bit_count() + min(n - x.bit_count(), m - y.bit_count()), n, m)
                keep.append(most * (num + den) >= num * (n + m))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(text: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            sets = list(shingle_sets(b.column(text), width))
            yield pa.RecordBatch.from_arrays([
                pa.array([_set_digest(s, 1) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], names=["dig", "own"])

    return run


def _compare(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices([batch], "own"):
                keep = []
                for x, y in zip(b.column("own"), b.column("other")):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = int(_within(p, q).sum())
                    keep.append(common * den >= num * (len(p) + len(q) - common))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(many: DataFrame) -> DataFrame:
    """Add `block`, of BLOCK members each, to written rows (key, dig, n, comp): numbered by key, n, comp, dig.

    Rows are sorted in ranges, written with the number of their range, and counted on from the rows of the key in
    earlier ranges: a key of any size spreads over tasks, and the blocks do not depend on the ranges.
    """
    order = ["key", "n", "comp", "dig"]
    ranges = many.count() // RANGE_ROWS + 1
    many = written(many.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = many.groupBy("key", "range").agg(F.count("*").alias("rows")).select(
        "key", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "range").orderBy(*order[1:])
    at = F.col("start") + F.col("inside") - 1
    return (many.withColumn("inside", F.row_number().over(inside)).join(start, ["key", "range"])
            .withColumn("block", F.floor(at / BLOCK).cast("int")).drop("range", "inside", "start"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                       num: int = 80, den: int = 100) -> DataFrame:
    """(id, n, component): set size and smallest id reachable by links of similarity >= num / den, one row per row.

    Null and blank texts have n = 0 and stand alone; texts of fewer words than `width` are one shingle.
    Equal sets are linked. Rows with a null id get the smallest id of their component (null when it has
    none); repeated ids keep their rows and share the links of all their texts. An empty table gives an
    empty result; other columns are not read. Sets are named by a 64-bit digest, checked by a second one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = written(rows.mapInArrow(_signatures("id", "text", width),
                                    "kind int, id bigint, n bigint, dig bigint, dig2 bigint, bits binary, wide binary"), "signatures")
    top = first.where("kind = 1").groupBy("dig").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "dig").limit(FREQUENT).select("dig").collect()
    frequent = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    own = first.where("kind = 0 AND n > 0")
    clash = F.raise_error(F.lit("two shingle sets with one digest"))
    reps = own.groupBy("dig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"),
                                  F.min("dig2").alias("x"), F.max("dig2").alias("y"))
    reps = written(reps.where(F.when(F.col("x") == F.col("y"), True).otherwise(clash.cast("boolean"))).drop("x", "y"), "sets")

    keys = rows.select("text").mapInArrow(_prefixes("text", width, num, den, frequent), "key bigint, part bigint, dig bigint, n int")
    # of the sets with a rare key only those matter that have another one of a fitting size: the next by size tells;
    # frequent keys keep all their sets, which lie apart
    by_size = Window.partitionBy("key", "part").orderBy("n")
    fitting = (F.lag("n").over(by_size) * den >= F.col("n") * num) | (F.col("n") * den >= F.lead("n").over(by_size) * num)
    fitting = F.col("part").isNotNull() | F.coalesce(fitting, F.lit(False))
    shared = written(keys.withColumn("fits", fitting).where("fits").select("key", "part", "dig", "n").distinct().drop("part"), "shared")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of set digests whose texts reach the threshold: by wide bitmaps, then exactly."""
        marks = reps.select("dig", "n", "wide")
        sides = pairs.distinct()
        for x in "ab":
            sides = sides.join(marks.select(F.col("dig").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")), x)
        pairs = written(sides.mapInArrow(_screen(num, den), "a bigint, b bigint"), "candidates")
        needed = pairs.select(F.col("a").alias("dig")).union(pairs.select("b")).distinct()
        ids = reps.join(needed, "dig", "left_semi").select(F.col("rep").alias("id"))
        texts = rows.join(broadcast_if_small(ids), rows.id.eqNullSafe(ids.id), "left_semi").select("text")
        sets = written(texts.mapInArrow(_sets("text", width), "dig bigint, own binary"), "shingles")
        return written(
            pairs.join(sets.withColumnRenamed("dig", "a"), "a")
            .join(sets.select(F.col("dig").alias("b"), F.col("own").alias("other")), "b")
            .mapInArrow(_compare(num, den), "a bigint, b bigint").distinct(), "links")

    fits = (F.col("n") * den >= F.col("low") * num) & (F.col("low") * den >= F.col("n") * num)
    sizes = shared.groupBy("key").agg(F.count("*").alias("k"))
    degree = shared.join(sizes, "key").groupBy("dig").agg(F.sum("k").alias("degree"))
    centre = (shared.join(degree, "dig").groupBy("key").agg(F.max(F.struct("degree", "dig", "n")).alias("c"))
              .select("key", F.col("c.dig").alias("a"), F.col("c.n").alias("low")))
    meets = shared.join(centre, "key").where(fits & (F.col("dig") != F.col("a"))).groupBy("dig", "a").agg(F.count("*").alias("times"))
    ties = (meets.where(F.col("times") >= EARLY_KEYS).groupBy(F.col("dig").alias("b"))
            .agg(F.max(F.struct("times", "a")).alias("t")).select(F.col("t.a").alias("a"), "b"))
    tied = verified(ties)
    comp = components(tied)

    grouped = shared.join(comp.withColumnRenamed("node", "dig"), "dig", "left").withColumn("comp", F.coalesce("component", "dig"))
    open_keys = grouped.groupBy("key").agg(F.count("*").alias("k"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key", "k")
    grouped = written(grouped.join(open_keys, "key").select("key", "dig", "n", "comp", "k"), "open")
    few = grouped.where(F.col("k") <= BLOCK).select("key", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "dig", "n", "comp")
    many = _blocks(grouped.where(F.col("k") > BLOCK))
    span = many.groupBy("key", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    l, r = span.alias("l"), span.alias("r")
    cells = (l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.block") <= F.col("r.block"))
                    & (F.col("l.n1") * den >= F.col("r.n0") * num)
                    & ~((F.col("l.c0") == F.col("l.c1")) & (F.col("r.c0") == F.col("r.c1")) & (F.col("l.c0") == F.col("r.c0"))))
             .select(F.col("l.key").alias("key"), F.col("l.block").alias("i"), F.col("r.block").alias("j")))
    sided = cells.select("key", "i", "j", F.lit(0).alias("side"), F.col("i").alias("block")).union(
        cells.where("i <> j").select("key", "i", "j", F.lit(1).alias("side"), F.col("j").alias("block")))
    cut = many.join(sided, ["key", "block"]).select("key", "k", "i", "j", "side", "dig", "n", "comp")
    every = few.union(cut)
    small = every.where(F.col("k") <= WIDE_FROM).join(reps.select("dig", "bits"), "dig")
    large = every.where(F.col("k") > WIDE_FROM).join(reps.select("dig", F.col("wide").alias("bits")), "dig")
    members = small.unionByName(large).drop("k")
    traversed = (members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                 .mapInArrow(_traverse(num, den), "a bigint, b bigint"))
    links = tied.unionByName(verified(traversed))
    named = components(links)

    whole = reps.select("dig", "rep").join(named.withColumnRenamed("node", "dig"), "dig", "left").withColumn("component", F.coalesce("component", "dig"))
    lowest = whole.groupBy("component").agg(F.min("rep").alias("low"))
    whole = written(whole.join(lowest, "component").select("dig", "low"), "classes")
    alone = first.where("kind = 0 AND n = 0").select("id", "n", F.col("id").alias("component"))
    return own.select("id", "n", "dig").join(whole, "dig").select("id", "n", F.col("low").alias("component")).unionByName(alone)
