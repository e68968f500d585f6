"""Merkle manifest of a dataset: a tree over the rows of each group, a tree over the group roots, proofs of every row.

Nodes are numbered inside their group. A pivot takes LEVELS levels at once: conditional aggregates spread
the FANOUT**LEVELS nodes below one ancestor into slot columns. Concatenated columns are hashed to the
nodes above; leaving out the own slot's column gives the siblings. Proofs travel down the same
pivots, so a long one is moved once for each pivot and completed for the rows below it in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.llm.common import broadcast_if_small, written

FANOUT, LEVELS = 3, 2
STEP = "struct<l:string,r:string>"


def row_hash(cols: Sequence[Column]) -> Column:
    """Digest of a row: every value as UTF-8 byte count, colon and value, or `-` for null."""
    parts = []
    for c in cols:
        text = c.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add `pos` (0-based along `order` inside the group) and `n` (rows of the group).

    Rows are dealt by ranges of (group, order), so that a group of any size spreads over tasks; the
    rows of a group in each range, a small table, give the shifts. Rows equal in all of these are
    dealt apart by a number of their own, and are numbered as they come.
    """
    tied = written(rows.withColumn("_tie", F.monotonically_increasing_id()), "tied")
    by = [group, *order, "_tie"]
    dealt = written(tied.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), "dealt")
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    runs = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(runs.select(
        group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(group)).alias("n")), "shifts")
    return dealt.join(broadcast_if_small(shifts), [group, "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _node(children: list[Column]) -> Column:
    """Digest of a node over its children; null if it has none."""
    return F.when(children[0].isNotNull(), F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in children]), 256))


def pivot(nodes: DataFrame, keep: Sequence[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(g, pos, n0.., s0_0.., s1_0.., .., top): the nodes below every ancestor `levels` higher, and the levels between.

    `n<l>` is the number of nodes of the group on level l; a group of one node goes up as it is.
    The `keep` columns of the slots below are in k0..
    """
    width = fanout**levels
    slot = F.col("pos") % width
    def only(j, value):
        return F.max(F.when(slot == j, value))

    out = nodes.groupBy("g", F.expr(f"pos div {width}").alias("_up")).agg(
        F.first("n").alias("n0"), *[only(j, F.col("h")).alias(f"s0_{j}") for j in range(width)],
        *([only(j, F.struct(*keep)).alias(f"k{j}") for j in range(width)] if keep else []))
    for level in range(1, levels + 1):
        count = fanout ** (levels - level)
        alone = F.col(f"n{level - 1}") == 1
        below = [[F.col(f"s{level - 1}_{j * fanout + i}") for i in range(fanout)] for j in range(count)]
        out = out.withColumns({f"s{level}_{j}": F.when(alone, below[j][0]).otherwise(_node(below[j])) for j in range(count)}
                              | {f"n{level}": F.ceil(F.col(f"n{level - 1}") / fanout)})
    return out.withColumnRenamed("_up", "pos").withColumnRenamed(f"s{levels}_0", "top")


def climb(nodes: DataFrame, keep: Sequence[str] = (), fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The pivots from the leaves (g, pos, n, h) up, each written, and (g, h) of the roots."""
    pivots: list[DataFrame] = []
    while True:
        pivots.append(written(pivot(nodes, () if pivots else keep, fanout, levels), "pivot"))
        nodes = pivots[-1].select("g", "pos", F.col(f"n{levels}").alias("n"), F.col("top").alias("h"))
        if nodes.where("n > 1").isEmpty():
            return pivots, nodes.select("g", "h")


def _steps(j: int, fanout: int, levels: int) -> Column:
    """Siblings to the left and right of slot j on each of the levels: all slot columns of its parent but its own."""
    steps = []
    for level in range(levels):
        at = j // fanout**level
        first = at // fanout * fanout
        left, right = range(first, at), range(at + 1, first + fanout)
        cells = [F.concat(F.lit(""), *[F.coalesce(F.col(f"s{level}_{i}"), F.lit("")) for i in side]) for side in (left, right)]
        steps.append(F.when(F.col(f"n{level}") > 1, F.struct(cells[0].alias("l"), cells[1].alias("r"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull()).cast(f"array<{STEP}>")


def descend(pivots: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Leaves (g, pos, h, k, path, carried columns): `tops` has (g, path) of every root and columns that go down with it."""
    carried = [c for c in tops.columns if c not in ("g", "path")]
    width, at = fanout**levels, tops.withColumn("pos", F.lit(0).cast("bigint"))
    for depth, table in zip(range(len(pivots) - 1, -1, -1), reversed(pivots)):
        kept = depth == 0 and "k0" in table.columns
        slots = F.array(*[
            F.when(F.col(f"s0_{j}").isNotNull(), F.struct(
                (F.col("pos") * width + j).alias("pos"), F.col(f"s0_{j}").alias("h"),
                *([F.col(f"k{j}").alias("k")] if kept else []), _steps(j, fanout, levels).alias("steps"))) for j in range(width)])
        spread = table.join(at, ["g", "pos"]).select("g", "path", *carried, F.explode(F.filter(slots, lambda s: s.isNotNull())).alias("c"))
        at = spread.select("g", "c.pos", F.concat("c.steps", "path").alias("path"), *carried, *(["c.h", "c.k"] if kept else ["c.h"] if depth == 0 else []))
        if depth:
            at = written(at, "paths")
    return at


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, extra: dict[str, Column] | None = None,
             fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, path, extra): every row's leaf, its group's root, the root and the proof [(l, r)].

    Rows of a group are leaves in ascending order of the id (null first), then leaf; `fanout` consecutive nodes
    become the digest of their concatenated digests until one is left. Group roots, ordered by group (null
    first, then bytewise), likewise give the root. Rows that repeat an id or a whole row are leaves of
    their own. Values may be null, empty or of any length: `leaf` is computed once, only digests move. A table
    with no rows gives no rows. `extra` names more columns to compute from each row and keep.
    """
    extra = extra or {}
    group = F.col(group_col).cast("string")
    leaves = rows.select(
        F.col(id_col).alias("id"), F.when(group.isNull(), "").otherwise(F.concat(F.lit("s"), group)).alias("g"), leaf.alias("h"),
        *[c.alias(f"x_{name}") for name, c in extra.items()])
    kept = ["id", *[f"x_{name}" for name in extra]]
    pivots, roots = climb(numbered(leaves, "g", ["id", "h"]), kept, fanout, levels)
    upper = numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("group"), "h"), "g", ["group"])
    above, top = climb(upper, ["group"], fanout, levels)
    tops = top.select("g", F.array().cast(f"array<{STEP}>").alias("path"), F.col("h").alias("root"))
    subroots = written(descend(above, tops, fanout, levels).select(F.col("k.group").alias("g"), "path", "root", F.col("h").alias("subroot")), "subroots")
    out = descend(pivots, subroots, fanout, levels)
    return out.select(F.col("k.id").alias("id"), F.col("h").alias("leaf"), "subroot", "root", "path", *[F.col(f"k.x_{name}").alias(name) for name in extra])
