"""Ranks over all texts against direct products, and how much the cell bounds settle."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayline.operators import retrieval as R
from wayline.operators.ordered import running_offsets

SCHEMA = "pair_id long, v array<float>, t array<float>"


def brute(rows, order, kind):
    """(above, before, level) of every id, over all texts in the given order."""
    v, t = (np.array([r[k] for r in rows], np.float32).astype(float) for k in (1, 2))
    if kind == "cosine":
        v, t = (m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None] for m in (v, t))
    s = -((v[:, None] - t[None]) ** 2).mean(2) if kind == "mse" else v @ t.T
    out = {}
    for i in range(len(rows)):
        tie = np.abs(s[i] - s[i, i]) <= 1e-11 * max(1.0, abs(s[i, i]))
        out[order[i]] = (int(((s[i] > s[i, i]) & ~tie).sum()), sum(bool(tie[j]) and order[j] < order[i] for j in range(len(rows))), int(tie.sum()) - 1)
    return out


@pytest.mark.parametrize("kind", ["dot", "cosine", "mse"])
def test_ranks_match_direct_products(spark, kind):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(260):
        v = rng.integers(-2, 3, 6)  # whole numbers: many exact ties
        t = np.array([1, 0, 2, 0, 0, 1]) if i % 3 == 0 else rng.integers(-2, 3, 6)  # a third of the texts is the same
        rows.append((i, v.astype(float).tolist(), t.astype(float).tolist()))
    rows.append((260, [0.0] * 6, [0.0] * 6))
    f = spark.createDataFrame(rows, SCHEMA)
    place = running_offsets(f.withColumn("_g", F.lit(0)), ["_g"], ["pair_id"], F.lit(1), "pos")
    order = {r["pair_id"]: r["pos"] for r in place.collect()}
    want = brute(rows, order, kind)
    for block in (16, 1000):
        got = {r["pos"]: (r["above"], r["before"], r["level"]) for r in R.matched_rank(f, ["pair_id"], kind=kind, block=block).collect()}
        assert got == want
    assert R.matched_rank(f.limit(0), ["pair_id"], kind=kind).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v, t = rng.normal(size=(40, 8)), rng.normal(size=(300, 8))
    centres = t[:7]
    cell = R._squares(t, centres).argmin(1)
    radius = np.array([np.linalg.norm(t[cell == c] - centres[c], axis=1).max() for c in range(7)])
    for kind in ("dot", "mse"):
        low, high = R.cell_bounds(v, centres, radius, kind, 1.5)
        s = R._scores(v, t, kind, 1.5)
        assert (s >= low[:, cell] - 1e-9).all() and (s <= high[:, cell] + 1e-9).all()


def _copies(spark, n, block):
    """Cells that a video is sent to, on texts in tight groups."""
    rng = np.random.default_rng(n)
    middles = rng.normal(size=(40, 16))
    which = rng.integers(0, 40, n)
    t, v = (middles[which] + rng.normal(size=(n, 16)) * 0.05 for _ in range(2))
    f = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(v, t))], "pos long, v array<double>, t array<double>")
    rows = f.withColumn("own", R.similarity("v", "t", "dot"))
    centres = t[: -(-n // block)]
    cells = R.text_cells(rows, centres, "dot").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for c in cells:
        size[c["cell"]], radius[c["cell"]] = c["n"], c["r"]
    return R.settle(rows, centres, radius, size, "dot", float(np.exp(R.LOGIT_SCALE))).agg(F.avg(F.size("cells"))).first()[0], n / block


def test_bounds_settle_most_cells(spark):
    for n in (2000, 8000):
        sent, blocks = _copies(spark, n, 16)
        assert sent < blocks / 5


def test_vectors_of_slices():
    a = pa.array([[9.0, 9.0], [3.0, 4.0], [0.0, 0.0]]).slice(1)
    assert R._matrix(a, "cosine").tolist() == [[0.6, 0.8], [0.0, 0.0]]
