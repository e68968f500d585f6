"""Sequence operators against plain definitions; blocked plans against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import actions as A
from wayline.operators import descriptions as D
from wayline.operators import frames as FR
from wayline.operators import motion as MO
from wayline.operators import ordered as O

KEY = ["episode_id"]


def aba(seq, values):
    out = list(seq)
    for i in range(1, len(out) - 1):
        if out[i - 1] == out[i + 1] != out[i] and out[i - 1] in values:
            out[i] = out[i - 1]
    return out


def majority(seq, strict):
    out, i = list(seq), 0
    while i < len(out):
        j = i
        while j < len(out) and out[j] in (2, 3):
            j += 1
        run = out[i:j]
        if run:
            a, b = run.count(2), run.count(3)
            if a != b or not strict:
                out[i:j] = [2 if a > b else 3 if b > a else run[0]] * len(run)
        i = max(j, i + 1)
    return out


def runs(seq):
    out, i = [], 0
    while i < len(seq):
        j = i
        while j + 1 < len(seq) and seq[j + 1] == seq[i]:
            j += 1
        out.append((seq[i], i, j, j - i + 1, (i + j) // 2))
        i = j + 1
    return out


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(7)
    out = {}
    for e in range(120):
        n = rng.choice([1, 2, 3, 7, 8, 9, 25, 40])
        out[e] = [rng.choice((1, 2, 3)) for _ in range(n)]
    out[500] = [1, 2] * 20 + [1]
    out[501] = [2] * 30 + [3] * 31
    out[502] = [1] * 37
    return out


@pytest.fixture(scope="module")
def df(spark, seqs):
    rows = [(e, i, a, float(i)) for e, s in seqs.items() for i, a in enumerate(s)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "episode_id long, frame_idx long, action int, value double").repartition(7).cache()


def lists(out, col="action"):
    got = {}
    for r in out.collect():
        got.setdefault(r["episode_id"], []).append((r["frame_idx"], r[col]))
    return {e: [v for _, v in sorted(x)] for e, x in got.items()}


@pytest.mark.parametrize("block", [None, 8])
@pytest.mark.parametrize("values", [(1, 2, 3), (1,), (2, 3)])
def test_smooth_aba(df, seqs, values, block):
    assert lists(A.smooth_aba(df, KEY, values, block=block)) == {e: aba(s, values) for e, s in seqs.items()}


@pytest.mark.parametrize("block", [None, 8])
@pytest.mark.parametrize("strict", [True, False])
def test_turn_majority(df, seqs, strict, block):
    assert lists(A.smooth_turn_majority(df, KEY, strict, block=block)) == {e: majority(s, strict) for e, s in seqs.items()}


@pytest.mark.parametrize("block", [None, 8])
def test_runs(df, seqs, block):
    got = {}
    for r in A.action_runs(df, KEY, block=block).collect():
        got.setdefault(r["episode_id"], []).append((r["action"], r["head"], r["tail"], r["length"], r["middle"]))
    assert {e: sorted(x, key=lambda y: y[1]) for e, x in got.items()} == {e: runs(s) for e, s in seqs.items()}


def rows(x):
    return sorted(tuple(r) for r in x.collect())


@pytest.mark.parametrize("make", [
    lambda d, b: A.smooth_single_turn(d, KEY, block=b),
    lambda d, b: A.key_frames(d, KEY, block=b),
    lambda d, b: A.append_stop(d, KEY, block=b),
    lambda d, b: D.trailing_window(d, 4, KEY, "value", block=b),
    lambda d, b: D.dedup_adjacent(d, KEY, "action", block=b),
    lambda d, b: FR.frame_pairs(d, KEY, item="value", block=b),
    lambda d, b: MO.dead_reckoning(d, KEY, block=b).select("episode_id", "pose_idx", F.round("x", 9), F.round("y", 9), "heading"),
    lambda d, b: D.similar_runs(d.withColumn("vec", F.array(F.col("action").cast("double"), F.lit(1.0))), KEY, threshold=0.95, block=b),
])
def test_blocked_equals_plain(df, make):
    assert rows(make(df, 8)) == rows(make(df, None))


def test_number_rows_with_hot_keys(spark):
    data = [(0 if i % 3 else i % 5, i * 7 % 1000, f"n{i}") for i in range(1000)]
    t = spark.createDataFrame(data, "k long, at long, name string")
    plain = O.number_rows(t, ["k"], ["at", "name"], F.floor(F.col("at") / 50))
    hot = O.number_rows(t, ["k"], ["at", "name"], F.floor(F.col("at") / 50), hot_rows=100)
    assert rows(plain) == rows(hot)
    assert O.sequence_block(t, ["k"], hot_rows=100) == O.BLOCK and O.sequence_block(t, ["k"]) is None


def test_merge_frames_aug(df, seqs):
    want = set()
    for e, s in seqs.items():
        i, f = 0, 2
        while i < len(s) - 2:
            if i + f < len(s) and len(set(s[i:i + f + 1])) == 1:
                want.add((e, i, i + f, s[i]))
            i += f + 1
    assert set(rows(FR.merge_frames_aug(df, KEY, f=2))) == want


def test_append_stop_needs_labels(spark):
    t = spark.createDataFrame([(0, 0, None), (0, 1, 1), (0, 2, None)], "episode_id long, frame_idx long, action int")
    with pytest.raises(Exception, match="fewer labels"):
        A.append_stop(t, KEY).collect()


def test_training_class_rejects_stop(spark):
    from wayline.functions.actions import training_class

    with pytest.raises(Exception, match="stop"):
        spark.createDataFrame([(0,)], "a int").select(training_class("a")).collect()


def test_natural_order(spark):
    names = ["10_0.jpg", "9_0.jpg", "2_10.jpg", "2_9.jpg", "a1.jpg"]
    t = spark.createDataFrame([(0, n) for n in names], "k long, name string")
    got = [r["name"] for r in FR.frame_order(t, ["k"]).orderBy("frame_idx").collect()]
    assert got == ["2_9.jpg", "2_10.jpg", "9_0.jpg", "10_0.jpg", "a1.jpg"]


def test_thin_rejects_faster_target(df):
    with pytest.raises(ValueError):
        FR.thin_fps(df, 10, 20)


def test_long_assembly_goes_through_blocks(spark):
    t = spark.range(100).select(F.lit(1).alias("episode_id"), F.col("id").alias("frame_idx"), F.col("id").cast("string").alias("description"))
    got = D.assemble(t.repartition(5), KEY, block=8).first()["summary"]
    assert got == "\n".join(str(i) for i in range(100))


def test_rand_frames_stay_in_order_and_range(spark):
    t = spark.createDataFrame([(i, i + 1, 2.0) for i in range(60)], "video_id long, vlen long, fps double")
    got = {}
    for r in FR.sample_frames(t, "rand", 8).collect():
        got.setdefault(r["video_id"], []).append((r["pos"], r["frame"]))
    for v, x in got.items():
        frames = [f for _, f in sorted(x)]
        assert len(frames) == 8 and frames == sorted(frames) and 0 <= frames[0] and frames[-1] <= v
        assert len(set(frames)) == min(8, v + 1)


@pytest.mark.parametrize("digits,rows", [(3, 65536), (1, 1000), (1, 5)])
def test_offsets_over_levels_of_slices(spark, monkeypatch, digits, rows):
    """One, two and three levels of slices give the running sums of the hash order."""
    import hashlib

    monkeypatch.setattr(O, "SLICE_DIGITS", digits)
    monkeypatch.setattr(O, "SLICE_ROWS", rows)
    data = [(g, i, (i * 7) % 11) for g in ("a", "b") for i in range(700 if g == "a" else 3)]
    assert O.slice_levels(len(data)) == {(3, 65536): 1, (1, 1000): 1, (1, 5): 2}[(digits, rows)] and O.slice_levels(10**13) >= 3
    got = {(r["g"], r["i"]): r["offset"] for r in O.running_offsets(spark.createDataFrame(data, "g string, i int, n int"), ["g"], ["i"], F.col("n")).collect()}
    want = {}
    for g in ("a", "b"):
        at = 0
        for _, i, n in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for h, i, n in data if h == g):
            want[g, i], at = at, at + n
    assert got == want


def test_large_tables_get_more_tasks(spark, monkeypatch):
    """What a task sorts is bounded by rows; later steps along the same key add no exchange."""
    from wayline.operators import ordered as O

    monkeypatch.setattr(O, "TASK_ROWS", 10)
    df = spark.range(300).select((F.col("id") % 40).alias("k"), (F.col("id") * 7919 % 1009).alias("t"))
    out = O.is_last(O.number_rows(df, ["k"], ["t"], F.col("t")), ["k"])
    assert out.rdd.getNumPartitions() == 30
    want = {}
    for k, t in sorted((i % 40, i * 7919 % 1009) for i in range(300)):
        want.setdefault(k, []).append(t)
    rows = out.collect()
    assert sorted((r["k"], r["frame_idx"], r["t"]) for r in rows) == sorted((k, i, t) for k, ts in want.items() for i, t in enumerate(ts))
    assert all(r["_last"] == (r["frame_idx"] == len(want[r["k"]]) - 1) for r in rows)
