"""Episode folders, corpora and tables written and read back; models and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from wayline.operators import models as M
from wayline.plans import flows
from wayline.sources import files as S
from wayline.streaming import live


@pytest.fixture()
def root(tmp_path):
    base = tmp_path / "data" / "src"
    for split, ep, ext, n in (("val", "e1", "jpg", 12), ("val", "e2", "png", 3), ("test", "e3", "jpg", 2)):
        d = base / split / ep
        (d / "rgb").mkdir(parents=True)
        (d / "action").mkdir()
        (d / "inst_a").mkdir()
        for i in range(n):
            (d / "rgb" / f"{i}_0.{ext}").write_bytes(bytes([i]))
        if ep == "e1":
            (d / "rgb" / "0_0.png").write_bytes(b"x")
        name = "action.json" if ep == "e2" else "0.json"
        (d / "action" / name).write_text(json.dumps([1] * (n - 1) + [0]))
        (d / "inst_a" / "0.txt").write_text(f"Walk in {ep}.\nStop.")
        info = {"actions": ["stop"], "actions_compact": {"0": "Turn left ", "10": "stop"}, "scenes": {"0": "hall", "10": None},
                "objects": {"0": "Door", "10": "Chair"}, "summary": "s", "instruction": f"go {ep}"}
        (d / "inst_a" / "0.info").write_text(json.dumps(info, indent=1))
    return str(base)


def test_scans(spark, root):
    f = S.scan_frames(spark, root)
    got = {r["episode_id"]: (r["n"], r["last"]) for r in f.groupBy("episode_id").agg(F.count("*").alias("n"), F.max_by("name", "frame_idx").alias("last")).collect()}
    assert got == {"e1": (12, "11_0.jpg"), "e2": (3, "2_0.png"), "e3": (2, "1_0.jpg")}
    body = S.scan_frames(spark, root, content=True).where("episode_id = 'e1' and frame_idx = 5").first()["content"]
    assert bytes(body) == bytes([5])
    a = S.scan_action_labels(spark, root)
    assert a.groupBy("episode_id").agg(F.sum("action").alias("s")).orderBy("episode_id").collect() == [("e1", 11), ("e2", 2), ("e3", 1)]
    t = S.scan_instructions(spark, root, ["val", "test"], "inst_a").orderBy("episode_id").collect()
    assert [(r["source"], r["split"], r["episode_id"], r["inst_id"]) for r in t] == [("src", "val", "e1", "0"), ("src", "val", "e2", "0"), ("src", "test", "e3", "0")]
    assert t[0]["text"] == "Walk in e1.\nStop."
    i = S.scan_infos(spark, root, ["val"], "inst_a").orderBy("episode_id").collect()
    assert len(i) == 2 and i[0]["actions_compact"] == {"0": "Turn left ", "10": "stop"} and i[0]["scenes"]["10"] is None


def test_keys_with_blanks(spark, tmp_path):
    base = tmp_path / "my data" / "a+b source" / "my split" / "episode 100%"
    for folder, name, text in (("rgb", "0.jpg", "x"), ("rgb", "1.jpg", "y"), ("action", "0.json", "[1, 0]"), ("inst a", "0.txt", "go"), ("inst a", "0.info", '{"summary": "s"}')):
        (base / folder).mkdir(parents=True, exist_ok=True)
        (base / folder / name).write_text(text)
    root = str(tmp_path / "my data" / "a+b source")
    want = ("a+b source", "my split", "episode 100%")
    joined = S.scan_frames(spark, root).join(S.scan_action_labels(spark, root), ["source", "split", "episode_id", "frame_idx"]).collect()
    assert [(r["source"], r["split"], r["episode_id"]) for r in joined] == [want] * 2
    for r in (S.scan_instructions(spark, root, ["my split"], "inst a").first(), S.scan_infos(spark, root, ["my split"], "inst a").first()):
        assert (r["source"], r["split"], r["episode_id"]) == want and r["inst_alias"] == "inst a"


def test_judging(spark, root):
    infos = S.scan_infos(spark, root, ["val", "test"], "inst_a")
    M.register("judge", "always", lambda prompts: ["<7>" if "[Information]\nturn left; stop" in p else "no idea" for p in prompts])
    row = flows.consistency(infos, "always").first()
    assert (row["action"], row["scene"], row["object"]) == (7.0, 5.0, 5.0)
    scored = flows.judge(infos, "always")
    assert {r["info"] for r in scored.collect()} == {"turn left; stop", "", "door; chair"}
    cache = scored.where(F.col("info_key").contains("e1")).select("info_key", "info_type", F.lit(1.0).alias("score"))
    assert flows.consistency(infos, "always", cache).first()["action"] == pytest.approx((1 + 7 + 7) / 3)


def test_corpora(spark, tmp_path):
    with gzip.open(tmp_path / "e.json.gz", "wt") as f:
        json.dump({"episodes": [{"instruction": {"instruction_text": "a"}}, {"instruction": {"instruction_text": "b"}}]}, f)
    (tmp_path / "l.json").write_text(json.dumps([{"instructions": ["x", "y"]}, {"instructions": ["z"]}]))
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        for lang, text in (("en-US", "p"), ("hi-IN", "q"), ("en-IN", "r")):
            f.write(json.dumps({"language": lang, "instruction": text}) + "\n")
    texts = lambda d: sorted(r["text"] for r in d.collect())
    assert texts(S.scan_corpus(spark, str(tmp_path / "e.json.gz"), "episodes")) == ["a", "b"]
    assert texts(S.scan_corpus(spark, str(tmp_path / "l.json"), "lists")) == ["x", "y", "z"]
    assert texts(S.scan_corpus(spark, str(tmp_path / "r.jsonl.gz"), "lines", "en-")) == ["p", "r"]


def test_sinks(spark, root, tmp_path):
    frames = S.scan_action_labels(spark, root)
    S.write_key_frames(frames.where("frame_idx % 2 = 0"), str(tmp_path / "k"))
    got = spark.read.json(str(tmp_path / "k")).where("episode_id = 'e2'").first()
    assert got["frame_idx"] == [0, 2]
    S.write_actions(frames, str(tmp_path / "a"), "vo")
    S.write_actions(frames, str(tmp_path / "a"), "dino")
    assert {r["alias"] for r in spark.read.json(str(tmp_path / "a")).select("alias").distinct().collect()} == {"vo", "dino"}
    work = S.expand_outputs(frames.select("source", "split", "episode_id").distinct(), "inst_b", 2)
    S.write_instructions(work.where("episode_id = 'e1'").withColumn("text", F.lit("t")), str(tmp_path / "i"))
    S.write_instructions(work.withColumn("text", F.lit("u")), str(tmp_path / "i"))
    S.write_instructions(work.withColumn("inst_alias", F.lit("inst_c")).withColumn("text", F.lit("v")), str(tmp_path / "i"))
    back = S.scan_instructions(spark, None, ["val", "test"], "inst_b", str(tmp_path / "i")).collect()
    assert sorted((r["episode_id"], r["inst_id"], r["text"]) for r in back) == [
        ("e1", "0", "t"), ("e1", "1", "t"), ("e2", "0", "u"), ("e2", "1", "u"), ("e3", "0", "u"), ("e3", "1", "u")]
    assert S.scan_instructions(spark, root, ["val"], "inst_a", str(tmp_path / "i")).count() == 2
    infos = S.scan_infos(spark, None, ["val"], "inst_c", str(tmp_path / "i"))
    assert infos.count() == 4 and infos.columns == S.scan_infos(spark, root, ["val"], "inst_a").columns
    S.write_actions(frames.where("episode_id = 'e3'").withColumn("episode_id", F.lit("e4")), str(tmp_path / "a"), "vo")
    assert {r["episode_id"] for r in spark.read.json(str(tmp_path / "a")).where("alias = 'vo'").collect()} == {"e1", "e2", "e3", "e4"}
    S.write_key_frames(frames.where("episode_id = 'e3'").withColumn("episode_id", F.lit("e5")), str(tmp_path / "k"))
    assert {r["episode_id"] for r in spark.read.json(str(tmp_path / "k")).collect()} == {"e1", "e2", "e3", "e5"}
    S.write_metrics(S.metric_rows(spark.createDataFrame([(1.0, 2.0)], "a double, b double")), str(tmp_path / "m"), "inst_b", "matching", ["val", "test"])
    assert {(r["metric"], r["value"], r["splits"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("a", 1.0, "val_test"), ("b", 2.0, "val_test")}
    t = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 10.0, 5, 2)], S.TIMING)
    S.append_timings(t, str(tmp_path / "t"))
    S.append_timings(t, str(tmp_path / "t"))
    assert S.timing_summary(S.scan_timings(spark, str(tmp_path / "t"))).first()["episodes"] == 2
    v = spark.createDataFrame([("s", "val", "e", "0", "v", [1.0, 2.0])], "source string, split string, episode_id string, inst_id string, side string, vec array<float>")
    S.write_features(v, str(tmp_path / "f"))
    assert S.scan_features(spark, str(tmp_path / "f")).first()["feature_id"] == "s@val@e@0"


SUB = {"userId": "u1", "submissionTime": "2025-01-02T03:04:05.000Z", "config": {"allowMultipleChoices": True},
       "answers": {f"p{i}": {"0": ["a"], "1": ["a", "b"]} for i in range(5)}}


def test_submissions(spark, tmp_path):
    from wayline.operators import survey as SV

    log = tmp_path / "log"
    log.mkdir()
    bad = {**SUB, "userId": "u2", "answers": {"p0": {"0": [], "1": ["a"]}}}
    (log / "1.jsonl").write_text(json.dumps(SUB) + "\n" + json.dumps(bad) + "\n")
    votes = SV.explode_answers(S.scan_submissions(spark, str(log)))
    got = {(r["question"], r["system"]): (r["votes"], r["share"]) for r in SV.vote_tally(votes, 3).collect()}
    assert got == {("0", "a"): (5, 1.0), ("1", "a"): (5, 1.0), ("1", "b"): (5, 1.0)}
    assert SV.vote_tally(votes, 2).count() == 0
    q = (live.stream_votes(S.scan_submissions(spark, str(log), True)).writeStream.format("memory").queryName("votes").outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert {(r["question"], r["system"], r["votes"]) for r in spark.table("votes").collect()} == {("0", "a", 5), ("1", "a", 5), ("1", "b", 5)}


def test_stream_actions_keeps_state(spark, tmp_path):
    """Frames arrive in any order, over two runs; a frame waits for its predecessor."""
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    schema = "episode_id string, frame_idx long, item string"

    def run(patience=None):
        f = spark.readStream.schema(schema).json(str(src))
        s = live.stream_actions(f, lambda a, b: [x + y for x, y in zip(a, b)], ["episode_id"], batch=2, patience_ms=patience)
        with live.keyed_state(spark):
            q = s.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
            q.awaitTermination()
        return {(r["episode_id"], r["frame_idx"]): r["action"] for r in spark.read.parquet(out).collect()}

    def put(name, rows):
        (src / name).write_text("".join(json.dumps({"episode_id": e, "frame_idx": i, "item": x}) + "\n" for e, i, x in rows))

    put("1.json", [("e", 1, "b"), ("e", 4, "e"), ("g", 0, "x"), ("e", 2, "c"), ("h", 7, "late")])
    assert run() == {("g", 0): None, ("e", 2): "bc"}
    put("2.json", [("e", 5, "f"), ("g", 1, "y"), ("e", 0, "a")])
    assert run() == {("g", 0): None, ("g", 1): "xy", ("e", 0): None, ("e", 1): "ab", ("e", 2): "bc", ("e", 5): "ef"}
    put("3.json", [("e", 3, "d"), ("h", 0, "z")])
    assert run() == {("g", 0): None, ("g", 1): "xy", ("e", 0): None, ("e", 1): "ab", ("e", 2): "bc", ("e", 3): "cd", ("e", 4): "de", ("e", 5): "ef", ("h", 0): None}


def test_stream_actions_lose_patience(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text("".join(json.dumps({"episode_id": "e", "frame_idx": i, "item": x}) + "\n" for i, x in ((0, "a"), (3, "d"), (5, "f"))))
    f = spark.readStream.schema("episode_id string, frame_idx long, item string").json(str(src))
    with live.keyed_state(spark):
        q = (live.stream_actions(f, lambda a, b: [x + y for x, y in zip(a, b)], ["episode_id"], patience_ms=1).writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start(out))
        try:
            for _ in range(150):
                got = {r["frame_idx"]: r["action"] for r in spark.read.schema("frame_idx long, action string").parquet(out).collect()} if q.lastProgress and (tmp_path / "out" / "_spark_metadata").exists() else {}
                if len(got) == 3:
                    break
                q.awaitTermination(0.3)
        finally:
            q.stop()
    assert got == {0: None, 3: "ad", 5: "df"}


def test_votes_over_submissions(spark, tmp_path):
    """A rater counts from the submission that completes the answers to the one that breaks a rule."""
    log, where = tmp_path / "log", str(tmp_path / "tally")
    log.mkdir()

    def tally(name, *subs):
        lines = [{"userId": u, "submissionTime": "2025-01-02T03:04:05.000Z", "config": {"allowMultipleChoices": True}, "answers": a} for u, a in subs]
        (log / name).write_text("".join(json.dumps(x) + "\n" for x in lines))
        live.follow_votes(S.scan_submissions(spark, str(log), True), where, 3, 2, 1)
        return {(r["question"], r["system"]): (r["votes"], r["share"]) for r in live.current_tally(spark, where).collect()}

    one, two = {"p1": {"0": ["a"]}}, {"p2": {"0": ["b"]}}
    # u is complete, v half, w has an empty answer
    assert tally("1.json", ("u", {**one, **two}), ("v", one), ("w", {**one, "p2": {"0": []}})) == {("0", "a"): (1, 0.5), ("0", "b"): (1, 0.5)}
    # v completes over two submissions, u adds a system, w fills the empty answer
    assert tally("2.json", ("v", two), ("u", {"p1": {"0": ["b"]}}), ("w", two)) == {("0", "a"): (3, 0.5), ("0", "b"): (4, 4 / 6)}
    # u ticks all systems of a question, v answers a third path: neither counts any more, whatever follows
    assert tally("3.json", ("u", {"p1": {"0": ["c"]}}), ("v", {"p3": {"0": ["a"]}})) == {("0", "a"): (1, 0.5), ("0", "b"): (1, 0.5)}
    assert tally("4.json", ("u", one), ("v", one), ("w", one)) == {("0", "a"): (1, 0.5), ("0", "b"): (1, 0.5)}


def test_models(spark):
    M.register("summary", "pairs", lambda: (lambda texts: [(t.upper(), "because") for t in texts]), load=True)
    t = spark.createDataFrame([("a\nb",), ("c",)], "summary string")
    got = {(r["instruction"], r["why"]) for r in M.summarise(t, "pairs", reasoning="why").collect()}
    assert got == {("A\nB", "because"), ("C", "because")}
    with pytest.warns(UserWarning):
        assert {r["instruction"] for r in M.summarise(t, "nobody").collect()} == {"a b", "c"}
    M.register("scene", "short", lambda xs: xs[:-1])
    with pytest.raises(Exception, match="results for"):
        M.annotate(t, "scene", "short", ["summary"]).collect()


def test_generation_with_models(spark, root):
    frames = S.scan_frames(spark, root).join(S.scan_action_labels(spark, root), ["source", "split", "episode_id", "frame_idx"])
    M.register("scene", "stem", lambda paths: [p.rsplit("/", 1)[1] for p in paths])
    got = {r["episode_id"]: r["instruction"] for r in flows.generate(frames, scene="stem").collect()}
    assert got["e3"] == "move forward. 0_0.jpg.  stop. 1_0.jpg. "
    kinds = {r["action"] for r in flows.describe_runs(frames, enter_leave=True).collect()}
    assert "stop" in kinds and kinds <= {"stop", "move forward", "enter", "pass", "leave"}


def test_match_on_more_than_one_block(spark):
    from wayline.operators import retrieval as R

    rows = [(i, [float((i * k) % 7) for k in range(1, 5)], [float((i * k) % 5) for k in range(1, 5)]) for i in range(23)]
    f = spark.createDataFrame(rows, "pair_id long, v array<float>, t array<float>")
    assert R.full_metrics(f, ["pair_id"], block=4).collect() == R.full_metrics(f, ["pair_id"], block=100).collect()


def test_one_load_for_each_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [t.upper() for t in texts]

    M.register("scene", "counted", load, load=True)
    rows = spark.range(64).selectExpr("id", "concat('t', id) AS text").repartition(16)
    assert M.annotate(rows, "scene", "counted", ["text"]).where("scene = upper(text)").count() == 64
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads))
    M.register("scene", "counted", lambda: lambda texts: ["new"] * len(texts), load=True)
    assert M.annotate(rows, "scene", "counted", ["text"]).where("scene = 'new'").count() == 64


def test_votes_by_the_rules_of_the_page(spark):
    bad = [{**SUB, "userId": "few", "answers": {"p0": SUB["answers"]["p0"]}}, {**SUB, "userId": "all", "answers": {**SUB["answers"], "p1": {"0": ["a", "b", "c"], "1": ["a"]}}},
           {**SUB, "userId": "half", "answers": {**SUB["answers"], "p1": {"0": ["a"]}}}]
    rows = spark.read.schema(S.SUBMISSION).json(spark.sparkContext.parallelize([json.dumps(x) for x in (SUB, *bad)]))
    got = {(r["question"], r["system"]): r["votes"] for r in live.stream_votes(rows, paths=5, questions=2, systems=3).collect()}
    assert got == {("0", "a"): 5, ("1", "a"): 5, ("1", "b"): 5}


def test_normal_mode_and_varied_elements(spark):
    frames = spark.createDataFrame([("s", "v", "e", i, a) for i, a in enumerate([1, 1, 1, 1, 2, 2, 1, 1])], "source string, split string, episode_id string, frame_idx long, action int")
    M.register("scene", "hall", lambda actions: ["a hall"] * len(actions))
    synonyms = spark.createDataFrame([("hall", 0, "lobby")], "word string, rank int, replacement string")
    tags = spark.createDataFrame([("a", "DT")], "word string, tag string")
    out = flows.describe_runs(frames, level=0, block=None, compact=2, diversify=1, scene="hall", synonyms=synonyms, tags=tags).collect()
    assert {r["scene"] for r in out} <= {"a hall", "a lobby"} and "a lobby" in {r["scene"] for r in out}
    assert sorted(r["frame_idx"] for r in out) == [1, 3, 4, 5]


def _listed(root, **options):
    """Folders that planning looks into, and the episodes dealt to tasks."""
    import pyarrow.fs as pafs

    from wayline.sources import episodes as E

    reader = E.EpisodeReader({"path": root, "kind": "names", "folder": "rgb", "wanted": "jpg|png", **{k: json.dumps(v) for k, v in options.items()}})
    seen, own = [], reader._folders
    reader._folders = lambda store, path: seen.append(path[len(root):]) or own(store, path)
    assert isinstance(reader._store()[0], pafs.LocalFileSystem)
    return seen, [n for p in reader.partitions() for n in p.names]


def test_only_the_splits_asked_for_are_listed(spark, root):
    assert _listed(root) == (["", "/test", "/val"], [("test", "e3"), ("val", "e1"), ("val", "e2")])
    assert _listed(root, splits=["val"]) == (["/val"], [("val", "e1"), ("val", "e2")])
    assert _listed(root, splits=["val"], episodes=["e2"]) == ([], [("val", "e2")])
    assert _listed(root, splits=["nowhere"]) == (["/nowhere"], [])
    val = S.scan_frames(spark, root, splits=["val"])
    assert val.groupBy("split").count().collect() == [("val", 15)]
    # one DataFrame used with a filter, then without
    assert val.where("episode_id = 'e1'").count() == 12 and val.count() == 15
    assert S.scan_frames(spark, root, episodes=["e3", "e9"]).count() == 2
    assert S.scan_action_labels(spark, root, splits=["test"]).count() == 2


def test_episodes_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(300).selectExpr("array(concat('s/e', id % 100, '/rgb/', id, 'x.png')) AS paths", "array(encode(string(id), 'utf-8')) AS contents")
    S.write_files(rows, str(tmp_path / "many"))
    got = S.scan_frames(spark, str(tmp_path / "many"), content=True)
    assert got.rdd.getNumPartitions() == 4  # 100 episodes, 32 for each task
    assert {(r["episode_id"], r["frame_idx"], int(bytes(r["content"]))) for r in got.collect()} == {(f"e{i % 100}", i // 100, i) for i in range(300)}


def test_names_in_natural_order(spark):
    from wayline.operators.frames import frame_order
    from wayline.sources.episodes import natural

    names = ["10.jpg", "9.jpg", "009.jpg", "a.jpg", "a1.jpg", "a10b2.jpg", "a10b10.jpg", "a2.jpg", "é3.jpg", "1_0.jpg", "1_00.jpg", "0.jpg", "00.jpg", "x" * 30 + "12345678901234567890123.jpg", ".5.jpg", "-1.jpg"]
    rows = spark.createDataFrame([("s", "v", "e", n) for n in names], "source string, split string, episode_id string, name string")
    assert [r["name"] for r in frame_order(rows).orderBy("frame_idx").collect()] == sorted(names, key=natural)


def _batches(rows):
    import pyarrow as pa

    return [pa.RecordBatch.from_arrays([pa.array([p], pa.list_(pa.string())), pa.array([c], pa.list_(pa.binary()))], names=["paths", "contents"]) for p, c in rows]


def _tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_writes_are_committed_or_leave_nothing(tmp_path):
    from wayline.sources.episodes import FileWriter

    def row(i, body):
        return [f"s/e{i}/a/0.info", f"s/e{i}/a/0.txt"], [f"i{body}".encode(), f"t{body}".encode()]

    def dies():
        yield from _batches([row(0, 1), row(1, 1)])
        raise OSError("lost")

    # a task that is tried again: the first attempt leaves nothing, the second is committed
    first = FileWriter({"path": str(tmp_path)})
    with pytest.raises(OSError):
        first.write(dies())
    assert _tree(tmp_path) == {}
    again = first.write(iter(_batches([row(0, 1), row(1, 1)])))
    # another run has the same outputs in hand, and one more
    second = FileWriter({"path": str(tmp_path)})
    other = second.write(iter(_batches([row(1, 2), row(2, 2)])))
    twice = second.write(iter(_batches([row(1, 3)])))
    first.commit([again, None])
    second.commit([other, twice])
    want = {f"s/e{i}/a/0.{x}": f"{x[0]}{b}".encode() for i, b in ((0, 1), (1, 1), (2, 2)) for x in ("info", "txt")}
    assert _tree(tmp_path) == want
    # a run that was aborted, and one that finds a document whose text was never written
    third = FileWriter({"path": str(tmp_path)})
    third.abort([third.write(iter(_batches([row(7, 1)])))])
    (tmp_path / "s" / "e8" / "a").mkdir(parents=True)
    (tmp_path / "s" / "e8" / "a" / "0.info").write_bytes(b"left over")
    fourth = FileWriter({"path": str(tmp_path)})
    fourth.commit([fourth.write(iter(_batches([row(8, 5), row(0, 5)])))])
    assert _tree(tmp_path) == {**want, "s/e8/a/0.info": b"i5", "s/e8/a/0.txt": b"t5"}
    fifth = FileWriter({"path": str(tmp_path)})
    with pytest.raises(ValueError):
        fifth.write(iter(_batches([(["s/../x"], [b""])])))
    fifth.abort([])
    with pytest.raises(ValueError):
        FileWriter({"path": "s3://bucket/x"})


def test_staged_blocks_are_named_by_tasks_that_may_be_tried_again(spark, tmp_path, monkeypatch):
    import os
    from pathlib import Path

    from wayline.sources import episodes as E

    root = tmp_path / "src"
    (root / "s" / "e0").mkdir(parents=True)
    (root / "s" / "e0" / "0.info").write_bytes(b"left over")
    writer = E.FileWriter({"path": str(root), "staging": str(root / ".staging-x")})
    rows = [([f"s/e{i}/0.info", f"s/e{i}/0.txt"], [b"i%d" % i, b"t%d" % i]) for i in range(1200) if i != 1]
    late = _batches([([f"s/e1/{x}" for x in ("0.info", "0.txt")], [b"i1", b"t1"])])
    writer.commit([writer.write(iter(_batches(rows) + late)), None])
    (root / "s" / "e1").mkdir()
    (root / "s" / "e1" / "0.txt").write_bytes(b"other run")
    # the driver's commit names nothing
    assert not (root / "s" / "e5").exists()
    blocks = json.loads((root / ".staging-x" / "committed").read_text())
    assert len(blocks) == 3 and all(len(list(Path(b).iterdir())) <= E.STAGED + 2 for b in blocks)
    # a task that is lost after it has named all rows of its block, and the one that follows
    remove = os.remove
    monkeypatch.setattr(os, "remove", lambda path: (_ for _ in ()).throw(OSError("lost")))
    for b in blocks:
        with pytest.raises(OSError):
            E.publish_block(str(root), b)
    monkeypatch.setattr(os, "remove", remove)
    assert sum(E.publish_block(str(root), b) for b in blocks) == len(rows) + 1 and not [b for b in blocks if Path(b).exists()]
    assert sum(E.publish_block(str(root), b) for b in blocks) == 0
    E.clean(str(root / ".staging-x"))
    want = {p: c for paths, contents in rows for p, c in zip(paths, contents)} | {"s/e1/0.txt": b"other run"}
    assert _tree(root) == want
    # a whole run: more rows than one block, none of them twice
    again = spark.range(3000).selectExpr("array(concat('s/e', id, '/0.info'), concat('s/e', id, '/0.txt')) AS paths", "array(encode('new', 'utf-8'), encode('new', 'utf-8')) AS contents")
    S.write_files(again, str(root))
    assert _tree(root) == want | {f"s/e{i}/0.{x}": b"new" for i in range(1200, 3000) for x in ("info", "txt")}


def test_runs_that_race_write_an_output_once(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from wayline.sources.episodes import FileWriter

    def run(body):
        w = FileWriter({"path": str(tmp_path)})
        rows = [([f"s/e{i}/0.info", f"s/e{i}/0.txt"], [body.encode()] * 2) for i in range(200)]
        w.commit([w.write(iter(_batches(rows)))])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(run, "abcd"))
    got = _tree(tmp_path)
    assert len(got) == 400 and all(got[f"s/e{i}/0.info"] == got[f"s/e{i}/0.txt"] for i in range(200))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).selectExpr("'s' AS split", "concat('e', id) AS episode_id", "'a b' AS inst_alias", "0 AS inst_id", "'t\n%' AS text", "id", "'sum' AS summary")
    bad = rows.withColumn("text", F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        S.write_outputs(bad, str(tmp_path / "src"))
    assert _tree(tmp_path) == {}
    S.write_outputs(rows, f"file://{tmp_path}/src")
    S.write_outputs(rows.withColumn("text", F.lit("other")), str(tmp_path / "src"))
    back = S.scan_instructions(spark, f"file://{tmp_path}/src", None, "a b").collect()
    assert len(back) == 40 and {r["text"] for r in back} == {"t\n%"}
    assert {r["summary"] for r in S.scan_infos(spark, str(tmp_path / "src"), ["s"], "a b").collect()} == {"sum"}
    assert S.scan_outputs(spark, str(tmp_path / "src"), "a b").count() == 40 and not list((tmp_path / "src").glob(".staging*"))


def test_a_rater_reads_and_writes_its_state_once():
    """All answers of a rater are one value, and rows are taken one by one."""
    from pyspark.sql import Row

    from wayline.streaming import live

    class Value:
        value, uses = None, 0

        def get(self):
            self.uses += 1
            return self.value

        def update(self, value):
            self.uses += 1
            self.value = value

    kept = Value()
    answers = live._Answers(3, 1, 2)
    answers.init(type("Handle", (), {"getValueState": lambda self, *a: kept})())

    def step(*rows):
        kept.uses = 0
        out = [tuple(r) for r in answers.handleInputRows(("r",), iter(Row(path=p, question=q, system=s) for p, q, s in rows), None)]
        assert kept.uses <= 2
        return sorted(out, key=str)

    assert step(("p", "a", "x")) == []
    assert step(("p", "b", "y")) == sorted([("r", "a", None, 0, 1), ("r", "b", None, 0, 1), ("r", "a", "x", 1, 0), ("r", "b", "y", 1, 0)], key=str)
    assert step(("p", "a", "x")) == []
    # all systems ticked: what was counted is withdrawn, for good
    assert step(("p", "a", "y"), ("p", "a", "z")) == sorted([("r", "a", None, 0, -1), ("r", "b", None, 0, -1), ("r", "a", "x", -1, 0), ("r", "b", "y", -1, 0)], key=str)
    assert step(("p", "b", "x")) == []


def _events(spark, path, users, each):
    """Events in time order, of users with so many each."""
    rows = spark.range(users * each).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", f"id % {users} AS user_id", "IF(id % 7 = 0, 'purchase', 'view') AS event_type", "1.0D AS value")
    rows.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_files_that_are_only_read_back_are_on_disk_by_rounds(spark, tmp_path, monkeypatch):
    from pathlib import Path
    from urllib.parse import urlparse

    from wayline.plans.catalog import QUERIES

    monkeypatch.setattr(S, "FILES", 100, raising=False)
    there, roots = [], set()

    def counted(scan):
        def run(spark, root, *args, **options):
            roots.add(root)
            there.append(sum(p.is_file() for r in roots for p in Path(urlparse(r).path).rglob("*")))
            return scan(spark, root, *args, **options)
        return run

    monkeypatch.setattr(S, "scan_frames", counted(S.scan_frames))
    monkeypatch.setattr(S, "scan_action_labels", counted(S.scan_action_labels))
    d = _events(spark, tmp_path / "in", 60, 9)
    # 20 episodes of png images, 20 of jpg images, 20 of both
    got = QUERIES["scan_frames"](spark, d).collect()
    assert sum(there) == 20 * 9 * 4 and len(there) == 8 and max(there) < 300
    assert sorted(tuple(r) for r in got) == sorted(
        ("synth", "val_seen" if u % 2 == 0 else "val_unseen", u, i, f"{i}_0.{'png' if u % 3 == 0 else 'jpg'}", i * 60 + u) for u in range(60) for i in range(9))
    there.clear()
    got = QUERIES["scan_action_labels"](spark, d).collect()
    # 20 episodes have two files
    assert sum(there) == 80 and len(there) == 3 and max(there) < 60
    assert sorted((r["episode_id"], r["frame_idx"], r["action"]) for r in got) == sorted(
        (u, i, 0 if i == 8 else 2 if (i * 60 + u) % 7 == 0 else 1) for u in range(60) for i in range(9))
    # nothing stays behind
    assert len(roots) == 11 and not [r for r in roots if Path(urlparse(r).path).exists()]
    none = _events(spark, tmp_path / "none", 1, 0)
    assert QUERIES["scan_frames"](spark, none).collect() == [] == QUERIES["scan_action_labels"](spark, none).collect()


def test_an_episode_is_never_divided_between_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "FILES", 10, raising=False)
    rows = spark.range(200).selectExpr("IF(id < 150, 'long', concat('e', id)) AS episode", "id")

    def step(part, root):
        S.write_files(part.selectExpr("array(concat('s/', episode, '/rgb/', id, '.jpg')) AS paths", "array(encode(string(id), 'utf-8')) AS contents"), root)
        return S.scan_frames(spark, root, content=True).selectExpr("source", "episode_id", "frame_idx", "bigint(decode(content, 'utf-8')) AS id")

    got = S.in_rounds(rows, ["episode"], F.lit(1), "src", step).collect()
    assert sorted(tuple(r) for r in got) == sorted(("src", "long", i, i) if i < 150 else ("src", f"e{i}", 0, i) for i in range(200))


def test_staged_files_are_written_over_when_their_names_are_gone(spark, tmp_path):
    from wayline.sources import episodes as E

    spare = tmp_path / ".spare"

    def write(root, size, n=90):
        rows = spark.range(n).selectExpr("id", f"repeat(chr(97 + int(id % 26)), int(id % 7) * {size}) AS text")
        S.write_files(rows.selectExpr("array(concat('s/e', id % 9, '/rgb/', id, '.jpg')) AS paths", "array(encode(text, 'utf-8')) AS contents").repartition(3), str(root), str(spare))
        return {f"s/e{i % 9}/rgb/{i}.jpg": (chr(97 + i % 26) * (i % 7 * size)).encode() for i in range(n)}

    def kept():
        return {p.stat().st_ino: p.stat().st_nlink for p in (spare / E.BLOCKS).rglob("*") if p.is_file()}

    a, b = tmp_path / "a", tmp_path / "b"
    first = write(a, 3)
    assert _tree(a) == first and len(kept()) == 90 and set(kept().values()) == {2}
    # the first files still have their names, so nothing is written into them
    second = write(b, 5)
    assert _tree(a) == first and _tree(b) == second
    for root in (a, b):
        S.remove_episodes(spark, str(root), str(spare))
        assert not root.exists()
    before = kept()
    assert set(before.values()) == {1} and len(list((spare / E.EMPTY).iterdir())) == 18 and not [p for p in (spare / E.EMPTY).rglob("*") if p.is_file()]
    # longer and shorter contents, none left of the old ones
    for size, n in ((9000, 90), (1, 90), (0, 60), (4, 90)):
        c = tmp_path / f"c{size}"
        assert write(c, size, n) == _tree(c)
        assert {p.stat().st_ino for p in c.rglob("*") if p.is_file()} <= set(before)
        assert len(list((spare / E.EMPTY).iterdir())) == 9
        S.remove_episodes(spark, str(c), str(spare))
    assert set(kept()) == set(before)


def test_rounds_go_on_side_by_side(spark, tmp_path, monkeypatch):
    import threading

    monkeypatch.setattr(S, "FILES", 80, raising=False)
    monkeypatch.setattr(S, "LEAST", 40, raising=False)
    rows = spark.range(600).selectExpr("IF(id < 150, 'long', concat('e', id % 50)) AS episode", "id")
    used, threads = [], set()

    def step(part, root):
        used.append(root)
        threads.add(threading.get_ident())
        S.write_files(part.selectExpr("array(concat('s/', episode, '/rgb/', id, '.jpg')) AS paths", "array(encode(string(id), 'utf-8')) AS contents"), root, S.spare_folder(root))
        return S.scan_frames(spark, root, content=True, per_task=8).selectExpr("source", "episode_id", "frame_idx", "bigint(decode(content, 'utf-8')) AS id")

    got = S.in_rounds(rows, ["episode"], F.lit(1), "src", step).collect()
    names = {f"e{k}": [i for i in range(150, 600) if i % 50 == k] for k in range(50)} | {"long": list(range(150))}
    assert sorted(tuple(r) for r in got) == sorted(("src", e, k, i) for e, own in names.items() for k, i in enumerate(own))
    assert len(used) == len(set(used)) == 15 and len(threads) == 2

    def fails(part, root):
        if "/1/1/" in root:
            raise ValueError("no room")
        return step(part, root)

    with pytest.raises(ValueError, match="no room"):
        S.in_rounds(rows, ["episode"], F.lit(1), "src", fails)


def test_bytes_of_mounted_files(tmp_path):
    import pyarrow.fs as pafs

    from wayline.sources import episodes as E

    for size in (0, 1, E.CHUNK - 1, E.CHUNK, E.CHUNK + 1, E.CHUNK * 65, E.CHUNK * 65 + 3):
        (tmp_path / "f").write_bytes(content := bytes(i % 251 for i in range(size)))
        assert E.read_bytes(pafs.LocalFileSystem(), str(tmp_path / "f")) == content
