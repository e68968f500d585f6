"""Near duplicates, decontamination and the pipeline against brute force."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayline.llm import decontam, jaccard, langid
from wayline.llm.common import components, shingle_sets
from wayline.plans.verify import _rows

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "doc_id bigint, text string, key string, id int, n int, dig string, t string, words string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "d", "t", "w") for i, t in rows], EXTRA)


def groups(edges, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(40)] + [(random.randint(100, 300), random.randint(100, 300)) for _ in range(120)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = groups(edges, {x for e in edges for x in e})
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute(rows, width, num, den):
    """(id, size, component) of each row, by word tuples and all pairs that share one."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    edges += [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and rows[i][0] is not None and sets[i] and sets[j] and sets[i] == sets[j]]
    found = groups(edges, range(len(rows)))
    low = {}
    for i, c in found.items():
        if rows[i][0] is not None:
            low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    return sorted(((r[0], len(sets[i]), low.get(found[i])) for i, r in enumerate(rows)), key=str)


def family(rng, words, copies, change):
    base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
    yield " ".join(base)
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(1, change)):
            own[rng.randrange(len(own))] = rng.choice(words)
        yield " ".join(own)


@pytest.mark.parametrize("block", [4096, 8])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "WIDE_FROM", 5)
    monkeypatch.setattr(jaccard, "LOCAL_COPIES", 4)
    monkeypatch.setattr(jaccard, "RANGE_ROWS", 40)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(400)] + ["the", "of"] * 50
    texts = [t for _ in range(6) for t in family(rng, words, rng.choice([2, 25]), 6)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 200))) for _ in range(25)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "only three Words"), (5, "ONLY three words"), (6, "only"), (None, texts[0]), (None, "unique null text of nobody else here"),
             (7, "x " * 5000), (8, "x x x x x"), (9, texts[3]), (9, texts[3]), (10, "ÀB c d e"), (11, "àb c d e")]
    out = jaccard.jaccard_components(table(spark, rows), width=4, num=85, den=100).collect()
    assert sorted(((r.id, r.n, r.component) for r in out), key=str) == brute(rows, 4, 85, 100)


def test_blocks_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "RANGE_ROWS", 20)
    rng = random.Random(3)
    rows = [(key, dig, rng.randint(1, 4), rng.randint(1, 3)) for key, k in ((1, 150), (2, 9), (3, 1)) for dig in range(k)]
    out = jaccard._blocks(spark.createDataFrame(rows, "key bigint, dig bigint, n int, comp bigint")).collect()
    want = {}
    for key in (1, 2, 3):
        for at, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3], r[1]))):
            want[key, r[1]] = at // 7
    assert {(r.key, r.dig): r.block for r in out} == want and len(out) == len(rows)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(table(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(table(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_signature_bounds():
    """No pair that reaches the threshold is ruled out by bitmaps of either width."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    sets = list(shingle_sets(pa.array([t for _ in range(8) for t in family(rng, words, 6, 8)]), 2))
    for per in (1, jaccard.WIDE):
        members = [(i, len(s), i, 8 * len(jaccard._bitmap(s, per)), int.from_bytes(jaccard._bitmap(s, per), "little")) for i, s in enumerate(sets)]
        found = jaccard._join_sides(members, None, 70, 100)
        both = jaccard._join_sides(members[:20], members[20:], 70, 100)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                common = len(set(a.tolist()) & set(b.tolist()))
                if 100 * common >= 70 * (len(a) + len(b) - common):
                    assert (j, i) in found and ((j < 20) == (i < 20) or (j, i) in both)


def test_decontamination(spark):
    rng = random.Random(3)
    words = ["the", "of", *(f"v{i}" for i in range(30))]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([40, 13, 14, 12, 3, 60, 200])]
    items += [(0, items[0][1]), (0, " ".join(text(20))), (70, ""), (71, None), (None, " ".join(text(15))), (72, "The Of,v1 the-of")]
    docs = []
    for i in range(60):
        own = text(rng.randint(0, 150))
        if i % 3:
            w = (items[rng.randrange(len(items))][1] or "").split()
            a = rng.randint(0, max(0, len(w) - 13))
            at = rng.randint(0, len(own))
            own[at:at] = w[a : a + rng.randint(5, 40)]
        docs.append((i, rng.choice([" ", ", ", " .\n"]).join(own).title()))
    docs += [(100, None), (101, ""), (102, "!?"), (5, docs[5][1]), (5, "another text " + items[1][1]), (None, items[2][1]), (103, "x " * 20_000 + items[0][1])]

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    windows = {}
    for i, t in items:
        w = split(t)
        m = min(13, len(w))
        for a in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[a : a + m]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    want = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in windows:
                    found |= windows[tuple(w[a : a + m])]
                    hit |= set(range(a, a + m))
        want.append((i, len(w), len(hit), tuple(sorted(found))))
    benchmark = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id bigint, text string, piece string")
    out = decontam.contamination(table(spark, docs), benchmark)
    got = [(r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want) and any(not w[2] for w in want)
    none = decontam.contamination(table(spark, docs[:3]), benchmark.limit(0)).collect()
    assert [r.n_hit for r in none] == [0, 0, 0] and decontam.contamination(table(spark, []), benchmark).count() == 0


def test_decontamination_is_native(spark):
    out = decontam.contamination(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def write(spark, tmp_path, rows, items, schema="doc_id bigint, text string, lang string, source string, n_chars bigint, id string, removed int"):
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1) for i, t, lang in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_keeps_and_drops(spark, tmp_path):
    rng = random.Random(4)
    words = "the house garden river stone water bread window letter morning evening winter summer flower forest".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ly", "ed"]) for _ in range(n))
    rows = [(i, text(rng.randint(30, 90)), "en") for i in range(40)]
    near = rows[3][1].split()
    near[10] = "changed"
    item = text(30)
    rows += [(50, rows[3][1], "en"), (51, " ".join(near), "en"), (2, rows[2][1], "en"), (60, text(20) + " " + item, "en"), (61, text(600) + " " + item[: len(item) // 2], "en"),
             (70, None, "en"), (71, "", None), (72, "12 34", "en"), (None, text(50), "en"), (80, text(25), None)]
    folder = write(spark, tmp_path, rows, [(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str))
    ids = lambda *gone: sorted([r[0] for r in rows if r[0] not in gone], key=str)
    assert seen[0] == ids(70, 71, 72)
    after = ids(70, 71, 72, 50, 51)
    after.remove(2)
    assert seen[1] == after and seen[2] == [i for i in after if i != 60] == seen[3]
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, folder).collect()), key=str) == seen[3]


def test_pipeline_of_nothing(spark, tmp_path):
    folder = write(spark, tmp_path, [], [])
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    found = {r.id for r in langid.identify(spark.read.parquet(f"{DATA}/documents.parquet")).where("rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs if r.doc_id not in found]
    component = {i: c for i, _, c in brute(rows, 5, 80, 100)}
    rows = [(i, t) for i, t in rows if component[i] == i]
    windows = {}

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = split(r.text)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a : a + 13]), r.item_id)
    left = []
    for i, t in rows:
        w, hit = split(t), set()
        for m in {len(k) for k in windows}:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in windows:
                    hit |= set(range(a, a + m))
        if not hit or 20 * len(hit) < len(w):
            left.append(i)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(left)
    assert 0 < len(left) < len(docs)


@pytest.mark.parametrize("name", ["op1_warc", "op4_chat", "op6_jaccard_components", "op8_decontamination"])
def test_sql(spark, name):
    import duckdb

    from wayline.llm.catalog import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    res = con.execute(ORACLE[name])
    out = QUERIES[name](spark, DATA)
    assert _rows(out.columns, out.collect()) == _rows([c[0] for c in res.description], res.fetchall())
    if name in ("op4_chat", "op8_decontamination"):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_repeated_rows_of_the_pipeline_are_told_apart(spark):
    """Of rows that differ beside id and text, the same one stays whatever the order of the rows."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "fr", "b", 1), (1, text, "en", "c", 1), (1, text, None, "a", 1), (1, text, "en", "c", 1), (1, "other text", "en", "a", 1), (2, "single", "en", "a", None), (None, "x", None, None, None)]
    kept = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
        got = corpus_pipeline.near_duplicates(spark, docs, DATA)
        assert got.columns == docs.columns
        kept.add(tuple(sorted((tuple(r) for r in got.collect()), key=str)))
    assert len(kept) == 1 and sorted(str(r[0]) for r in next(iter(kept))) == ["1", "1", "2", "None"]
