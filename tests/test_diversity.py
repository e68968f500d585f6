"""Corpus statistics against direct definitions on small corpora."""

import gzip
import math
import random
import re

import pytest

from wayline.operators import diversity as DV

WORDS = ["go", "turn", "left", "right", "the", "door", "er", "or", "doors", "ing", "turning", "t", "walk"]


def corpus(n=30, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 6, 12, 25]))) + rng.choice(["", ".", "."]) for _ in range(n)]


TEXTS = corpus()


def tok(t):
    return re.findall(r"[^\W_]+|[^\s\w]|_", t)


def order(texts):
    import hashlib

    return [t for _, t in sorted((hashlib.md5(str(i).encode()).hexdigest(), t) for i, t in enumerate(texts))]


@pytest.fixture(scope="module")
def df(spark):
    rows = [("x", i, t) for i, t in enumerate(TEXTS)] + [("solo", 0, "go left .")]
    return spark.createDataFrame(rows, "inst_alias string, episode_id long, text string").repartition(5).cache()


def value(out, col, alias="x"):
    return {r["inst_alias"]: r[col] for r in out.collect()}[alias]


def bleu(hyp, refs):
    if not hyp:
        return 0.0
    s = 0.0
    for n in range(1, 5):
        grams = [tuple(hyp[i:i + n]) for i in range(len(hyp) - n + 1)]
        hit = sum(min(grams.count(g), max((sum(tuple(r[i:i + n]) == g for i in range(len(r) - n + 1)) for r in refs), default=0)) for g in set(grams))
        if n == 1 and not hit:
            return 0.0
        s += math.log((hit or 0.1) / max(len(grams), 1))
    r = min((len(x) for x in refs), key=lambda n: (abs(n - len(hyp)), n))
    return min(1.0, math.exp(1 - r / len(hyp))) * math.exp(s / 4)


@pytest.mark.parametrize("window,block", [(5, 2048), (50, 2048), (10_000, 20_000), (7, 13)])
def test_mattr(df, monkeypatch, window, block):
    monkeypatch.setattr(DV, "TOKEN_BLOCK", block)
    t = [w for x in order(TEXTS) for w in tok(x)]
    w = min(window, len(t))
    want = sum(len(set(t[i:i + w])) for i in range(len(t) - w + 1)) / (w * (len(t) - w + 1))
    out = DV.mattr(df, window)
    assert value(out, "mattr") == pytest.approx(want)
    assert value(out, "mattr", "solo") == pytest.approx(1.0)


def test_hdd(df):
    t = [w for x in TEXTS for w in tok(x)]
    want = sum(1 - math.comb(len(t) - t.count(w), 42) / math.comb(len(t), 42) for w in set(t)) / 42
    out = DV.hdd(df)
    assert value(out, "hdd") == pytest.approx(want)
    assert value(out, "hdd", "solo") is None


@pytest.mark.parametrize("texts_per_block", [512, 8])
def test_ngram_diversity(df, monkeypatch, texts_per_block):
    monkeypatch.setattr(DV, "TEXT_BLOCK", texts_per_block)
    data = " ".join(order(TEXTS)).split(" ")
    want = sum(len(set(g)) / len(g) for g in ([tuple(data[i:i + n]) for i in range(len(data) - n + 1)] for n in range(1, 5)))
    assert value(DV.ngram_diversity(df), "ngd") == pytest.approx(want)


@pytest.mark.parametrize("n", [3, 4])
def test_self_repetition(df, n):
    texts = [" ".join(tok(t)) for t in TEXTS]
    want = 0.0
    for t in texts:
        w = t.split(" ")
        grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)]
        if grams:
            want += math.log(1 + sum(sum(g in x for x in texts) for g in grams) - len(grams))
    assert value(DV.self_repetition(df, n), "self_rep") == pytest.approx(want / len(texts))


def test_self_bleu(df):
    t = [tok(x) for x in TEXTS]
    want = sum(bleu(h, t[:i] + t[i + 1:]) for i, h in enumerate(t)) / len(t)
    assert value(DV.self_bleu(df), "self_bleu") == pytest.approx(want)


@pytest.mark.parametrize("block", [64, 4])
def test_homogenization_bleu(df, block):
    t = [tok(x) for x in TEXTS]
    pairs = [(r, h) for i, r in enumerate(t) for j, h in enumerate(t) if i != j]
    want = sum(bleu(h, [r]) for r, h in pairs) / len(pairs)
    out = DV.homogenization_bleu(df, block=block)
    assert value(out, "hom_bleu") == pytest.approx(want)
    assert value(out, "hom_bleu", "solo") is None


def test_homogenization_rougel(df):
    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    t = [[w.lower() for w in tok(x)] for x in TEXTS]
    total = 0.0
    for i, a in enumerate(t):
        for j, b in enumerate(t):
            k = lcs(a, b) if i != j else 0
            total += 2 * (k / len(b)) * (k / len(a)) / (k / len(b) + k / len(a)) if k else 0
    assert value(DV.homogenization_rougel(df, block=7), "hom_rougel") == pytest.approx(total / (len(t) * (len(t) - 1)))


def test_compression_ratio(df):
    body = " ".join(order(TEXTS)).encode()
    want = len(body) / len(gzip.compress(gzip.compress(body, mtime=0), mtime=0))
    assert value(DV.compression_ratio(df), "cr") == pytest.approx(want)
    assert value(DV.compression_ratio(df, block_bytes=200), "cr") > 0
    assert value(DV.compression_ratio(df, "xz"), "cr") > 0


def test_compression_ratio_pos(spark, df):
    tags = spark.createDataFrame([("go", "VB"), ("the", "DT")], "word string, tag string")
    body = " ".join(" ".join({"go": "VB", "the": "DT"}.get(w, "NN") for w in t.split()) for t in order(TEXTS)).encode()
    want = len(body) / len(gzip.compress(gzip.compress(body, mtime=0), mtime=0))
    assert value(DV.compression_ratio_pos(df, tags), "cr_pos") == pytest.approx(want)


def test_several_texts_of_an_episode(spark):
    texts = ["go left now and stop", "go right now and stop", "walk past the table and stop", "go left now and wait"]
    cols = "inst_alias string, split string, episode_id string, inst_id string, text string"
    apart = spark.createDataFrame([("x", "v", f"e{i}", "0", t) for i, t in enumerate(texts)], cols)
    shared = spark.createDataFrame([("x", "v", f"e{i // 2}", str(i % 2), t) for i, t in enumerate(texts)], cols)
    for f, name in ((DV.self_bleu, "self_bleu"), (DV.self_repetition, "self_rep")):
        assert value(f(shared), name) == pytest.approx(value(f(apart), name))
        with pytest.raises(Exception, match="several texts have the ids"):
            f(shared, ids=["episode_id"]).collect()
    with pytest.raises(Exception, match="several texts have the ids"):
        DV.ngram_diversity(shared, ids=["episode_id"]).collect()
    assert value(DV.homogenization_bleu(apart, sample=2), "hom_bleu") >= 0


def test_common_subsequences_abreast():
    """The long bit vector against the table of lengths, over references of all sizes next to each other."""
    import numpy as np

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    rng = random.Random(7)
    for kinds in (1, 2, 5, 40):
        refs = [np.array([rng.randrange(kinds) for _ in range(rng.choice([0, 1, 2, 7, 63, 64, 65, 130]))], int) for _ in range(30)]
        texts = [np.array([rng.randrange(kinds + 1) for _ in range(rng.choice([0, 1, 5, 64, 200]))], int) for _ in range(12)]
        got = DV._common(refs, texts)
        assert got.tolist() == [[lcs(r, t) for t in texts] for r in refs]


def test_report_reads_one_corpus(spark, df, monkeypatch):
    """Every statistic of the report equals the statistic alone; tokens and n-grams are written once."""
    made = []
    real = DV._gram_counts
    monkeypatch.setattr(DV, "_gram_counts", lambda *a: made.append(1) or real(*a))
    wide = {r["inst_alias"]: r for r in DV.diversity_report(df, rouge=True).collect()}
    assert len(made) == 1
    alone = {"length": DV.mean_length(df), "mattr": DV.mattr(df), "hdd": DV.hdd(df), "ngd": DV.ngram_diversity(df), "self_rep": DV.self_repetition(df),
             "self_bleu": DV.self_bleu(df), "hom_bleu": DV.homogenization_bleu(df), "hom_rougel": DV.homogenization_rougel(df)}
    for name, out in alone.items():
        for alias in ("x", "solo"):
            assert wide[alias][name] == (None if value(out, name, alias) is None else pytest.approx(value(out, name, alias))), name


@pytest.mark.parametrize("frequent", [20_000, 3])
def test_frequent_ngrams_are_split_off(spark, df, monkeypatch, frequent):
    """Plans differ, results don't."""
    monkeypatch.setattr(DV, "FREQUENT", frequent)
    texts = [" ".join(tok(t)) for t in TEXTS]
    grams = [[w[i:i + 4] for i in range(len(w) - 3)] for w in (t.split(" ") for t in texts)]
    want = sum(math.log(1 + sum(sum(x in g for g in grams) for x in own) - len(own)) if own else 0 for own in grams)
    assert value(DV.self_repetition(df, match="token"), "self_rep") == pytest.approx(want / len(texts))
    assert value(DV.self_repetition(df), "self_rep") == pytest.approx(value(DV.self_repetition(DV.Corpus(df)), "self_rep"))


def test_ids_are_checked_without_texts(spark, tmp_path):
    """The check reads the id columns only."""
    spark.createDataFrame([("x", 1, "a b"), ("x", 2, "c")], "inst_alias string, episode_id long, text string").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).groupBy("inst_alias", "episode_id").count()
    assert "text" not in rows._jdf.queryExecution().executedPlan().toString()
    DV.check_ids(spark.read.parquet(str(tmp_path / "t")), ["inst_alias"], ["episode_id"])


def test_grams_in_many_pieces_and_buckets(spark, df, monkeypatch):
    """N-grams of a few texts each meet again in the buckets: small pieces and buckets change nothing, whatever the numbers of the texts."""
    want = {f.__name__: value(f(df), name) for f, name in ((DV.self_bleu, "self_bleu"), (DV.ngram_diversity, "ngd"), (DV.self_repetition, "self_rep"))}
    alone = value(DV.self_repetition(df, match="token"), "self_rep")
    count = DV.G.buckets
    monkeypatch.setattr(DV.G, "buckets", lambda *a: 7 * count(*a))
    assert value(DV.self_bleu(df), "self_bleu") == pytest.approx(want["self_bleu"])
    assert value(DV.ngram_diversity(df), "ngd") == pytest.approx(want["ngram_diversity"])
    assert value(DV.self_repetition(df), "self_rep") == pytest.approx(want["self_repetition"])
    assert value(DV.self_repetition(df, match="token"), "self_rep") == pytest.approx(alone)


def test_pieces_hold_whole_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(DV.G, "GRAM_TOKENS", 4)
    texts = [[1, 2, 3], [], [4], [5, 6, 7, 8, 9, 10], [1, 2], [3]]
    numbers = [7, 8, 20, 21, 3, 3 + DV.G.GRAM_TEXTS]
    batch = pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([0] * 6), pa.array(texts, pa.list_(pa.int64()))], names=["_x", "_g", "_h"])
    found = {}
    for p in DV.G.pieces(iter([batch])):
        assert not len(p.owner) or p.owner.max() < DV.G.GRAM_TEXTS
        for w, o, left in zip(p.words.tolist(), p.owner.tolist(), p.left.tolist()):
            found.setdefault(p.first + o, []).append((w, left))
    assert found == {x: [(w, len(t) - i) for i, w in enumerate(t)] for x, t in zip(numbers, texts) if t}


def test_texts_that_contain_longer_forms():
    """Against every pair of rows of a key."""
    import numpy as np

    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice(WORDS), rng.choice(WORDS), rng.randrange(9)) for _ in range(300)]
    rows = sorted(set(rows))
    key, a, z, x = (np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, object, object, np.int64)))
    want = [len({r[3] for r in rows if r[0] == k and r[1].endswith(s) and r[2].startswith(e)}) for k, s, e, _ in rows]
    assert DV.G._containing(key, a, z, x).tolist() == want


def test_no_token_or_ngram_becomes_a_row(df):
    """Statistics over n-grams shuffle buckets, and the moving ratio whole blocks: no plan explodes tokens."""
    for f in (DV.mattr, DV.ngram_diversity, DV.self_bleu, DV.self_repetition):
        plan = f(df)._jdf.queryExecution().optimizedPlan().toString()
        assert "inline(" not in plan and "posexplode(" not in plan, f.__name__
