"""Fill-in-the-middle, URL rules and the Merkle manifest against direct definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import fim, merkle, urls

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_fim(i, text, unit="token", rate=50):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in fim.SENTINELS) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    if h4 % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,rate", [("token", 50), ("token", 100), ("char", 100)])
def test_fill_in_middle(spark, unit, rate):
    rng = random.Random(rate)
    rows = [(i, "".join(rng.choice(" \n\t\x1c\x0bab<é漢😀,") for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(None, "a null id"), (None, None), (500, None), (501, ""), (502, " "), (503, "x"), (504, "has <S> in it"), (505, "ends <"), (506, "word é漢 " * 60_000),
             (3, rows[3][1]), (3, rows[3][1]), (4, "another text of id 4"), (507, "\n a"), (508, "\x00 \u00a0\u2003 b")]
    table = spark.createDataFrame([(i, t, "q", 1, "z", 2) for i, t in rows], "doc_id bigint, text string, form string, n int, output string, h1 int")
    out = fim.fill_in_middle(table, unit=unit, rate=rate).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted((brute_fim(i, t, unit, rate) for i, t in rows), key=str)
    texts = {(i, t or "") for i, t in rows}
    assert all((r.id, r.back) in texts for r in out)
    assert fim.fill_in_middle(table.limit(0)).count() == 0


def test_sentinels_that_overlap_are_refused(spark):
    table = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        fim.fill_in_middle(table, sentinels=("<P>", "<P><S>", "<M>"))
    with pytest.raises(ValueError):
        fim.fill_in_middle(table, sentinels=("ab", "ba", "c"))


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 7, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(symbols)
        places = np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, places).tolist() == [int((symbols[:i] == s).sum()) for i in places]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
         ("a.b.org", "/x", "allow"), ("b.org", "/x/yé", "block"), ("b.org", "/x/yé", "allow"), ("b.org", "", "block"), ("org", "/x/y漢z", "allow")]


def brute_url(i, url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    word = any(w in urls.WORDS for w in re.split("[.-]", host))
    return (i, host, path, *(max(fits)[2:] if fits else (None, "block" if word else "allow")))


@pytest.mark.parametrize("list_rows", [100, 2])
def test_urls(spark, list_rows):
    rng = random.Random(5)
    hosts = ["com", "xcom", "example.com", "www.example.com", "m.www.Example.COM", "badexample.com", "a.net", "net", "net.", "a.b.org", "c.a.b.org", "b.org", "x.org", "",
             "casino-win.example.org", "casinos.io", "my.porn", "a:80", "é.org", "com:80", "..com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "/es/", "/fr/a/b", "/x", "/x/yé", "/x/yéz", "/x/y漢z", "/x?/en/", "/#/en/", "?q=/en/", "#a", "//en/", "/en/\nx", "/" + "p" * 100_000]
    rows = [(i, rng.choice(["http", "HTTPS", "", "x://y"]) + "://" + rng.choice(hosts) + rng.choice(paths)) for i in range(600)]
    rows += [(None, "http://a.net/es/"), (700, None), (701, ""), (702, "no scheme/en/"), (703, "//com/"), (3, rows[3][1]), (3, rows[3][1]), (3, "http://com/")]
    table = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in rows], "page_id bigint, url string, host string, path string, rule string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("com", None, "block"), ("com", "/", None), ("io", "/", "maybe")], "host string, path string, verdict string")
    want = sorted((brute_url(i, u) for i, u in rows), key=str)
    # of the rules given as both, block wins
    want = [(*w[:4], "block") if w[3] == "b.org/x/yé" else w for w in want]
    got = urls.judge(table, rules, list_rows=list_rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert urls.judge(table.limit(0), rules, list_rows=list_rows).count() == 0
    bare = urls.judge(table, rules.limit(0), words=(), list_rows=list_rows).collect()
    assert len(bare) == len(rows) and {(r.rule, r.verdict) for r in bare} == {(None, "allow")}


def test_digest_collisions_are_confirmed():
    """Every key has the same digest: the stored strings decide."""
    same = lambda key: 7
    table = urls.DigestArray(np.frombuffer(urls.DigestArray.pack({"a": 1, "b": [2, 3], "é": "x"}, same), np.uint8))
    assert table.find(["b", "c", "é", "a", ""], same) == {"a": 1, "b": [2, 3], "é": "x"}
    none = urls.DigestArray(np.frombuffer(urls.DigestArray.pack({}), np.uint8))
    assert none.find(["a"]) == {} and none.find([]) == {}


def brute_tree(leaves):
    """Root of a list of digests, and per leaf its siblings and the steps [(left, right)]."""
    steps, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for i, a in enumerate(at):
            run, j = runs[a // 3], a % 3
            steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
        nodes, at = [sha("".join(r)) for r in runs], [a // 3 for a in at]
    return nodes[0], steps


def brute_manifest(rows):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], text)))

    groups = {}
    for r in rows:
        changed = r[3] if r[3] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[3].replace("\n", "")
        groups.setdefault(r[1], []).append((r[0], leaf(r, r[3]), leaf(r, changed)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_tree([x[1] for x in groups[g]])
    root, upper = brute_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, upper):
        for (i, own, changed), steps in zip(groups[g], trees[g][1]):
            h = changed
            for a, b in steps + up:
                h = sha(a + h + b)
            out.append((i, own, trees[g][0], root, "".join(a + b for a, b in steps + up), h))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels,groups", [(2, 11), (1, 2), (3, 30)])
def test_manifest(spark, levels, groups):
    rng = random.Random(levels)
    names = [None, "", "é", "漢", "Z", "a", *(f"s{i}" for i in range(groups))]
    sizes = [1, 2, 3, 4, 9, 10, 28, 81, 82, 250]
    rows = []
    for g in names:
        for _ in range(rng.choice(sizes)):
            rows.append((len(rows) * 7 - 50, g, rng.choice([None, "", "en"]), rng.choice([None, "", "a\nb", "x", "line\n" * 50])))
    rows += [(5, "twice", "en", "same"), (5, "twice", "en", "same"), (5, "twice", "en", "other\n"), (None, "twice", "en", None), (None, None, None, None), (10**6, "long", None, "w \n" * 100_000)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "g", "h", 1, 2, 3) for r in rows], "doc_id bigint, source string, lang string, text string, g string, h string, pos int, n int, k0 int")
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.manifest(table, "doc_id", "source", merkle.row_hash([*fields, F.col("text")]), {"changed": merkle.row_hash([*fields, changed])}, levels=levels)
    got = out.select("id", "leaf", "subroot", "root", merkle.proof_text(F.col("path")).alias("p"), merkle.fold(F.col("changed"), F.col("path")).alias("f"),
                     (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("sound")).collect()
    assert all(r.sound for r in got)
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute_manifest(rows)
    none = merkle.manifest(table.limit(0), "doc_id", "source", F.col("text"))
    assert none.count() == 0


def test_numbers_of_one_hot_group(spark):
    """A group over many ranges, rows that are equal, and groups of one row."""
    rows = [("hot", i % 50) for i in range(2000)] + [(f"g{i}", 0) for i in range(20)]
    table = spark.createDataFrame(rows, "g string, v int").repartition(7)
    out = merkle.numbered(table, "g", ["v"]).collect()
    hot = sorted((r.pos, r.v) for r in out if r.g == "hot")
    assert [p for p, _ in hot] == list(range(2000)) and [v for _, v in hot] == sorted(v for _, v in hot)
    assert all(r.n == 2000 if r.g == "hot" else (r.pos, r.n) == (0, 1) for r in out)
