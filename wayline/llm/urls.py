"""URL filter: a sorted array of 64-bit digests in a mapped file, probed by binary search, confirmed by full strings.

The list holds rules (host, path, verdict) and words. Its keys are strings of three kinds: `h` and a host
that has rules (its value: the lengths of their paths), `r` and host and path (the verdict), `w` and a word
of a host name (blocked). The file has the sorted xxhash64 digests, then places and strings of the keys. It is
written once to the shared folder (one that pyarrow can open) and shipped to every executor, where all Python workers map the same pages.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import shared_folder, small_batches

#: Rules that the mapped array takes; with more, probes and keys are joined by shuffle.
LIST_ROWS = 4_000_000
#: Words of a host name that block a url without a rule; a default, pass any other.
WORDS = ("adult", "casino", "poker", "porn", "viagra", "xxx")
SEED = 42


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and without `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: str) -> list[str]:
    """The host and all its parent domains."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))]


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode(), SEED)


class DigestArray:
    """Keys and values of a list: sorted digests, where each key lies, the key strings, JSON values."""

    def __init__(self, data: np.ndarray):
        n, size = (int(x) for x in data[:16].view("<u8"))
        self.digests = data[16 : 16 + 8 * n].view("<u8")
        self.places = data[16 + 8 * n : 16 + 8 * n + 8 * (2 * n + 1)].view("<u8")
        self.text = data[16 + 8 * n + 8 * (2 * n + 1) :][:size]

    @staticmethod
    def pack(entries: dict[str, object], digest=digest) -> bytes:
        keys = sorted(entries, key=lambda k: (digest(k), k))
        strings = [s for k in keys for s in (k.encode(), json.dumps(entries[k]).encode())]
        text = b"".join(strings)
        places = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype("<u8")
        return np.array([len(keys), len(text)], "<u8").tobytes() + np.array([digest(k) for k in keys], "<u8").tobytes() + places.tobytes() + text

    def _string(self, i: int) -> bytes:
        return self.text[int(self.places[i]) : int(self.places[i + 1])].tobytes()

    def find(self, keys: list[str], digest=digest) -> dict[str, object]:
        """Values of those keys that are in the list: one vectorised binary search, then full strings."""
        wanted = np.array([digest(k) for k in keys], np.uint64)
        low, high = (np.searchsorted(self.digests, wanted, side) for side in ("left", "right"))
        out = {}
        for j in np.flatnonzero(high > low).tolist():
            own = keys[j].encode()
            for i in range(int(low[j]), int(high[j])):  # more than one only where digests collide
                if self._string(2 * i) == own:
                    out[keys[j]] = json.loads(self._string(2 * i + 1))
        return out


def _entries(rules: list[tuple[str, str, str]], words: Sequence[str]) -> dict[str, object]:
    """Keys and values; a rule given as both is blocked."""
    out: dict[str, object] = {}
    for host, path, verdict in rules:
        lengths = out.setdefault(f"h{host}", [])
        if len(path) not in lengths:
            lengths.append(len(path))
        if out.get(f"r{host}{path}") != "block":
            out[f"r{host}{path}"] = verdict
    return {**out, **{f"w{w}": "block" for w in words}}


_MAPPED: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    """One for each Python worker; the pages are shared by all workers of a machine."""
    if name not in _MAPPED:
        _MAPPED[name] = DigestArray(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    return _MAPPED[name]


def publish(spark: SparkSession, entries: dict[str, object]) -> str:
    """Write the file to the shared folder and ship it to every executor, also to those that come later; its name."""
    name, folder = f"urls-{uuid.uuid4().hex}", shared_folder(spark, "urls")
    store, path = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{name}") as f:
        f.write(DigestArray.pack(entries))
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def _best(paths: list[tuple[str, str]], find) -> dict[tuple[str, str], tuple[str, str]]:
    """Rule and verdict of each distinct (host, path) that a rule fits: the longest rule, then the longest host."""
    hosts = {h: suffixes(h) for h, _ in paths}
    lengths = find(list({f"h{s}" for all_ in hosts.values() for s in all_}))
    probes = {}
    for h, p in paths:
        probes[h, p] = [(n + len(s), len(s), s + p[:n]) for s in hosts[h] for n in lengths.get(f"h{s}", ()) if n <= len(p)]
    found = find(list({f"r{key}" for all_ in probes.values() for _, _, key in all_}))
    out = {}
    for at, all_ in probes.items():
        fits = [x for x in all_ if f"r{x[2]}" in found]
        if fits:
            key = max(fits)[2]
            out[at] = key, found[f"r{key}"]
    return out


def host_words(host: str) -> list[str]:
    return [w for w in host.replace("-", ".").split(".") if w]


def _clean(rules: DataFrame) -> DataFrame:
    cols = [F.col(c).cast("string").alias(c) for c in ("host", "path", "verdict")]
    return rules.select(*cols).where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def judge(urls: DataFrame, rules: DataFrame, words: Sequence[str] = WORDS, id_col: str = "page_id", url_col: str = "url",
          list_rows: int = LIST_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the
    rule's. The longest rule wins, among equally long ones that of the longer host; of rules of one host
    and path, block wins; rules with a null or another verdict count for nothing. A url that no rule fits
    is blocked if a word of its host (parts between dots and hyphens) is one of `words`, else allowed,
    with a null rule. Null urls and those without `://` have an empty host and path. Every row is
    judged for itself: repeated rows and ids stay, urls of any length are taken whole, empty tables
    of urls or rules are fine, other columns are not read.
    """
    spark = urls.sparkSession
    small_batches(spark)
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select("id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    known = _clean(rules)
    few = known.limit(list_rows + 1).toArrow()
    if few.num_rows > list_rows:
        return _judge_by_join(rows, known, words)
    name = publish(spark, _entries(list(zip(*(few.column(c).to_pylist() for c in ("host", "path", "verdict")))), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _mapped(name)
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            pairs = list(zip(hosts, paths))
            best = _best(list(dict.fromkeys(pairs)), table.find)
            parts = {h: host_words(h) for h in set(hosts)}
            bad = table.find(list({f"w{w}" for ws in parts.values() for w in ws}))
            blocked = {h for h, ws in parts.items() if any(f"w{w}" in bad for w in ws)}
            rule = [best[x][0] if x in best else None for x in pairs]
            verdict = [best[x][1] if x in best else "block" if x[0] in blocked else "allow" for x in pairs]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=["id", "host", "path", "rule", "verdict"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(rows: DataFrame, rules: DataFrame, words: Sequence[str]) -> DataFrame:
    """The same for lists of any size: distinct hosts meet the rule hosts, distinct prefixes the rules, by digest and string."""
    dots = F.split("host", r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, i, F.size(dots)), "."))
    sizes = rules.select(F.col("host").alias("_s"), F.length("path").alias("_n")).distinct()
    hosts = rows.select("host").distinct().select("host", F.explode(below).alias("_s"))
    lengths = hosts.join(sizes, "_s")
    pairs = rows.select("host", "path").distinct()
    probes = pairs.join(lengths, "host").where(F.length("path") >= F.col("_n")).withColumn("_p", F.expr("substring(path, 1, _n)"))
    keys = rules.select(F.col("host").alias("_s"), F.col("path").alias("_p"), F.xxhash64("host", "path").alias("_d"), "verdict")
    fits = probes.withColumn("_d", F.xxhash64("_s", "_p")).join(keys, ["_d", "_s", "_p"])
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct((F.length("_s") + F.length("_p")).alias("n"), F.length("_s").alias("m"), F.concat("_s", "_p").alias("rule"), "verdict")).alias("_b"))
    bad = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in words]).cast("array<string>")) if words else F.lit(False)
    none = F.when(bad, "block").otherwise("allow")
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("_b.rule").alias("rule"), F.coalesce("_b.verdict", none).alias("verdict"))
