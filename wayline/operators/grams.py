"""N-grams in packed form, for statistics that count them over a whole corpus.

A task takes texts in pieces, hashes their n-grams and writes, for each piece and bucket of n-grams, one row that
holds all of them as arrays. Buckets are what Spark shuffles and groups; a bucket has `GRAM_BUCKET` n-grams on average,
whatever the size of the corpus. An n-gram is told apart by 64 bits inside its bucket, and the bucket is drawn by a
second hash, so large corpora, which have many buckets, need more than a clash of 64 bits to mistake one for another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a piece (a longer text stays whole), texts that the numbers of a piece tell apart, n-grams of a bucket on average.
GRAM_TOKENS, GRAM_TEXTS, GRAM_BUCKET = 1 << 20, 1 << 16, 2 << 20
_KEY, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hashed(words: Column | str) -> Column:
    """64-bit hashes of an array of words; none for null."""
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def buckets(words: DataFrame, size: Column) -> int:
    """How many buckets the n-grams of one order fill."""
    total = words.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-total // GRAM_BUCKET))


@dataclass
class Piece:
    """Some texts, one after the other: number of the first, and for each token its hash, its text and the tokens from it to the end."""

    first: int
    words: np.ndarray
    owner: np.ndarray
    left: np.ndarray
    at: np.ndarray
    seeds: np.ndarray
    tokens: pa.Array | None

    def grams(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(order, positions, hashes, second hashes) of the orders 1..n."""
        at = self.at
        key = place = self.seeds[self.owner[at]]
        for m in range(1, n + 1):
            alive = self.left[at] >= m
            at = at[alive]
            key, place = _step(key[alive], place[alive], self.words[at + (m - 1)])
            yield m, at, key, place


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _step(key: np.ndarray, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (place ^ word) * _PLACE
    return _mix(key * _KEY + word), place ^ (place >> np.uint64(29))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """Texts (_x number, _g seed, _h hashes, maybe _s positions that begin n-grams and _t tokens) in pieces."""
    for b in batches:
        lists = b.column("_h")
        ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        x = b.column("_x").to_numpy(zero_copy_only=False)
        seeds = b.column("_g").to_numpy(zero_copy_only=False).view(np.uint64)
        starts = b.column("_s").to_numpy(zero_copy_only=False) if "_s" in b.schema.names else None
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + GRAM_TOKENS, "right")) - 1)
            far = np.flatnonzero((x[i:j] < x[i]) | (x[i:j] >= x[i] + GRAM_TEXTS))
            j = i + int(far[0]) if len(far) else j
            size = np.diff(ends[i : j + 1])
            owner = np.repeat(np.arange(j - i), size)
            place = np.arange(int(size.sum()))
            at = place if starts is None else place[place - (ends[i:j] - ends[i])[owner] < starts[i:j][owner]]
            tokens = b.column("_t").slice(i, j - i).flatten() if "_t" in b.schema.names else None
            yield Piece(int(x[i]), flat[ends[i] : ends[j]], (x[i:j] - x[i])[owner] if starts is None else owner, (ends[i + 1 : j + 1] - ends[i])[owner] - place, at,
                        _seeds(seeds[i:j], x[i:j] - x[i]) if starts is None else seeds[i:j], tokens)
            i = j


def _seeds(seeds: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Seeds by number, which may have gaps."""
    out = np.zeros(int(number.max()) + 1, np.uint64)
    out[number] = seeds
    return out


def _cuts(sorted_ids: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    if not len(sorted_ids):
        return []
    edge = np.concatenate([[0], np.flatnonzero(np.diff(sorted_ids)) + 1, [len(sorted_ids)]])
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def distinct_grams(rows: DataFrame, n: int, count: int) -> DataFrame:
    """(_g, _m, kinds, total) for parts of the n-grams of rows (_g, _h, _s): their sums are the distinct and all n-grams of a seed and order."""
    schema = "_g long, _m int, _b int, h binary, n long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            codes, code = np.unique(p.seeds, return_inverse=True)
            out = []
            for m, at, key, place in p.grams(n):
                slot = code[p.owner[at]] * count + ((place >> np.uint64(33)) % np.uint64(count)).astype(np.int64)
                total = dict(zip(*(v.tolist() for v in np.unique(slot, return_counts=True))))
                kinds, first = np.unique(key, return_index=True)
                slot = slot[first]
                order = np.argsort(slot, kind="stable")
                kinds, slot = kinds[order], slot[order]
                for a, z in _cuts(slot):
                    s = int(slot[a])
                    out.append((int(codes[s // count].astype(np.int64)), m, s % count, kinds[a:z].tobytes(), total[s]))
            yield from _batches(out, [("_g", pa.int64()), ("_m", pa.int32()), ("_b", pa.int32()), ("h", pa.binary()), ("n", pa.int64())])

    def merge(t: pa.Table) -> pa.Table:
        kinds = len(np.unique(_joined(t["h"], np.uint64)))
        return pa.table({"_g": t["_g"].slice(0, 1), "_m": t["_m"].slice(0, 1), "kinds": pa.array([kinds], pa.int64()),
                         "total": pa.array([sum(t["n"].to_pylist())], pa.int64())})

    packed = rows.select(F.lit(0).cast("long").alias("_x"), "_g", "_h", F.col("_s").cast("long").alias("_s")).mapInArrow(pack, schema)
    return packed.groupBy("_g", "_m", "_b").applyInArrow(merge, "_g long, _m int, kinds long, total long")


def _batches(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a few MB."""
    for i in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[i : i + 512]), fields)], names=[f for f, _ in fields])


def _tops(key: np.ndarray, c: np.ndarray, d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each n-gram its top count, the highest count of any other text, and the text of the top."""
    order = np.argsort(key, kind="stable")
    key, c, d, x = key[order], c[order], d[order], x[order]
    start = _starts(key)
    if not len(start):
        return key, c, d, x
    run = np.repeat(np.arange(len(start)), np.diff([*start, len(key)]))
    top = np.maximum.reduceat(c, start)
    at = np.minimum.reduceat(np.where(c == top[run], np.arange(len(key)), len(key)), start)
    rest = c.copy()
    rest[at] = 0
    second = np.maximum(np.maximum.reduceat(rest, start), np.maximum.reduceat(d, start))
    return key[start], top, second, x[at]


def top_counts(words: DataFrame, n: int, count: int) -> DataFrame:
    """Packed rows (bucket, number of the first text, n-grams, texts, top and second counts) of the 1..n-grams of texts (_x, _g, _h)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            out = []
            for m, at, key, place in p.grams(n):
                if not len(key):
                    continue
                order = np.argsort(key, kind="stable")  # the texts of an n-gram stay in order
                key, place, owner = key[order], place[order], p.owner[at][order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
                c = np.diff([*new, len(key)])
                key, top, second, x = _tops(key[new], c, np.zeros(len(new), np.int64), np.stack([owner[new], place[new].view(np.int64)], 1))
                slot = ((x[:, 1].view(np.uint64) >> np.uint64(33)) % np.uint64(count)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                key, top, second, x, slot = (v[order] for v in (key, top, second, x[:, 0], slot))
                x = np.where(top > second, x, 0)
                for a, z in _cuts(slot):
                    out.append(((m - 1) * count + int(slot[a]), p.first, key[a:z].tobytes(), x[a:z].astype(np.uint16).tobytes(),
                                top[a:z].astype(np.uint32).tobytes(), second[a:z].astype(np.uint32).tobytes()))
            yield from _batches(out, [("_b", pa.int64()), ("_x", pa.int64()), *[(v, pa.binary()) for v in "hxcd"]])

    return words.select("_x", "_g", "_h").mapInArrow(pack, "_b long, _x long, h binary, x binary, c binary, d binary")


def losses(packed: DataFrame, count: int) -> DataFrame:
    """(_x, m, loss) sums of parts: by how much the count of a text is above that of all others, over its n-grams of one order."""

    def merge(t: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(v, np.uint16).astype(np.int64) + f for v, f in zip(t["x"].to_pylist(), t["_x"].to_pylist())])
        c, d = (_joined(t[v], np.uint32).astype(np.int64) for v in "cd")
        _, top, second, x = _tops(_joined(t["h"], np.uint64), c, d, x)
        alone = top > second
        x, loss = _summed(x[alone], (top - second)[alone])
        m = t["_b"][0].as_py() // count + 1
        return pa.table({"_x": pa.array(x, pa.int64()), "m": pa.array(np.full(len(x), m), pa.int32()), "loss": pa.array(loss, pa.int64())})

    return packed.groupBy("_b").applyInArrow(merge, "_x long, m int, loss long")


def _summed(x: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the values of each number."""
    order = np.argsort(x, kind="stable")
    start = _starts(x[order])
    return x[order][start], (np.add.reduceat(value[order], start) if len(start) else value)


def _shared_key(p: Piece, n: int, substring: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(positions, n-gram hashes, keys, second keys, words) of the n-grams of a piece.

    N-grams that may match share a key: equal ones, or with `substring` those of the same inner tokens whose first tokens end,
    and whose last tokens begin, with the same character.
    """
    if not substring:
        *_, (_, at, key, place) = p.grams(n)
        return at, key, key, place, None
    *_, (_, at, gram, _) = p.grams(n)
    coded = p.tokens.dictionary_encode()
    words = np.array(coded.dictionary.to_pylist(), object)
    code = coded.indices.to_numpy(zero_copy_only=False)
    last, first = (np.array([ord(w[i]) for w in words], np.uint64) for i in (-1, 0))
    key = place = p.seeds[p.owner[at]]
    for k in range(1, n - 1):
        key, place = _step(key, place, p.words[at + k])
    key, place = _step(key, place, last[code[at]] << np.uint64(32) | first[code[at + n - 1]])
    return at, gram, key, place, words[code]


def _counted(p: Piece, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first position of every n-gram of a text (as indexes of `at`), and how often the text has it."""
    order = np.lexsort([gram, p.owner[at]])
    g, o = gram[order], p.owner[at][order]
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])])) if len(g) else np.empty(0, np.int64)
    return order[new], np.diff([*new, len(g)])


def frequent_keys(words: DataFrame, n: int, substring: bool, count: int, limit: int) -> np.ndarray:
    """Sorted keys that more than `limit` (text, n-gram) have; there are no more than their total over `limit`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            at, gram, key, place, _ = _shared_key(p, n, substring)
            own, _ = _counted(p, at, gram)
            kinds, first, times = np.unique(key[own], return_index=True, return_counts=True)
            slot = ((place[own][first] >> np.uint64(33)) % np.uint64(count)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            kinds, times, slot = kinds[order], times[order].astype(np.uint32), slot[order]
            yield from _batches([(int(slot[a]), kinds[a:z].tobytes(), times[a:z].tobytes()) for a, z in _cuts(slot)],
                                [("_b", pa.int64()), ("h", pa.binary()), ("c", pa.binary())])

    def merge(t: pa.Table) -> pa.Table:
        kinds, times = _summed(_joined(t["h"], np.uint64), _joined(t["c"], np.uint32).astype(np.int64))
        return pa.table({"key": pa.array(kinds[times > limit].view(np.int64), pa.int64())})

    found = _inputs(words, substring).mapInArrow(pack, "_b long, h binary, c binary").groupBy("_b").applyInArrow(merge, "key long").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _inputs(words: DataFrame, substring: bool) -> DataFrame:
    return words.select("_x", "_g", "_h", *(["_t"] if substring else []))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.isin(keys, known) if len(known) else np.zeros(len(keys), bool)


def plain_grams(words: DataFrame, n: int, substring: bool, keys: np.ndarray) -> DataFrame:
    """Rows (_g, _x, first, inner, last tokens, count) of the n-grams with the given keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            at, gram, key, _, _ = _shared_key(p, n, substring)
            own, times = _counted(p, at, gram)
            of = _among(key[own], keys)
            own, times = own[of], times[of]
            for i in range(0, len(own), 4096):
                a = at[own[i : i + 4096]]
                t = [p.tokens.take(pa.array(a + k)).to_pylist() for k in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(p.seeds[p.owner[a]].view(np.int64), pa.int64()), pa.array(p.owner[a] + p.first, pa.int64()), pa.array(t[0], pa.string()),
                    pa.array([" ".join(w) for w in zip(*t[1:-1])] if n > 2 else [""] * len(a), pa.string()), pa.array(t[-1], pa.string()),
                    pa.array(times[i : i + 4096], pa.int64())], names=["_g", "_x", "a", "m", "z", "_c"])

    return _inputs(words, True).mapInArrow(rows, "_g long, _x long, a string, m string, z string, _c long")


def repeated(words: DataFrame, n: int, substring: bool, count: int, but: np.ndarray) -> DataFrame:
    """(_x, s) sums of parts: over the n-grams of a text, how often it has one times the other texts that contain it. Without the n-grams of the keys `but`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            at, gram, key, place, tokens = _shared_key(p, n, substring)
            own, times = _counted(p, at, gram)
            of = ~_among(key[own], but)
            own, times = own[of], times[of]
            slot = ((place[own] >> np.uint64(33)) % np.uint64(count)).astype(np.int64)
            order = np.lexsort([key[own], slot])
            own, times, slot = own[order], times[order].astype(np.uint32), slot[order]
            h, x, out = key[own], p.owner[at[own]].astype(np.uint16), []
            for a, z in _cuts(slot):
                outer = ["\n".join(tokens[at[own[a:z]] + k]) for k in (0, n - 1)] if substring else [None, None]
                out.append((int(slot[a]), p.first, h[a:z].tobytes(), x[a:z].tobytes(), times[a:z].tobytes(), *outer))
            yield from _batches(out, [("_b", pa.int64()), ("_x", pa.int64()), *[(v, pa.binary()) for v in "hxc"], ("a", pa.string()), ("z", pa.string())])

    def merge(t: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(v, np.uint16).astype(np.int64) + f for v, f in zip(t["x"].to_pylist(), t["_x"].to_pylist())])
        h, c = _joined(t["h"], np.uint64), _joined(t["c"], np.uint32).astype(np.int64)
        if substring:
            # a token has no white space
            texts = _containing(h, *(np.array("\n".join(t[v].to_pylist()).split("\n"), object) for v in "az"), x)
        else:
            _, code, texts = np.unique(h, return_inverse=True, return_counts=True)
            texts = texts[code]
        more = texts > 1
        x, s = _summed(x[more], (c * (texts - 1))[more])
        return pa.table({"_x": pa.array(x, pa.int64()), "s": pa.array(s, pa.int64())})

    packed = _inputs(words, substring).mapInArrow(pack, "_b long, _x long, h binary, x binary, c binary, a string, z string")
    return packed.groupBy("_b").applyInArrow(merge, "_x long, s long")


def _shorter(words: list[str], suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each word the words that it properly ends (or begins) with: where its part begins, and their numbers."""
    number = {w: i for i, w in enumerate(words)}
    sizes = sorted({len(w) for w in words})
    found, begin = [], np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(words):
        size = len(w)
        for k in sizes:
            if k >= size:
                break
            j = number.get(w[size - k :] if suffix else w[:k])
            if j is not None:
                found.append(j)
        begin[i + 1] = len(found)
    return begin, np.array(found, np.int64)


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated by count, and the number inside each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _find(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Position in a sorted array, -1 where it is not there."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _containing(key: np.ndarray, a: np.ndarray, z: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For rows (key, outer tokens, text), how many texts have the key with outer tokens that end, and begin, with those of the row.

    Only rows of a key with several n-grams are compared. The shorter forms of a token are looked up, among the
    pairs that exist, so that the work follows the tokens and matches, not the pairs of rows.
    """
    _, run = np.unique(key, return_inverse=True)
    (ac, aw), (zc, zw) = pd.factorize(a), pd.factorize(z)
    pairs, pair = np.unique(run * len(aw) + ac, return_inverse=True)
    grams, gram = np.unique(pair * len(zw) + zc, return_inverse=True)
    texts = np.bincount(gram)
    of_pair, of_z = grams // len(zw), grams % len(zw)
    of_run = pairs[of_pair] // len(aw)
    long = np.flatnonzero(np.bincount(of_run)[of_run] > 1)
    if not len(long):
        return texts[gram]
    # shorter first tokens, and the same one
    used = np.zeros(len(aw), bool)
    used[pairs[of_pair[long]] % len(aw)] = True
    names = np.flatnonzero(used)
    begin, to = _shorter([aw[i] for i in names.tolist()], True)
    at = np.searchsorted(names, pairs[of_pair[long]] % len(aw))
    row, k = _spread(begin[at + 1] - begin[at])
    other = _find(of_run[long[row]] * len(aw) + names[to[begin[at[row]] + k]] if len(row) else np.empty(0, np.int64), pairs)
    there = other >= 0
    source, target = np.concatenate([long, long[row[there]]]), np.concatenate([of_pair[long], other[there]])
    # shorter last tokens, and the same one
    used = np.zeros(len(zw), bool)
    used[of_z[long]] = True
    names = np.flatnonzero(used)
    begin, to = _shorter([zw[i] for i in names.tolist()], False)
    at = np.searchsorted(names, of_z[source])
    row, k = _spread(begin[at + 1] - begin[at])
    same = _find(target * len(zw) + of_z[source], grams)
    other = _find(target[row] * len(zw) + names[to[begin[at[row]] + k]] if len(row) else np.empty(0, np.int64), grams)
    source, target = np.concatenate([source, source[row]]), np.concatenate([same, other])
    ok = (target >= 0) & (target != source)
    source, target = source[ok], target[ok]
    if not len(source):
        return texts[gram]
    # the texts of the longer forms, and their own
    order = np.argsort(gram, kind="stable")
    begin = np.concatenate([[0], np.cumsum(texts)])
    source, target = np.concatenate([source, np.unique(target)]), np.concatenate([target, np.unique(target)])
    row, k = _spread(texts[source])
    number, code = np.unique(x, return_inverse=True)
    met = np.unique(target[row] * len(number) + code[order[begin[source[row]] + k]])
    hit, times = np.unique(met // len(number), return_counts=True)
    texts = texts.copy()
    texts[hit] = times
    return texts[gram]
