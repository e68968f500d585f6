"""Token ids in a compact binary form: canonical length-limited Huffman codes in independent blocks.

A folder holds `codes` (id, length: the whole code book, for it is canonical) and `blocks`, in
ascending order of the document ids. A block has whole documents, each starting on a byte, and the bit
offset of every MARK-th id, so that a reader can start anywhere and decode many runs side by side from
one table of 2**LIMIT entries. Code lengths come from the counts of all ids (package-merge).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import shared_folder, slices, small_batches

#: Longest code in bits; 2**LIMIT bounds the ids that can occur.
LIMIT = 16
#: Ids between two bit offsets, ids of a block, ids of an output file.
MARK = 128
BLOCK = 1 << 16
FILE = 1 << 23
#: Output files at most; their first offsets are computed in one small task.
FILES = 20_000
#: Words that a worker remembers.
WORD_CACHE = 1_000_000
#: Words that are encoded in one call.
TOGETHER = 256
#: Text bytes tokenized at once: the more, the fewer words are met again.
TEXT_BYTES = 8 << 20
#: Control characters that Arrow takes for white space and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"
#: Letters below this one fold to lower case here as in the tokenizer, but for the dotted capital I.
_FOLDED = "\u0180"


class _Words:
    """Ids of words from the tokenizers library; remembers the first, hence frequent, ones as one Arrow array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        vocab = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        raw = [t.content for t in tokenizer.get_added_tokens_decoder().values() if not t.normalized]
        #: of no fold or cut: characters of other scripts, and what added tokens, which match the raw text only, begin with
        self.whole = "|".join([rf"[^\x00-\x{{{ord(_FOLDED) - 1:x}}}]", r"\x{130}", *sorted({rf"\x{{{ord(t[0]):x}}}\x{{{ord(t[1]):x}}}" for t in raw})])
        self.known, self.sizes, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def fresh(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Those of letters only are encoded many at a time: each ends with a token that ends a word."""
        plain = [w for w in words if w.isalpha() and max(w) < _FOLDED]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        out = {}
        for group, e in zip(groups, self.encode([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(group):
                data = ids.tobytes()
                out.update(zip(group, [data[a:b] for a, b in zip([0, *stops], stops)]))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self.ids_of(rest)))
        return [out[w] for w in words]

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each distinct word in a list, and sizes and ids of the list's words one after the other."""
        place = pc.index_in(words, value_set=self.known)
        new = place.is_null().to_numpy(zero_copy_only=False)
        out = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        sizes, flat = self.sizes, self.flat
        if new.any():
            more = words.filter(pa.array(new))
            data = self.fresh(more.to_pylist())
            out[new] = len(sizes) + np.arange(len(more))
            sizes = np.concatenate([sizes, np.fromiter(map(len, data), np.int64, len(data)) // 4])
            flat = np.concatenate([flat, np.frombuffer(b"".join(data), np.uint32)])
            if len(sizes) <= WORD_CACHE:
                self.known, self.sizes, self.flat = pa.concat_arrays([self.known, more]), sizes, flat
        return out, sizes, flat

    def words_of(self, pieces: pa.Array) -> pa.Array:
        """Lists of words of white-space separated pieces, whose ids one after the other are those of the piece.

        The tokenizer folds case and cuts before and after every digit, after every run of letters, and
        before one unless an apostrophe stands there. Other pieces stay whole.
        """
        cut = pc.replace_substring_regex(pc.utf8_lower(pieces), "([0-9])", r" \1 ")
        cut = pc.replace_substring_regex(cut, r"(\pL)([^\pL ])", r"\1 \2")
        cut = pc.replace_substring_regex(cut, r"([^\pL' ])(\pL)", r"\1 \2")
        return pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(pieces, self.whole), pieces, cut))

    def encoded(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, `end` after each, and where each text stops."""
        odd = pc.match_substring_regex(texts, f"[{_ODD}]")
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        pieces, piece_of, ends = _coded(pc.utf8_split_whitespace(pc.if_else(odd, "", texts)))
        words, word_of, cuts = _coded(self.words_of(pieces))
        place, sizes, flat = self.look_up(words)
        word_ids, stops = _expand(place[word_of], sizes, flat)
        # ids of the pieces; then of the texts taken whole, which have one empty piece; the last entry ends a text
        more = [*self.ids_of(texts.take(pa.array(whole)).to_pylist()), end]
        sizes = np.concatenate([np.diff(stops[cuts]), [len(x) // 4 for x in more]])
        flat = np.concatenate([word_ids, np.frombuffer(b"".join(more), np.uint32)])
        piece_of[ends[whole]] = len(pieces) + np.arange(len(whole))
        codes, ends = np.insert(piece_of, ends[1:], len(sizes) - 1), ends + np.arange(len(ends))
        out, to = _expand(codes, sizes, flat)
        return to[ends], out


_MADE: dict[str, _Words] = {}


def _words(path: str) -> _Words:
    """One for each Python worker, which serves many tasks."""
    if path not in _MADE:
        _MADE[path] = _Words(path)
    return _MADE[path]


def _expand(codes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of the lists `codes` one after the other, and where each list ends up; `flat` has lists of these sizes."""
    n = sizes[codes]
    to = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - to[:-1], n) + np.arange(to[-1])], to


def _coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct items of lists, the code of each item, and the offsets of the lists."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), ends - ends[0]


def _gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until the column holds about `size` bytes."""
    held, total = [], 0
    for b in slices(batches, column, size):
        held.append(b)
        total += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids): the ids of every whole text and `end_id` at the end, as little-endian unsigned 32-bit integers.

    For vocabularies that drop white space: a text's ids are those of its white-space separated pieces.
    Distinct pieces of a batch are cut into words, and each distinct word is encoded once as long as a worker
    remembers it.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = _words(path), np.uint32(end_id).tobytes()
        for b in _gathered(batches, "text", TEXT_BYTES):
            stops, ids = coder.encoded(pc.fill_null(b.column("text"), ""), end)
            data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((4 * stops).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(stops)), data], names=["id", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, ids binary")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # per level: which of the sorted coins are items; pairs of a level are coins of the next
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        coins = np.concatenate([weight, packages])
        rank = np.argsort(coins, kind="stable")
        levels.append(rank < len(weight))
        coins = coins[rank]
        packages = coins[: len(coins) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(order) - 2
    for level in reversed(levels):
        items = int(level[:take].sum())
        out[order[:items]] += 1
        take = 2 * (take - items)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: ascending by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, before = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        code <<= n - before
        codes[i], before = code, n
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each value of the next `limit` bits."""
    codes = canonical(lengths)
    ids, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.int64)
    for i in np.flatnonzero(lengths).tolist():
        n = int(lengths[i])
        first = int(codes[i]) << (limit - n)
        ids[first : first + (1 << (limit - n))] = i
        sizes[first : first + (1 << (limit - n))] = n
    return ids, sizes


def pack(ids: np.ndarray, ends: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, list[np.ndarray]]:
    """Bit stream of several documents that start on bytes, their byte offsets, and bit offsets of every MARK-th id."""
    size = lengths[ids].astype(np.int64)
    if (size == 0).any():
        raise ValueError("an id without a code")
    inside = np.concatenate([[0], np.cumsum(size)])
    bits = inside[ends[1:]] - inside[ends[:-1]]
    starts = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    at = inside[:-1] + np.repeat(8 * starts[:-1] - inside[ends[:-1]], np.diff(ends))
    word, shift = at >> 5, (64 - size - (at & 31)).astype(np.uint64)
    value = codes[ids] << shift
    total = int(starts[-1] * 8 + 63) // 32 + 1
    # sums of disjoint bits below 2**32, exact in float64
    high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=total)
    low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total)
    stream = (high[:total] + low[:total]).astype(np.uint64).astype(">u4").tobytes()[: int(starts[-1])]
    marks = [(at[a:b:MARK] - 8 * starts[i]).astype(np.int64) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
    return stream, starts, marks


def unpack(stream: bytes, at: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of the runs that start at the bits `at` and have `count` ids, one after the other; all runs step together."""
    ids, sizes = table
    limit = len(ids).bit_length() - 1
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    wide = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.empty(int(count.sum()), np.uint32)
    order = np.argsort(-count, kind="stable")
    at, count, to = at[order].copy(), count[order], (np.cumsum(count) - count)[order]
    # runs are ordered by length, so those that go on are a prefix
    live = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1 if len(count) else 1), side="right")
    for step, n in enumerate(live.tolist()):
        p = at[:n]
        key = (wide[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[to[:n] + step] = ids[key]
        at[:n] += sizes[key]
    return out


def write_tokens(tokens: DataFrame, folder: str) -> None:
    """Write rows (id, n, ids) to `folder` in ascending order of id (null first); counts all ids before."""
    spark = tokens.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in slices(batches, "ids"):
            c = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), np.uint32))
            wide, thin = (total, c) if len(total) >= len(c) else (c, total)
            wide[: len(thin)] += thin
            total = wide
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own], pa.int64())], names=["token", "c"])

    counted = tokens.select("ids").mapInArrow(tally, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c")).toArrow()
    token, c = counted.column("token").to_numpy(), counted.column("c").to_numpy()  # no more rows than the vocabulary has
    counts = np.zeros(int(token.max()) + 1 if len(token) else 1, np.int64)
    counts[token] = c
    lengths = code_lengths(counts)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "token bigint, length int").coalesce(1).write.parquet(f"{folder}/codes")

    files = int(min(FILES, max(1, -(-int(c.sum() if len(c) else 0) // FILE))))
    cuts = sorted(set(tokens.where("id IS NOT NULL").approxQuantile("id", [i / files for i in range(1, files)], 1 / (20 * files)))) if files > 1 else []
    cuts = np.array([int(x) for x in cuts], np.int64)

    def part_of(ids: pa.Array) -> np.ndarray:
        return np.searchsorted(cuts, pc.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False)).astype(np.int32)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts) + 1, np.int64)
        for b in batches:
            np.add.at(total, part_of(b.column("id")), b.column("n").to_numpy())
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own])], names=["part", "s"])

    summed = tokens.select("id", "n").mapInArrow(sums, "part bigint, s bigint").groupBy("part").agg(F.sum("s").alias("s")).toArrow()  # a row for each file
    total = np.zeros(len(cuts) + 1, np.int64)
    total[summed.column("part").to_numpy()] = summed.column("s").to_numpy()
    base = (np.cumsum(total) - total).tolist()
    code = spark.sparkContext.broadcast((canonical(lengths), lengths))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = code.value
        for b in slices(batches, "ids"):
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), np.uint32)
            ends = np.concatenate([[0], np.cumsum(b.column("n").to_numpy())])
            stream, starts, marks = pack(ids, ends, codes, sizes)
            data = [stream[s:e] for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(part_of(b.column("id"))), b.column("n"), pa.array(data, pa.binary()), pa.array([m.tolist() for m in marks], pa.list_(pa.int64()))],
                names=["id", "part", "n", "data", "marks"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, start, serial = None, [], 0, 0

        def close():
            first = start - sum(h[1] for h in held)
            cells = [[now], [serial], [first], [[h[0] for h in held]], [[h[1] for h in held]], [[len(h[2]) for h in held]],
                     [[int(m) for h in held for m in h[3]]], [b"".join(h[2] for h in held)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, kinds)], names=names)

        names = ["part", "block", "first_token", "ids", "lengths", "sizes", "marks", "data"]
        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int64(), pa.int64(), longs, longs, longs, longs, pa.binary()]
        for b in batches:
            for i, p, n, data, marks in zip(*(b.column(c).to_pylist() for c in ("id", "part", "n", "data", "marks"))):
                if held and (p != now or inside >= BLOCK):
                    yield close()
                    held, serial = [], serial + 1
                if p != now:
                    now, start, serial = p, base[p], 0
                inside = n if not held else inside + n
                held.append((i, n, data, marks))
                start += n
        if held:
            yield close()

    packed = tokens.select("id", "n", "ids").mapInArrow(encode, "id bigint, part int, n bigint, data binary, marks array<bigint>")
    dealt = packed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("id"), "n", "data")
    out = dealt.mapInArrow(blocks, "part int, block bigint, first_token bigint, ids array<bigint>, lengths array<bigint>, sizes array<bigint>, marks array<bigint>, data binary")
    out.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n, ids) of every document in the folder: ids before it, its ids as in `tokenize`."""
    small_batches(spark)
    book = spark.read.parquet(f"{folder}/codes").toArrow()
    token, length = book.column("token").to_numpy(), book.column("length").to_numpy()
    lengths = np.zeros(int(token.max()) + 1 if len(token) else 1, np.uint8)
    lengths[token] = length
    table = spark.sparkContext.broadcast(decode_table(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                first, ids, n, size, marks, data = (batch.column(c)[r].as_py() for c in ("first_token", "ids", "lengths", "sizes", "marks", "data"))
                n, starts = np.array(n, np.int64), np.concatenate([[0], np.cumsum(size)])
                runs = -(-n // MARK)
                owner = np.repeat(np.arange(len(n)), runs)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
                count = np.minimum(MARK, n[owner] - step * MARK)
                flat = unpack(data, np.array(marks, np.int64) + 8 * starts[owner], count, table.value)
                ends = np.concatenate([[0], np.cumsum(n)])
                for i in range(0, len(n), 500):
                    j = min(i + 500, len(n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i:j], pa.int64()), pa.array(first + ends[i:j]), pa.array(n[i:j]),
                         pa.array([flat[ends[k] : ends[k + 1]].tobytes() for k in range(i, j)], pa.binary())], names=["id", "start", "n", "ids"])

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(run, "id bigint, start bigint, n bigint, ids binary")


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Tokenize the documents, write them below the shared folder and read them back: (id, start, n, ids).

    Null and empty texts have the end id only. Documents of one id (or none) are ordered by length and
    content. An empty table writes an empty archive. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    tokenize(docs, path, end_id).write.option("compression", "zstd").parquet(f"{folder}/raw")
    write_tokens(spark.read.parquet(f"{folder}/raw"), folder)
    return read_tokens(spark, folder)
