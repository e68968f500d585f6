"""Fill-in-the-middle rearrangement; cuts are found with ranks of a wavelet matrix.

The texts of a batch become one sequence of byte classes, three bits each: white space or not, UTF-8
continuation byte or line feed, first of a run or not. A wavelet matrix over the classes answers how
often a class occurs before a place. Sums of such ranks count the unit borders before any place, and
bisection on the counts finds both cuts of all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import slices, small_batches

#: Classes: white space and line feeds inside a run (0, 2) and first of one (1, 3), characters inside
#: a run of others (4) and first of one (5), continuation bytes of a character (6).
SPACE_INSIDE, SPACE_FIRST, FEED_INSIDE, FEED_FIRST, INSIDE, FIRST, CONTINUATION = range(7)
BITS = 3
#: Classes of the bytes before which a unit ends. A `token` is a run of other characters with the white
#: space before it, or the white space at the end of the text; a `char` is a code point.
UNITS = {"token": (SPACE_FIRST, FEED_FIRST), "char": (SPACE_INSIDE, SPACE_FIRST, FEED_INSIDE, FEED_FIRST, INSIDE, FIRST)}
SENTINELS = ("<P>", "<S>", "<M>")

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


class Bits:
    """A packed bit vector with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), "<u8")
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate([[0], ones[:-1]])
        self.zeros = len(bits) - int(ones[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks of small symbols: a level for each bit, highest first, zeros dealt before ones."""

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before each place."""
        low, high = np.zeros_like(i), i
        for depth, level in enumerate(self.levels):
            ones_low, ones_high = level.rank(low), level.rank(high)
            if symbol >> (len(self.levels) - 1 - depth) & 1:
                low, high = level.zeros + ones_low, level.zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low


def byte_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each byte of texts that begin at `starts` (without those of empty texts at the end)."""
    white = _WHITE[data]
    first = np.ones(len(data), bool)
    first[1:] = white[1:] != white[:-1]
    first[starts] = True
    other = np.where(data & 0xC0 == 0x80, CONTINUATION, INSIDE + first)
    return np.where(white, 2 * (data == 0x0A) + first, other).astype(np.uint8)


class Units:
    """The units of the texts data[offsets[j]:offsets[j + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "token"):
        self.at, self.size = offsets[:-1], np.diff(offsets)
        self.borders = UNITS[unit]
        self.matrix = WaveletMatrix(byte_classes(data, self.at[self.size > 0]))
        #: a border at the first byte ends nothing
        self.skip = self._seen(self.at + (self.size > 0))

    def _seen(self, place: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, place) for c in self.borders)

    def ended(self, i: np.ndarray) -> np.ndarray:
        """Units of each text that end at or before its byte i."""
        inside = np.minimum(i + 1, self.size)
        return self._seen(self.at + inside) - np.where(inside > 0, self.skip, self._seen(self.at)) + ((i >= self.size) & (self.size > 0))

    def cut(self, k: np.ndarray) -> np.ndarray:
        """First byte at which k units of each text have ended, by bisection."""
        low, high = np.zeros_like(self.size), self.size.copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.ended(middle) >= k
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low

    def chars(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code points between the bytes a and b of each text."""
        return b - a - (self.matrix.rank(CONTINUATION, self.at + b) - self.matrix.rank(CONTINUATION, self.at + a))


def _buffers(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of the texts and the offsets into them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    raw = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None else b""
    return raw, offsets - offsets[0]


def _draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the id; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50,
                   spm_rate: int = 80, unit: str = "token", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: n units, the text cut in three and rearranged.

    Of a hundred texts about `rate` are rearranged, `spm_rate` in a hundred of these with the suffix
    first (spm), the others with the prefix first (psm); the rest, empty texts and texts that contain a
    sentinel stay plain, with null lengths. Draws depend on the id and the seed alone, so repeated ids
    draw alike and every row stands for itself; a null id draws as an empty one. Null texts are empty.
    Texts of any length are cut whole; a task holds one batch of about 2 MB, or one longer text. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    if any(a is not b and a in b or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)))) for a in sentinels for b in sentinels):
        raise ValueError("no sentinel may hold another or end as one begins")
    small_batches(docs.sparkSession)
    prefix_mark, suffix_mark, middle_mark = (s.encode() for s in sentinels)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2, h3, h4 = _draws(F.col(id_col), seed)
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | F.contains(text, F.lit(s))
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw, offsets = _buffers(b.column("text"))
            units = Units(np.frombuffer(raw, np.uint8), offsets, unit)
            n = units.ended(units.size)
            h = [b.column(c).to_numpy() % (n + 1) for c in ("h1", "h2")]
            first, second = units.cut(np.minimum(*h)), units.cut(np.maximum(*h))
            forms = b.column("form").to_pylist()
            out = []
            for form, start, x, y, stop in zip(forms, units.at.tolist(), (units.at + first).tolist(), (units.at + second).tolist(), offsets[1:].tolist()):
                if form == "plain":
                    out.append(raw[start:stop])
                elif form == "psm":
                    out.append(b"".join((prefix_mark, raw[start:x], suffix_mark, raw[y:stop], middle_mark, raw[x:y])))
                else:
                    out.append(b"".join((suffix_mark, raw[y:stop], prefix_mark, raw[start:x], middle_mark, raw[x:y])))
            plain = np.array([f == "plain" for f in forms], bool)
            lengths = [pa.array(units.chars(a, c), pa.int64(), mask=plain) for a, c in ((np.zeros_like(first), first), (first, second))]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), b.column("form"), *lengths, pa.array(out, pa.binary()).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made from. A rearranged text holds no sentinel, so each occurs once in its output."""
    def quoted(s: str) -> str:
        return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|" else c for c in s)

    # (before the first sentinel,) first, second and last part
    parts = F.split(output, "|".join(quoted(s) for s in sentinels), -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))
