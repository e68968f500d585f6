"""Byte-pair encoding and decoding by dynamic programming over prefixes.

A sequence of tokens is what BPE makes of its bytes exactly if every two neighbours are compatible,
that is, BPE leaves their border alone. So each prefix of a word has one last token: the one that
ends there and is compatible with the last token of the rest. A suffix automaton of the vocabulary
gives the tokens that end at each position; following the last tokens back yields the ids.

Words come from the usual byte-level pattern, special tokens are cut out first. The tables depend on
the vocabulary only; they are built once on the driver and broadcast (a few MB), and stay flat arrays
in the workers. The words of a batch that are not known yet are worked out side by side, as columns of
their bytes. Tasks keep the ids of words that they met in a bounded cache, which only saves time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wayline.llm.common import mix, slices, small_batches

#: Words (with what clings to them) that a task remembers, and slots of its table of border tests.
WORD_CACHE = 40_000
PAIR_CACHE = 1 << 18
#: Bytes of a pre-token that is worked out alone, and of texts that are encoded together.
LONG = 1000
TOGETHER = 1 << 19
#: The pre-tokenization of byte-level BPE: fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 40
#: White space other than the blank.
_SPACES = [c for c in map(chr, range(1, 0x3001)) if c.isspace() and c != " "]


def _byte_of_char() -> dict[str, int]:
    """Byte-level files write printable Latin-1 as itself and the other bytes as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Tables:
    """A vocabulary made ready: bytes and merge of each token, and the automaton in flat arrays."""

    tokens: list[bytes]
    special: dict[str, int]
    pair_key: np.ndarray
    pair_rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    edge_key: np.ndarray
    edge_to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    token: np.ndarray


def load(path: str) -> Tables:
    """Read a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte, vocab = _byte_of_char(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = 1 + max([*vocab.values(), *special.values()])
    tokens = [b""] * size
    for s, i in vocab.items():
        if s not in special:
            tokens[i] = bytes(to_byte[c] for c in s)
    plain = [i for i, t in enumerate(tokens) if t]
    for s, i in special.items():
        tokens[i] = s.encode()
    left, right, rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
    keys, ranks = [], []
    for r, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        i = vocab[a + b]
        if rank[i] >= 0:
            raise ValueError(f"two merges make token {i}")
        left[i], right[i], rank[i] = vocab[a], vocab[b], r
        keys.append(vocab[a] << 32 | vocab[b])
        ranks.append(r)
    order = np.argsort(keys)
    return Tables(tokens, special, np.array(keys)[order], np.array(ranks)[order], left, right, rank, *_automaton([(i, tokens[i]) for i in plain]))


def _automaton(tokens: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """Suffix automaton of all tokens: edges (state << 8 | byte), suffix links, longest lengths, and the token that is a state's longest string."""
    step: list[dict[int, int]] = [{}]
    link, length, token = [-1], [0], [-1]

    def state(edges: dict[int, int], size: int, up: int) -> int:
        step.append(edges)
        length.append(size)
        link.append(up)
        token.append(-1)
        return len(step) - 1

    def split(p: int, c: int, q: int) -> int:
        """The state of the strings of q that are no longer than p's longest and one byte."""
        if length[q] == length[p] + 1:
            return q
        clone = state(dict(step[q]), length[p] + 1, link[q])
        link[q] = clone
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone

    for i, t in tokens:
        at = 0
        for c in t:
            if c in step[at]:
                at = split(at, c, step[at][c])
                continue
            new, p = state({}, length[at] + 1, 0), at
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = split(p, c, step[p][c])
            at = new
        token[at] = i
    key = np.array([s << 8 | c for s, e in enumerate(step) for c in e], np.int64)
    to = np.array([q for e in step for q in e.values()], np.int32)
    order = np.argsort(key)
    return key[order], to[order], np.array(link, np.int32), np.array(length, np.int32), np.array(token, np.int32)


class Encoder:
    """What a task needs to encode and decode; built from the broadcast tables."""

    def __init__(self, t: Tables):
        import regex

        self.t, self.special = t, t.special
        # the next state with a token, from a state itself along the suffix links
        known = np.arange(len(t.token), dtype=np.int32)
        missing = np.flatnonzero(t.token < 0)
        while len(missing):
            known[missing] = np.where(known[missing] > 0, t.link[known[missing]], 0)
            missing = missing[(known[missing] > 0) & (t.token[known[missing]] < 0)]
        self.ending = known
        self.tokens = pa.array(t.tokens, pa.binary())
        self.size = np.fromiter(map(len, t.tokens), np.int64, len(t.tokens))
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, t.special)) + ")").split if t.special else None
        self.pairs_seen, self.pairs_stay = np.full(PAIR_CACHE, -1), np.zeros(PAIR_CACHE, bool)
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.turned_away = 0

    def _spines(self, tokens: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of each token, its child, that one's child and so on, and how many there are."""
        columns, depth = [tokens], np.ones(len(tokens), np.int64)
        while (down := np.where(columns[-1] >= 0, child[columns[-1]], -1)).max(initial=-1) >= 0:
            columns.append(down)
            depth += down >= 0
        return np.stack(columns), depth

    def borders_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE never merges across the border of tokens a and b, for arrays of them.

        The pieces at the border grow from bytes to a and b as time, in merge ranks, goes by. A merge
        across happens if its rank comes before both pieces get swallowed by their own token; of two
        merges of one rank the left one is first.
        """
        t, stays = self.t, np.ones(len(a), bool)
        one, i = self._spines(a, t.right)
        two, j = self._spines(b, t.left)
        rows, i, j = np.arange(len(a)), i - 1, j - 1
        while len(rows):
            x, y = one[i, rows], two[j, rows]
            grow_a = np.where(i > 0, t.rank[one[i - 1, rows]], _NEVER)
            grow_b = np.where(j > 0, t.rank[two[j - 1, rows]], _NEVER)
            key = x.astype(np.int64) << 32 | y
            at = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
            across = np.where(t.pair_key[at] == key, t.pair_rank[at], _NEVER)
            merged = (across < grow_a) & (across <= grow_b)
            stays[rows[merged]] = False
            left = grow_a <= grow_b
            i, j = np.where(left, i - 1, i), np.where(left, j, j - 1)
            on = ~merged & ((grow_a < _NEVER) | (grow_b < _NEVER))
            rows, i, j = rows[on], i[on], j[on]
        return stays

    def _compatible(self, key: np.ndarray) -> np.ndarray:
        """The same for pairs a << 32 | b; a table of fixed size keeps what was found last for each of its slots."""
        slot = (mix(key.astype(np.uint64)) % np.uint64(PAIR_CACHE)).astype(np.int64)
        out = self.pairs_stay[slot]
        new = np.flatnonzero(self.pairs_seen[slot] != key)
        if len(new):
            pairs, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.borders_stay((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32))
            out[new] = found[back]
            # of several pairs of one slot any may stay, but with its own answer
            own, first = np.unique(slot[new][at], return_index=True)
            self.pairs_seen[own], self.pairs_stay[own] = pairs[first], found[first]
        return out

    def _advance(self, state: np.ndarray, matched: np.ndarray, c: np.ndarray) -> None:
        """Read a byte in each row: the longest suffix of the text so far that is a part of a token, in place."""
        t, rows = self.t, np.arange(len(state))
        while len(rows):
            key = state[rows].astype(np.int64) << 8 | c[rows]
            at = np.minimum(np.searchsorted(t.edge_key, key), len(t.edge_key) - 1)
            found = t.edge_key[at] == key
            hit = rows[found]
            state[hit] = t.edge_to[at[found]]
            matched[hit] += 1
            rows = rows[~found]
            if (state[rows] == 0).any():
                raise ValueError("a byte without a token")
            state[rows] = t.link[state[rows]]
            matched[rows] = t.length[state[rows]]

    @cached_property
    def _lists(self) -> tuple:
        """The automaton for one word alone; made when a long word comes."""
        t = self.t
        return dict(zip(t.edge_key.tolist(), t.edge_to.tolist())), *(x.tolist() for x in (t.link, t.length, self.ending, t.token, self.size))

    def _long(self, text: bytes) -> bytes:
        """Ids of a long pre-token, as int32 bytes."""
        edges, link, length, ending, token, size = self._lists
        last, state, matched, compatible = [-1] * (len(text) + 1), 0, 0, {}
        for i, c in enumerate(text, 1):
            to = edges.get(state << 8 | c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = edges.get(state << 8 | c)
            state, matched = (to, matched + 1) if to is not None else (0, 0)
            s = ending[state if matched == length[state] else link[state]]
            while True:
                if s <= 0:
                    raise ValueError("a byte without a token")
                t = token[s]
                start = i - length[s]
                if not start:
                    break
                key = last[start] << 32 | t
                ok = compatible.get(key)
                if ok is None:
                    if len(compatible) > WORD_CACHE:
                        compatible.clear()
                    ok = compatible[key] = bool(self._compatible(np.array([key]))[0])
                if ok:
                    break
                s = ending[link[s]]
            last[i] = t
        out, i = [], len(text)
        while i:
            out.append(last[i])
            i -= size[last[i]]
        return np.array(out[::-1], np.int32).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, as int32 bytes; all but long ones advance together, a byte at a time."""
        coded = [w.encode() for w in words]
        short = iter(self._short([w for w in coded if len(w) <= LONG]))
        return [next(short) if len(w) <= LONG else self._long(w) for w in coded]

    def _short(self, coded: list[bytes]) -> list[bytes]:
        if not coded:
            return []
        t = self.t
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        stop = np.cumsum(size)
        # longest first, so that those with another byte come first
        order = np.argsort(-size, kind="stable")
        text = np.frombuffer(b"".join(coded), np.uint8)
        begin = (stop - size)[order]
        size = size[order]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        last = np.empty(len(text), np.int32)
        state, matched = np.zeros(len(coded), np.int32), np.zeros(len(coded), np.int32)
        for i, n in enumerate(live.tolist(), 1):
            state, matched, at = state[:n], matched[:n], begin[:n]
            self._advance(state, matched, text[at + (i - 1)])
            s = self.ending[np.where(matched == t.length[state], state, t.link[state])]
            rows = np.arange(n)
            while len(rows):
                own = s[rows]
                if (own <= 0).any():
                    raise ValueError("a byte without a token")
                token, start = t.token[own], i - t.length[own]
                last[at[rows] + (i - 1)] = token
                inner = np.flatnonzero(start)
                rows, token, start = rows[inner], token[inner], start[inner]
                stays = self._compatible(last[at[rows] + (start - 1)].astype(np.int64) << 32 | token)
                rows = rows[~stays]
                s[rows] = self.ending[t.link[s[rows]]]
        # back from the ends: the last token of a word, of what is before it, and so on
        used, place, left = np.zeros(len(text), bool), begin + size - 1, size
        while len(place):
            used[place] = True
            step = self.size[last[place]]
            place, left = place - step, left - step
            place, left = place[left > 0], left[left > 0]
        ends = np.cumsum(used)[stop - 1] * 4
        ids = last[used].tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _remember(self, cache: dict[str, bytes], words: list[str], ids: list[bytes]) -> None:
        """Early words are the frequent ones, so a full cache stays; it starts anew if it keeps missing."""
        room = WORD_CACHE - len(cache)
        cache.update(zip(words[:room], ids))
        self.turned_away += max(0, len(words) - room)
        if self.turned_away > 8 * WORD_CACHE:
            self.turned_away = 0
            cache.clear()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        known = self.known
        ids = {w: known.get(w) for w in pieces}
        fresh = [w for w, x in ids.items() if x is None]
        made = self.words(fresh)
        ids.update(zip(fresh, made))
        self._remember(known, fresh, made)
        return list(map(ids.__getitem__, pieces))

    def _chunks(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens, as int32 bytes."""
        pieces = list(map(self.split, texts))
        ids = iter(self._pieces([w for p in pieces for w in p]))
        return [b"".join(islice(ids, len(p))) for p in pieces]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words with a blank before each."""
        out = list(map(self.spaced.get, words))
        fresh = [w for w, x in zip(words, out) if x is None]
        if not fresh:
            return out
        # the words side by side: each begins with the one pre-token that has a blank
        pieces = self.split(" " + " ".join(fresh))
        ids = self._pieces(pieces)
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        made = [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(pieces)])]
        self._remember(self.spaced, fresh, made)
        new = iter(made)
        return [next(new) if x is None else x for x in out]

    def _falls_apart(self, text: str) -> bool:
        """A blank before a character starts a pre-token, so most texts fall into words that can be looked up."""
        return not (text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in _SPACES))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each ends."""
        parts, owner = [], []
        for i, text in enumerate(texts):
            cut = [text] if self.cut is None or not any(s in text for s in self.special) else self.cut(text)
            # what is cut out lies between the others
            some = [(p, k % 2 == 1) for k, p in enumerate(cut) if p]
            parts += some
            owner += [i] * len(some)
        apart = [not special and self._falls_apart(p) for p, special in parts]
        lists = pc.split_pattern(pa.array([p for (p, _), x in zip(parts, apart) if x], pa.string()), " ")
        border = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        # twice the number of the word, and one more for the first of a text, which has no blank before it
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2
        code[border[:-1]] += 1
        names = coded.dictionary.to_pylist()
        seen = np.flatnonzero(np.bincount(code, minlength=2 * len(names)))
        first = seen % 2 == 1
        whole = [p for (p, special), x in zip(parts, apart) if not special and not x]
        chunks = self._chunks([names[c >> 1] for c in seen[first].tolist()] + whole)
        units = [*self._spaced([names[c >> 1] for c in seen[~first].tolist()]), *chunks, *[np.int32(self.special[p]).tobytes() for p, special in parts if special]]
        number = np.empty(2 * len(names), np.int64)
        number[seen[~first]] = np.arange(len(seen) - first.sum())
        number[seen[first]] = len(seen) - first.sum() + np.arange(first.sum())
        units_of, words = number[code], np.diff(border)
        if not all(apart):
            # parts that are one unit each: texts that stay whole, then special tokens
            nth = [iter(range(len(seen), len(seen) + len(whole))), iter(range(len(seen) + len(whole), len(units)))]
            runs = iter(np.split(units_of, border[1:-1]))
            sequence = [next(runs) if x else np.array([next(nth[special])]) for (_, special), x in zip(parts, apart)]
            units_of, words = np.concatenate(sequence), np.fromiter(map(len, sequence), np.int64, len(sequence))
        flat = np.frombuffer(b"".join(units), np.int32)
        size = np.fromiter(map(len, units), np.int64, len(units)) // 4
        begin, size = (np.cumsum(size) - size)[units_of], size[units_of]
        done = np.cumsum(size)
        ids = flat[np.repeat(begin - done + size, size) + np.arange(size.sum())]
        upto = np.searchsorted(np.repeat(np.array(owner, np.int64), words), np.arange(len(texts)), side="right")
        return ids, np.concatenate([[0], done])[upto]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].tobytes()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts whose ids, one after another, these are."""
        if not len(ids):
            return pa.array([""] * len(ends), pa.string())
        joined = self.tokens.take(pa.array(ids))
        # the bytes of all tokens lie side by side, so texts are longer runs of them
        offsets, data = np.frombuffer(joined.buffers()[1], np.int32), joined.buffers()[2]
        border = np.ascontiguousarray(offsets[np.concatenate([[0], ends])])
        out = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(border), data])
        try:
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in out.cast(pa.binary()).to_pylist()], pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int32), np.array([len(ids)]))[0].as_py()


def _encoder(shared) -> Encoder:
    """One encoder per worker process and broadcast."""
    if shared.value.__dict__.setdefault("made", None) is None:
        shared.value.__dict__["made"] = Encoder(shared.value)
    return shared.value.__dict__["made"]


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_name: str = "ids", decoded_name: str | None = "decoded") -> DataFrame:
    """Append the ids (array<int>) of every whole text and, if named, the text decoded from them.

    A null or empty text has no ids and decodes to the empty text. Rows, order within tasks and other
    columns stay, but columns of the new names are replaced. Invalid bytes decode to U+FFFD.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = [x for x in (ids_name, decoded_name) if x]
    docs = docs.drop(*added)
    names = docs.columns
    shared = spark.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(shared)
        for b in slices(batches, text_col, TOGETHER):
            ids, ends = coder.encode_all(pc.fill_null(b.column(text_col), "").to_pylist())
            out = [*b.columns, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))]
            if decoded_name:
                out.append(coder.decode_all(ids, ends))
            yield pa.RecordBatch.from_arrays(out, names=[*names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{ids_name}` array<int>" + (f", `{decoded_name}` string" if decoded_name else ""))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Append the text that the ids stand for, in place of a column of that name; null ids give a null text."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.drop(name)
    shared, names = spark.sparkContext.broadcast(load(path).tokens), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for b in batches:
            text = [None if x is None else b"".join([tokens[i] for i in x]).decode("utf-8", "replace") for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{name}` string")
