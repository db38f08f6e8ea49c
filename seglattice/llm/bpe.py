"""BPE with word ends: a minimal acyclic transducer for frequent words, exact merging for all others.

`Lexicon` compiles words with their id sequences into an automaton whose states share equal suffixes; every arc adds a
number, and the sum along a word's path is the place of its ids in one table. The automaton is one file of arrays,
shipped to executors with the job and memory-mapped there. `Encoder` finds the words of a text as the tokenizers
library does for such a vocabulary file, looks distinct words up in the automaton, all at once, and merges the rest by
rank, leftmost first.

Words are found with a fixed pattern where a text has nothing but Latin characters that its normalization leaves in
place; any other text goes through the library's own normalizer and pre-tokenizer, which fix the words exactly.

Defined results: a null text is an empty one, without ids; special tokens in a text have their ids, as in the library;
repeated rows and further columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import tempfile
import uuid
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices

#: Words of the lexicon; the most frequent of the whole corpus.
LEXICON_WORDS = 50_000
#: Words that an encoder remembers in each of two generations.
MEMO_WORDS = 200_000
#: Words above this many bytes merge through a heap.
LONG_WORD = 48
#: The rank of a pair that does not merge.
NONE = 1 << 30

_MAGIC = b"MATX0001"


def _safe() -> tuple[str, str, str]:
    """Letters, numbers and other characters whose words the pattern finds as the library does."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "P": []}
    for c in map(chr, range(33, 0x250)):
        kind = unicodedata.category(c)
        if kind[0] in "CZ" or len(c.lower()) > 1 or ord(c.lower()) >= 0x250 or unicodedata.normalize("NFC", c) != c:
            continue
        kinds[kind[0] if kind[0] in "LN" else "P"].append(c)
    return "".join(kinds["L"]), "".join(kinds["N"]), "".join(kinds["P"])


_L, _N, _P = _safe()
_SPACES = " \t\n\r"
_UNSAFE = re.compile(f"[^{re.escape(_L + _N + _P + _SPACES)}]")
#: The pattern of such vocabulary files, over safe characters.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{re.escape(_L)}]+|[{re.escape(_N)}]|[{re.escape(_P)}]+")


#: The same over Latin-1 bytes: kinds, lower case, and the first n bytes of a number.
_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((_L, _N, _P), 1):
    _KIND[[ord(c) for c in _chars if ord(c) < 256 and ord(c.lower()) < 256]] = _k
_LOWER = bytes(ord(chr(i).lower()) if _KIND[i] else i for i in range(256))
_FINE = bytes(i for i in range(256) if _KIND[i]) + _SPACES.encode()
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _latin(text: str) -> bytes | None:
    """The text in Latin-1, if it has safe characters only and nothing like a special token."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if data.translate(None, _FINE) or b"<|" in data else data


def split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of safe Latin-1 bytes in lower case start, and their lengths, as _WORD finds them."""
    kind = _KIND[data]
    new = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
    starts = np.append(0, new) if len(data) else new
    lengths = np.diff(np.append(starts, len(data)))
    kind = kind[starts]
    # an apostrophe that opens a run of its own takes the letters of a contraction
    mark = np.flatnonzero((data[starts] == 39) & (lengths == 1) & (np.append(kind[1:], 0) == 1))
    if len(mark):
        one, two = data[starts[mark] + 1], data[np.minimum(starts[mark] + 2, len(data) - 1)]
        single = (one == 115) | (one == 116) | (one == 109) | (one == 100)
        double = (lengths[mark + 1] > 1) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        taken = np.where(single, 1, np.where(double, 2, 0))
        lengths[mark] += taken
        starts[mark + 1] += taken
        lengths[mark + 1] -= taken
    keep = (kind != 0) & (lengths > 0)
    return starts[keep], lengths[keep]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: ids, merges with their ranks, special tokens, and how words end."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = vocab.get(a + b)
            if joined is not None:
                self.merges[vocab[a], vocab[b]] = (rank, joined)
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.end] for c in chars], np.int32)
        self.base = max(vocab.values()) + 1
        keys = np.array([a * self.base + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int32)[order]
        self.pair_joined = np.zeros(len(model["merges"]), np.int32)
        for rank, joined in self.merges.values():
            self.pair_joined[rank] = joined
        # most lookups are of single bytes: ranks of their pairs by (byte, byte, second is last)
        self.byte_ranks = np.stack([self._ranks(self.inner[:, None] + 0 * t, 0 * self.inner[:, None] + t) for t in (self.inner, self.last)], axis=2).astype(np.int32)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        # the file without its model: normalizer and pre-tokenizer only
        self.finder = json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})

    def merge(self, word: str) -> list[int]:
        """The ids of one word: always the pair of least rank, the leftmost of equals."""
        return self.merge_all([word])[0]

    def merge_all(self, words: list[str]) -> list[list[int] | np.ndarray]:
        """The ids of each word; words of similar length take each merge together."""
        data = [w.encode() for w in words]
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        low = 0
        for high in (6, 9, 12, 16, 24, LONG_WORD):
            where = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(where), 1 << 13):
                part = where[at : at + (1 << 13)].tolist()
                for i, ids in zip(part, self._merge_matrix([data[i] for i in part], high), strict=True):
                    out[i] = ids
            low = high
        for i in np.flatnonzero(lengths == 0):
            out[i] = []
        for i in np.flatnonzero(lengths > LONG_WORD):
            out[i] = self._merge_long(self._bytes(data[i]))
        return out

    def _bytes(self, data: bytes) -> list[int]:
        parts = self.inner[np.frombuffer(data, np.uint8)]
        parts[-1] = self.last[data[-1]]
        return parts.tolist()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE without a merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)

    def _merge_matrix(self, data: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        parts = np.full((len(data), width + 1), -1, np.int32)  # a column of -1 remains at the right
        inside = np.arange(width) < lengths[:, None]
        parts[:, :width][inside] = self.inner[flat]
        ends = np.cumsum(lengths)
        parts[np.arange(len(data)), lengths - 1] = self.last[flat[ends - 1]]
        final = np.zeros(len(flat), np.int8)
        final[ends - 1] = 1
        left = np.ones(len(flat), bool)
        left[ends - 1] = False
        at = np.flatnonzero(left)
        ranks = np.full((len(data), width), NONE, np.int32)
        ranks[np.arange(width) < lengths[:, None] - 1] = self.byte_ranks[flat[at], flat[at + 1], final[at + 1]]
        columns, done, live = np.arange(width + 1), [None] * len(data), np.arange(len(data))
        while len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            ended = best == NONE
            if ended.any():
                rows, sizes = parts[ended], (parts[ended] >= 0).sum(axis=1)
                for i, row, size in zip(live[ended].tolist(), rows, sizes.tolist(), strict=True):
                    done[i] = row[:size]
                live, parts, ranks, at, best = live[~ended], parts[~ended], ranks[~ended], at[~ended], best[~ended]
                if not len(live):
                    break
            rows = np.arange(len(live))
            new = self.pair_joined[best]
            # everything right of the pair moves one place left
            moved = np.minimum(columns + (columns > at[:, None]), width)
            parts = np.take_along_axis(parts, moved, 1)
            parts[rows, at] = new
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :-1], width - 1), 1)
            ranks[:, -1] = NONE
            ranks[rows, at] = self._ranks(new, parts[rows, at + 1])
            before = np.maximum(at - 1, 0)
            ranks[rows, before] = np.where(at > 0, self._ranks(parts[rows, before], np.where(at > 0, new, -1)), ranks[rows, before])
        return done

    def _merge_long(self, parts: list[int]) -> list[int]:
        """One long word in n log n steps: a heap of pairs over a linked list, in which outdated pairs are skipped."""
        n, get = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], parts[i], parts[i + 1]) for i in range(n - 1) if (m := get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, joined, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i], gone[j], after[i] = joined, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := get((parts[a], parts[b]))):
                    heapq.heappush(heap, (m[0], a, m[1], parts[a], parts[b]))
        return [p for p, g in zip(parts, gone, strict=True) if not g]


class Lexicon:
    """A minimal acyclic transducer over the UTF-8 bytes of words, read from a memory-mapped file."""

    ARRAYS = (("keys", "<i8"), ("target", "<i4"), ("weight", "<i4"), ("final", "|u1"), ("start", "<i8"), ("ids", "<i4"))

    @staticmethod
    def compile(entries: dict[str, list[int]], path: str) -> dict[str, int]:
        """Write the automaton of the words; returns its size. The same entries give the same file."""
        root: dict = {}
        for word in sorted(entries, key=str.encode):
            node = root
            for byte in word.encode():
                node = node.setdefault(byte, {})
            node[-1] = True
        states: dict[tuple, int] = {}
        sizes: list[int] = []  # words below each state
        arcs: list[list[tuple[int, int, int]]] = []
        final: list[bool] = []
        done: dict[int, int] = {}
        stack = [(root, False)]
        while stack:  # children first, so that equal suffixes are found equal
            node, ready = stack.pop()
            if not ready:
                stack.append((node, True))
                stack += [(child, False) for byte, child in node.items() if byte >= 0]
                continue
            out = sorted((byte, done[id(child)]) for byte, child in node.items() if byte >= 0)
            key = (-1 in node, *out)
            state = states.get(key)
            if state is None:
                state = states[key] = len(arcs)
                below, own = int(key[0]), []
                for byte, to in out:
                    own.append((byte, to, below))
                    below += sizes[to]
                arcs.append(own)
                sizes.append(below)
                final.append(key[0])
            done[id(node)] = state
        top = done[id(root)]
        renamed = [top, *(s for s in range(len(arcs)) if s != top)]  # the start is state 0
        name = {old: new for new, old in enumerate(renamed)}
        flat = sorted((name[s] << 8 | byte, name[to], add) for s in range(len(arcs)) for byte, to, add in arcs[s])
        words = sorted(entries, key=str.encode)
        lengths = [len(entries[w]) for w in words]
        data = {
            "keys": [f[0] for f in flat],
            "target": [f[1] for f in flat],
            "weight": [f[2] for f in flat],
            "final": [final[s] for s in renamed],
            "start": np.cumsum([0, *lengths]),
            "ids": [i for w in words for i in entries[w]],
        }
        with open(path, "wb") as f:
            arrays = [np.ascontiguousarray(data[k], dtype=d) for k, d in Lexicon.ARRAYS]
            f.write(_MAGIC + struct.pack("<6q", *(len(a) for a in arrays)))
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 8) + a.tobytes())
        return {"words": len(words), "states": len(arcs), "arcs": len(flat)}

    def __init__(self, path: str):
        whole = np.asarray(np.memmap(path, np.uint8, "r"))
        if bytes(whole[:8]) != _MAGIC:
            raise ValueError("not a lexicon file")
        at = 8 + 48
        for (name, kind), n in zip(self.ARRAYS, struct.unpack("<6q", bytes(whole[8:56])), strict=True):
            at += -at % 8
            size = n * np.dtype(kind).itemsize
            setattr(self, name, whole[at : at + size].view(kind))
            at += size

    def find(self, words: list[str]) -> np.ndarray:
        """The place of each word's ids, -1 for words that the lexicon lacks; all words take each step together."""
        data = [w.encode() for w in words]
        out = np.full(len(words), -1, np.int64)
        if not data or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        first = np.cumsum(lengths) - lengths
        live = np.arange(len(data))
        state, place, step = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64), 0
        while len(live):
            over = lengths[live] == step
            stop = live[over]
            good = self.final[state[stop]] == 1
            out[stop[good]] = place[stop[good]]
            live = live[~over]
            key = state[live] << 8 | flat[first[live] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == key
            live, at = live[known], at[known]
            state[live] = self.target[at]
            place[live] += self.weight[at]
            step += 1
        return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], joined."""
    upto = np.cumsum(lengths)
    return flat[np.repeat(starts - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)]


class Keys:
    """A hash table from words of at most 16 single-byte characters, as two 64-bit numbers, to slots."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.a, self.b, self.slot = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self._place(a, b)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & ((self.a[at] != a) | (self.b[at] != b)))
        while len(open_):
            at = (at if len(at) == len(open_) else at[open_]) + 1 & self.mask
            got, x, y = self.slot[at], a[open_], b[open_]
            out[open_] = got
            still = (got >= 0) & ((self.a[at] != x) | (self.b[at] != y))
            open_, at = open_[still], at[still]
        return out

    def put(self, a: np.ndarray, b: np.ndarray, slots: np.ndarray) -> None:
        """Add keys that are new and distinct."""
        at = self._place(a, b)
        while len(at):
            free = np.flatnonzero(self.slot[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            take = free[first]
            self.a[at[take]], self.b[at[take]], self.slot[at[take]] = a[take], b[take], slots[take]
            rest = np.ones(len(at), bool)
            rest[take] = False
            a, b, slots, at = a[rest], b[rest], slots[rest], at[rest] + 1 & self.mask


class Encoder:
    """Texts to ids. Remembers distinct words in two generations of bounded size.

    Texts of safe Latin-1 characters are split into words all at once, and words of up to 16 characters are looked up as
    numbers; other texts and words go through strings.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, memo_words: int = MEMO_WORDS):
        self.vocabulary, self.lexicon, self.memo_words = vocabulary, lexicon, memo_words
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.finder = None
        self.old: tuple | None = None
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.keys = Keys(max(12, (2 * self.memo_words).bit_length()))
        self.starts, self.lengths, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0
        self.flat, self.used = np.zeros(1 << 12, np.int32), 0
        # no word contains white space, so these keys stay apart
        special = self.vocabulary.special
        self.memo.update(zip((f" {t}" for t in special), self._store(np.ones(len(special), np.int64), np.array(list(special.values()), np.int32)).tolist(), strict=True))

    def _store(self, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New slots for runs of ids of these lengths."""
        n, m = self.count, len(lengths)
        while n + m > len(self.starts):
            self.starts, self.lengths = np.append(self.starts, np.zeros_like(self.starts)), np.append(self.lengths, np.zeros_like(self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + m] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.count += m
        return np.arange(n, n + m)

    def _learn(self, words: list[str]) -> np.ndarray:
        """New slots for distinct words: from the lexicon, or merged."""
        slots = np.empty(len(words), np.int64)
        have = np.zeros(len(words), bool)
        if self.lexicon is not None:
            places = self.lexicon.find(words)
            have = places >= 0
            start, end = self.lexicon.start[places[have]], self.lexicon.start[places[have] + 1]
            slots[have] = self._store(end - start, gather(self.lexicon.ids, start, end - start))
        rest = np.flatnonzero(~have)
        if len(rest):
            merged = self.vocabulary.merge_all([words[i] for i in rest.tolist()])
            slots[rest] = self._store(np.fromiter(map(len, merged), np.int64, len(merged)), np.concatenate(merged))
        return slots

    def words(self, text: str) -> list[str]:
        """The words of a text in order, special tokens marked by a leading space."""
        if self.special is not None and "<" in text and self.special.search(text):
            return [w for k, part in enumerate(self.special.split(text)) for w in ([f" {part}"] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not _UNSAFE.search(text):
            return _WORD.findall(text.lower())
        if self.finder is None:
            from tokenizers import Tokenizer

            self.finder = Tokenizer.from_str(self.vocabulary.finder)
        norm = self.finder.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in self.finder.pre_tokenizer.pre_tokenize_str(norm)]

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text ends in it."""
        if self.count > self.memo_words:
            self.old = (self.keys, self.starts, self.lengths, self.flat)
            self._reset()
        plain: list[bytes] = []
        words: list[str] = []
        kinds: list[bool] = []
        counts: list[int] = []  # words of the texts that are not plain
        for text in texts:
            data = _latin(text or "")
            kinds.append(data is not None)
            if data is not None:
                plain.append(data)
            else:
                own = self.words(text)
                words += own
                counts.append(len(own))
        fast, sizes = self._plain_slots(plain)
        slots = fast
        if words:
            slow = self._slots(words)
            order, a, b, sized, counted = [], 0, 0, iter(sizes), iter(counts)
            for kind in kinds:
                if kind:
                    n = next(sized)
                    order.append(fast[a : a + n])
                    a += n
                else:
                    n = next(counted)
                    order.append(slow[b : b + n])
                    b += n
            slots = np.concatenate(order)
        sized, counted = iter(sizes), iter(counts)
        ends = np.cumsum([next(sized) if kind else next(counted) for kind in kinds], dtype=np.int64)
        lengths = self.lengths[slots]
        return gather(self.flat, self.starts[slots], lengths), np.append(0, np.cumsum(lengths))[ends]

    def _slots(self, words: list[str]) -> np.ndarray:
        """Slots of words that go through strings."""
        memo = self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            memo.update(zip(new, self._learn(new).tolist(), strict=True))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def _key_slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of words given as two numbers: known ones, those of the generation before, new ones."""
        slots = self.keys.find(a, b).astype(np.int64)
        if self.old is not None and len(missing := np.flatnonzero(slots < 0)):
            keys, starts, lengths, flat = self.old
            before = keys.find(a[missing], b[missing])
            known, first, back = np.unique(before, return_index=True, return_inverse=True)
            some = known >= 0
            own = np.full(len(known), -1, np.int64)
            own[some] = self._store(lengths[known[some]], gather(flat, starts[known[some]], lengths[known[some]]))
            first = missing[first[some]]
            self.keys.put(a[first], b[first], own[some].astype(np.int32))
            slots[missing] = own[back]
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            x, y = a[missing], b[missing]
            order = np.lexsort((y, x))
            new = np.append(True, (x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]]))
            first = order[new]
            words = np.stack([x[first], y[first]], axis=1).view("S16")[:, 0].tolist()
            own = self._learn([w.decode("latin-1") for w in words])
            self.keys.put(x[first], y[first], own.astype(np.int32))
            slots[missing[order]] = own[np.cumsum(new) - 1]
        return slots

    def _plain_slots(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The slots of all words of Latin-1 texts, and the number of words of each text."""
        data = b" ".join([*texts, b" " * 17]).translate(_LOWER)
        starts, lengths = split(np.frombuffer(data, np.uint8))
        bounds = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        sizes = np.diff(np.append(0, np.searchsorted(starts, bounds))).tolist()
        # 8 bytes from any place on, and what of them belongs to the word
        eight = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))
        short = lengths <= 16
        at, n = starts[short], lengths[short]
        a, b = eight[at] & _HEAD[np.minimum(n, 8)], eight[at + 8] & _HEAD[np.maximum(n - 8, 0)]
        slots = np.empty(len(starts), np.int64)
        slots[short] = self._key_slots(a, b)
        long = np.flatnonzero(~short)
        if len(long):
            slots[long] = self._slots([data[s : s + n].decode("latin-1") for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)])
        return slots, sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens joined by single spaces, as the library does without a decoder."""
        return b" ".join(map(self.vocabulary.names.__getitem__, ids.tolist()))


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts (runs of letters, in lower case), counted over every row; ties by the word.

    A histogram of the counts tells from which count on words are wanted, so that the driver gets little more than limit.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("w")).where("w != ''")
    counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    level = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):  # at most 16 rows for each doubling
        held, least = held + r["n"], r["level"]
        if held >= limit:
            break
    if held > 4 * limit:  # equal counts: only an order can cut
        return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(limit).collect()]
    return [w for _, w in sorted((-r["n"], r["w"]) for r in counts.where(level >= least).collect())[:limit]]


def encoder_factory(spark: SparkSession, vocabulary_path: str, words: Iterable[str] = ()) -> Callable[[], Encoder]:
    """Makes an encoder in a task. The lexicon of the words is compiled here and shipped as a file that tasks map."""
    vocabulary = Vocabulary(Path(vocabulary_path).read_text(encoding="utf-8"))
    held = spark.sparkContext.broadcast(vocabulary)  # fixed by the vocabulary file
    words = list(dict.fromkeys(words))
    entries = {w: list(map(int, ids)) for w, ids in zip(words, vocabulary.merge_all(words), strict=True)}
    # the driver serves the file to executors, present and future; its name tells its content, and it appears complete
    folder = Path(tempfile.gettempdir()).resolve()
    made = folder / f"lexicon-{uuid.uuid4().hex}"
    Lexicon.compile(entries, str(made))
    path = folder / f"lexicon-{hashlib.sha256(made.read_bytes()).hexdigest()[:20]}-{spark.sparkContext.applicationId}"
    made.replace(path)
    spark.sparkContext.addFile(str(path))
    file = path.name

    def make() -> Encoder:
        if file not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[file] = Encoder(held.value, Lexicon(SparkFiles.get(file)))
        return _ENCODERS[file]

    return make


#: Encoders of this Python worker, by lexicon; the last one only.
_ENCODERS: dict[str, Encoder] = {}

DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def digest_udf(make: Callable[[], Encoder]):
    def digests(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make()
        for batch in texts:
            for piece in slices(batch):
                ids, ends = encoder.encode(x.as_py() for x in piece)
                n, a, b, at = [], [], [], 0
                for end in ends.tolist():
                    own = ids[at:end]
                    n.append(end - at)
                    a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(encoder.decode(own)).hexdigest())
                    at = end
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.arrow_udf(digests, DIGEST)


def encode_udf(make: Callable[[], Encoder]):
    """A column of array<int>: the ids of each text."""

    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make()
        for batch in texts:
            for piece in slices(batch):
                ids, ends = encoder.encode(x.as_py() for x in piece)
                yield pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))

    return F.arrow_udf(encode, "array<int>")


def decode_udf(make: Callable[[], Encoder]):
    """A column of strings from a column of array<int>."""

    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make()
        for batch in columns:
            yield pa.array([None if x.as_py() is None else encoder.decode(np.array(x.as_py(), np.int64)).decode() for x in batch], pa.string())

    return F.arrow_udf(decode, "string")


def token_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    make = encoder_factory(docs.sparkSession, vocabulary_path, frequent_words(docs, text_col, lexicon_words))
    return docs.select(F.col(id_col).alias("doc_id"), digest_udf(make)(F.col(text_col)).alias("d")).select("doc_id", "d.*")
