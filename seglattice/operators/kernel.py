"""The least-cost segmentation of one text, without Spark.

A text is cut where no word can cross: between two characters whose categories no unknown word can join and that no
lexicon word has side by side. The pieces (mostly words, runs of spaces and marks) repeat a great deal, and what a
piece does depends only on itself and on the words that may end before it: their right ids, relative costs and order.
So each worker remembers, for a pair of such a front and a piece, the front after it and the paths through it, and a
long text is mostly one lookup a piece.

Ties: the least cost wins; for the word before, the one found last; at the end of the text, the least word id, then
the one linked last. In ignore-space mode a run of spaces takes no words: what ends before it also ends after it,
linked in reverse.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..schema import BEGIN_ID, FALLBACK_COST, FALLBACK_FEATURE, OUTSIDE_COST, UNKNOWN_BASE, USER_BASE, DictionaryError
from ..sources.dictionary import Dictionary

#: Remembered pieces in each of two generations, their greatest length, and remembered fronts.
MEMO_PIECES, MEMO_CHARS, MEMO_FRONTS = 200_000, 64, 200_000

#: A word on a path: first and end character in its piece, word id, cost since the piece's front.
Step = tuple[int, int, int, int]


@dataclass(frozen=True)
class Compiled:
    """What the kernel needs of a dictionary; made once on the driver and broadcast."""

    words: dict[str, tuple[tuple[int, int, int, int], ...]]  # surface to (word id, left id, right id, cost), user words first
    lengths: tuple[int, ...]
    heads: frozenset[str]  # beginnings of words of more than one character, and the words
    columns: np.ndarray  # costs by left id, then right id, 16 bits each
    right_size: int
    sets: tuple[tuple[int, ...], ...]  # distinct category lists; 0 is that of code points without a range
    overlap: tuple[tuple[bool, ...], ...]
    joined: tuple[tuple[bool, ...], ...]  # whether some character's run could hold one of each
    inner: frozenset[str]  # pairs of neighbours inside words
    starts: np.ndarray  # range starts, sorted, and the set from each on
    set_of: np.ndarray
    categories: tuple[tuple[bool, bool, int], ...]  # invoke, group, length
    unknown: tuple[tuple[tuple[int, int, int, int], ...], ...]  # by category
    first_unknown: tuple[tuple[int, int, int, int], ...]
    features: tuple[str, ...]
    user_features: tuple[str, ...]
    unknown_features: tuple[str, ...]
    space: int | None
    ignore_space: bool
    max_grouping: int


def compile_dictionary(d: Dictionary, ignore_space: bool = False, max_grouping: int = 0, features: bool = True) -> Compiled:
    """features: False leaves them out, for kernels that only count or locate."""
    space = d.category_id("SPACE")
    if ignore_space and space is None:
        raise DictionaryError("ignoring spaces takes a category SPACE")
    words: dict[str, list[tuple[int, int, int, int]]] = {}
    for base, own in ((USER_BASE, d.user), (0, d.entries)):
        for i, e in enumerate(own):
            words.setdefault(e.surface, []).append((base + i, e.left_id, e.right_id, e.word_cost))
    words.pop("", None)
    m = d.matrix
    grid = m.costs.reshape(m.left_size, m.right_size) if m.costs.size else np.zeros((m.left_size, m.right_size), np.int16)
    sets: dict[tuple[int, ...], int] = {(0,): 0}
    edges = sorted({0, *(r.start for r in d.ranges), *(r.end for r in d.ranges)})
    set_of = [sets.setdefault(d.categories_of(e), len(sets)) for e in edges]
    listed = list(sets)
    overlap = [[bool({*a} & {*b}) for b in listed] for a in listed]
    joined = [[any(x[a] and x[b] for x in overlap) for b in range(len(listed))] for a in range(len(listed))]
    unknown: list[list[tuple[int, int, int, int]]] = [[] for _ in d.categories]
    for i, u in enumerate(d.unknown):
        unknown[u.category_id].append((UNKNOWN_BASE + i, u.left_id, u.right_id, u.word_cost))
    return Compiled(
        {w: tuple(v) for w, v in words.items()}, tuple(sorted({len(w) for w in words})), frozenset(w[:i] for w in words for i in range(1, len(w) + 1)),
        np.ascontiguousarray(grid, np.int16), m.right_size, tuple(listed), tuple(map(tuple, overlap)), tuple(map(tuple, joined)),
        frozenset(w[i : i + 2] for w in words for i in range(len(w) - 1)), np.array(edges, np.int64), np.array(set_of, np.int32),
        tuple((c.invoke, c.group, c.length) for c in d.categories), tuple(map(tuple, unknown)), tuple(u[0] if u else (UNKNOWN_BASE, 0, 0, FALLBACK_COST) for u in unknown),
        tuple(e.feature for e in d.entries) if features else (), tuple(e.feature for e in d.user) if features else (), tuple(u.feature for u in d.unknown) or (FALLBACK_FEATURE,),
        space, ignore_space, max_grouping,
    )


def _user_first(made: tuple[int, tuple[int, int, int, int]]) -> tuple[bool, int]:
    return made[1][0] < USER_BASE, made[1][0]


class Kernel:
    def __init__(self, compiled: Compiled):
        self.d = compiled
        self.memo: dict[tuple[int, str], tuple] = {}
        self.older: dict[tuple[int, str], tuple] = {}
        self.fronts: dict[tuple, int] = {}
        self.made: dict[tuple[int, int], list] = {}
        self.front_list: list[tuple] = []
        self._reset()
        top = 0x110000
        codes = np.arange(0x3000)
        self.low_sets = compiled.set_of[np.searchsorted(compiled.starts, codes, "right") - 1]
        self.joined = np.array(compiled.joined, bool)
        self.pairs = np.array(sorted(ord(p[0]) * top + ord(p[1]) for p in compiled.inner), np.int64)
        self.top = top
        self.columns: dict[int, tuple[int, ...]] = {}

    def column(self, left: int) -> tuple[int, ...]:
        """Connection costs before a left id, as numbers; only those that texts need are unpacked."""
        found = self.columns.get(left)
        if found is None:
            found = self.columns[left] = tuple(self.d.columns[left].tolist()) if left < len(self.d.columns) else ()
        return found

    def _reset(self) -> None:
        self.memo.clear()
        self.older.clear()
        self.fronts.clear()
        self.front_list.clear()
        self.begin = self._front(((0, 0, BEGIN_ID, 0),))

    def _front(self, items: tuple) -> int:
        """The number of a front: (right id, cost over the least, word id, place in link order) in the order of creation."""
        n = self.fronts.setdefault(items, len(self.front_list))
        if n == len(self.front_list):
            self.front_list.append(items)
        return n

    def sets_of(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) == 0 or codes.max() < len(self.low_sets):
            return self.low_sets[codes]
        return self.d.set_of[np.searchsorted(self.d.starts, codes, "right") - 1]

    def cuts(self, text: str) -> tuple[list[int], np.ndarray]:
        """Where the text falls into pieces, its end included, and the category sets of its characters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
        sets = self.sets_of(codes)
        at = np.flatnonzero(~self.joined[sets[:-1], sets[1:]])
        if len(self.pairs) and len(at):
            pair = codes[at].astype(np.int64) * self.top + codes[at + 1]
            where = np.searchsorted(self.pairs, pair)
            where[where == len(self.pairs)] = 0
            at = at[self.pairs[where] != pair]
        return [*(at + 1).tolist(), len(text)], sets

    def piece(self, front: int, text: str, sets: list[int]) -> tuple[int, int, tuple[tuple[int, tuple[int, ...]], ...]]:
        """The front after a piece, the least cost to it, and for each of its items the item before and the words between, four numbers each."""
        d, entry = self.d, self.front_list[front]
        n = len(text)
        # (first character, end, word id, cost, node before); those of the front come first
        nodes = [(0, 0, e[2], e[1], -1) for e in entry]
        right = [e[0] for e in entry]
        # at each character the cheapest node that ends there for every right id, the last found of equals; a node that
        # costs more than another of its right id and end is never chosen, so it is not made
        here: list[dict[int, tuple[int, int]]] = [{} for _ in range(n + 1)]
        linked: list[list[int]] = [[] for _ in range(n + 1)]  # in order of linking; where spaces are not ignored, at the end only
        linked[0] = sorted(range(len(entry)), key=lambda k: entry[k][3])
        for k, e in enumerate(entry):
            old = here[0].get(e[0])
            if old is None or e[1] <= old[0]:
                here[0][e[0]] = (e[1], k)
        run = self._runs(sets)
        words, heads, column_of, right_size, all_links = d.words, d.heads, self.column, d.right_size, d.ignore_space
        longest = d.lengths[-1] if d.lengths else 0
        for i in range(n):
            before = here[i]
            if not before:
                continue
            own = d.sets[sets[i]]
            if d.ignore_space and d.space in own:
                past = here[run[i]]
                for r, (c, p) in before.items():
                    old = past.get(r)
                    if old is None or (c, -p) < (old[0], -old[1]):
                        past[r] = (c, p)
                linked[run[i]] += reversed(linked[i])
                continue
            made: list[tuple[int, tuple[int, int, int, int]]] = []
            for size in range(1, longest + 1):
                part = text[i : i + size]
                if part not in heads or i + size > n:
                    break
                hit = words.get(part)
                if hit is not None:
                    made += [(size, w) for w in hit]
            base = own[0]
            if made:
                if len(made) > 1:
                    made.sort(key=_user_first)
                if d.categories[base][0]:
                    made += self.unknown(base, run[i] - i)
            else:
                made = self.unknown(base, run[i] - i) or [(1, d.first_unknown[base])]
            best: dict[int, tuple[int, int]] = {}  # the best node before depends on the left id alone
            ways = [(r, c, p) for r, (c, p) in before.items()]
            for size, (w_id, left, w_right, w_cost) in made:
                chosen = best.get(left)
                if chosen is None:
                    column = column_of(left)
                    least = last = None
                    for r, c, p in ways:
                        c += column[r] if r < right_size and column else OUTSIDE_COST
                        if least is None or c < least or c == least and p > last:
                            least, last = c, p
                    chosen = best[left] = (least, last)
                c = chosen[0] + w_cost
                e = i + size
                slot = here[e]
                old = slot.get(w_right)
                if old is None or c <= old[0]:
                    slot[w_right] = (c, len(nodes))
                    if e == n or all_links:
                        linked[e].append(len(nodes))
                    nodes.append((i, e, w_id, c, chosen[1]))
                    right.append(w_right)
        kept = [p for p in linked[n] if nodes[p][3] == here[n][right[p]][0]]
        base = min(c for c, _ in here[n].values())
        place = {p: k for k, p in enumerate(kept)}
        kept.sort()
        paths = []
        for p in kept:
            steps, q = [], p
            while q >= len(entry):
                steps.append(nodes[q][:4])
                q = nodes[q][4]
            # flat tuples of numbers: the garbage collector does not visit them again
            paths.append((q, tuple(x for step in reversed(steps) for x in step)))
        return self._front(tuple((right[p], nodes[p][3] - base, nodes[p][2], place[p]) for p in kept)), base, tuple(paths)

    def unknown(self, base: int, size: int) -> list[tuple[int, tuple[int, int, int, int]]]:
        """Lengths and words of the unknown words of a category at the start of a run of this size."""
        key = base, size
        found = self.made.get(key)
        if found is None:
            _, group, length = self.d.categories[base]
            grouped = group and (not self.d.max_grouping or size - 1 <= self.d.max_grouping)
            sizes = [size] if grouped else []
            sizes += [k for k in range(1, min(length, size) + 1) if not (grouped and k == size)]
            found = [(k, w) for w in self.d.unknown[base] for k in sizes]
            if size <= MEMO_CHARS:
                self.made[key] = found
        return found

    def _runs(self, sets: list[int]) -> list[int]:
        """For each character the end of the run of characters that share a category with it."""
        n, overlap = len(sets), self.d.overlap
        block, run = [0] * n, [0] * n  # ends of equal sets
        for i in range(n - 1, -1, -1):
            block[i] = block[i + 1] if i + 1 < n and sets[i + 1] == sets[i] else i + 1
            if block[i] > i + 1:
                run[i] = run[i + 1]
                continue
            j, mine = i + 1, overlap[sets[i]]
            while j < n and mine[sets[j]]:
                j = block[j]
            run[i] = j
        return run

    def _make_room(self, front: int) -> int:
        """Forget pieces and fronts beyond their limits; the number of a front that stays, which may have changed."""
        if len(self.front_list) > MEMO_FRONTS:
            items = self.front_list[front]
            self._reset()
            return self._front(items)
        if len(self.memo) > MEMO_PIECES:
            self.older, self.memo = self.memo, {}
        return front

    def _through(self, text: str) -> tuple[list[tuple[int, int, list]], int]:
        """For each piece its offset, the least cost to it and its paths; and the item of the last front to go back from."""
        self._make_room(self.begin)
        at, total, front, trail, memo, older = 0, 0, self.begin, [], self.memo, self.older
        cuts, sets = self.cuts(text)
        for end in cuts:
            piece = text[at:end]
            key = (front, piece)
            found = memo.get(key)
            if found is None:
                found = older.get(key)
                if found is None:
                    found = self.piece(front, piece, sets[at:end].tolist())
                if end - at <= MEMO_CHARS:
                    memo[key] = found
                    if len(memo) > MEMO_PIECES or len(self.front_list) > MEMO_FRONTS:  # inside a text too
                        trail.append((at, total, found[2]))
                        front, at, total = self._make_room(found[0]), end, total + found[1]
                        memo, older = self.memo, self.older
                        continue
            trail.append((at, total, found[2]))
            front, at = found[0], end
            total += found[1]
        items = self.front_list[front]
        return trail, min(range(len(items)), key=lambda k: (items[k][1], items[k][2], -items[k][3]))

    def tokenize(self, text: str) -> list[Step]:
        """(first character, end character, word id, total cost) of each word."""
        if not text:
            return []
        trail, k = self._through(text)
        taken = []
        for at, total, paths in reversed(trail):
            k, steps = paths[k]
            taken.append((at, total, steps))
        out: list[Step] = []
        for at, total, steps in reversed(taken):
            for j in range(0, len(steps), 4):
                out.append((at + steps[j], at + steps[j + 1], steps[j + 2], total + steps[j + 3]))
        return out

    def count(self, text: str) -> int:
        """The number of words."""
        if not text:
            return 0
        trail, k = self._through(text)
        n = 0
        for _, _, paths in reversed(trail):
            k, steps = paths[k]
            n += len(steps) // 4
        return n

    def reachable(self, text: str) -> list[int]:
        """The positions where some word may begin or the text ends: those that a chain of edges from the start meets."""
        if not text:
            return [0]
        d, n = self.d, len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
        sets = self.sets_of(codes).tolist()
        run, met = self._runs(sets), bytearray(n + 1)
        met[0] = 1
        for i in range(n):
            if not met[i]:
                continue
            own = d.sets[sets[i]]
            if d.ignore_space and d.space in own:
                met[run[i]] = 1
                continue
            known = [size for size in d.lengths if text[i : i + size] in d.words and i + size <= n]
            sizes = known + ([k for k, _ in self.unknown(own[0], run[i] - i)] if not known or d.categories[own[0]][0] else [])
            for size in sizes or [1]:
                met[i + size] = 1
        return [i for i in range(n + 1) if met[i]]

    def feature(self, word_id: int) -> str:
        if word_id < USER_BASE:
            return self.d.features[word_id]
        return self.d.user_features[word_id - USER_BASE] if word_id < UNKNOWN_BASE else self.d.unknown_features[word_id - UNKNOWN_BASE]
