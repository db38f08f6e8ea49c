"""The binary dictionary file, version 2 and its predecessor: read up to the matrix, and written in the older form.

Little-endian. Magic (8 bytes), six counts (entries, unknown entries, categories, ranges, right and left size), then
the entries, unknown entries, categories, ranges and costs. Version 2 goes on with prebuilt tries, which are derived
data that this engine has no use for; they are passed over.
"""

from __future__ import annotations

import struct

import numpy as np

from ..schema import DictionaryError
from .dictionary import Category, Dictionary, Entry, Matrix, Range, UnknownEntry

# The first bytes of the file.
VERSION_1, VERSION_2 = b"DLRDIC01", b"DLRDIC02"


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise DictionaryError("the dictionary file ends early")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def text(self, size: int) -> str:
        return self.take(f"<{size}s")[0].decode()


def read_dictionary(data: bytes) -> Dictionary:
    if data[:8] not in (VERSION_1, VERSION_2):
        raise DictionaryError("not a dictionary file")
    r = _Reader(data, 8)
    n_entries, n_unknown, n_categories, n_ranges, right, left = r.take("<6I")
    entries, unknown, categories, ranges = [], [], [], []
    for _ in range(n_entries):
        surface, left_id, right_id, cost, feature = r.take("<IHHiI")
        entries.append(Entry(r.text(surface), left_id, right_id, cost, r.text(feature)))
    for _ in range(n_unknown):
        category, left_id, right_id, cost, feature = r.take("<IHHiI")
        unknown.append(UnknownEntry(category, left_id, right_id, cost, r.text(feature)))
    for _ in range(n_categories):
        name, invoke, group, length = r.take("<IBBI")
        categories.append(Category(r.text(name), bool(invoke), bool(group), length))
    for _ in range(n_ranges):
        start, end, n = r.take("<3I")
        ranges.append(Range(start, end, r.take(f"<{n}I")))
    costs = np.array(r.take(f"<{right * left}h"), np.int16)
    if data[:8] == VERSION_1 and r.at != len(data):
        raise DictionaryError("bytes after the end of the dictionary")
    return Dictionary(tuple(entries), Matrix(right, left, costs), tuple(categories), tuple(ranges), tuple(unknown))


def write_dictionary(d: Dictionary) -> bytes:
    """The dictionary without its user lexicon, in the older form, which readers of both versions take."""
    out = [VERSION_1, struct.pack("<6I", len(d.entries), len(d.unknown), len(d.categories), len(d.ranges), d.matrix.right_size, d.matrix.left_size)]
    for e in d.entries:
        surface, feature = e.surface.encode(), e.feature.encode()
        out.append(struct.pack("<IHHiI", len(surface), e.left_id, e.right_id, e.word_cost, len(feature)) + surface + feature)
    for u in d.unknown:
        feature = u.feature.encode()
        out.append(struct.pack("<IHHiI", u.category_id, u.left_id, u.right_id, u.word_cost, len(feature)) + feature)
    for c in d.categories:
        name = c.name.encode()
        out.append(struct.pack("<IBBI", len(name), c.invoke, c.group, c.length) + name)
    out += [struct.pack(f"<3I{len(r.category_ids)}I", r.start, r.end, len(r.category_ids), *r.category_ids) for r in d.ranges]
    return b"".join([*out, d.matrix.costs.astype("<i2").tobytes()])
