"""The dictionary of the named queries: frequent words of Latin scripts, overlapping stems, and ties on purpose."""

from __future__ import annotations

from ..sources.dictionary import Dictionary

WORDS = ("the of de and la der que to in is le en el a th that this on an er tion ing ed re es st or nt ou ha he at und die les des con with for by é ß ent").split()
MATRIX_SIZE = 4


def matrix_cost(right: int, left: int) -> int:
    return (7 * right + 13 * left) % 11 * 100 - 300


def lexicon_rows() -> list[tuple[str, int, int, int, str]]:
    rows = [(w, i % 4, (3 * i + 1) % 4, 900 + 170 * (i % 7) - 60 * len(w), f"word,{'long' if len(w) > 2 else '*'},{i},*,*,*,x,R{i}") for i, w in enumerate(WORDS)]
    rows.append((*rows[0][:4], "word,again,*,*"))  # a homograph of equal ids and cost
    rows.append((rows[4][0], rows[4][1], rows[4][2], rows[4][3] + 50, "word,dearer,*,*"))  # never on a best path
    return rows


LEX = "".join(",".join(map(str, r)) + "\n" for r in lexicon_rows())
MATRIX = f"{MATRIX_SIZE} {MATRIX_SIZE}\n" + "".join(f"{r} {left} {matrix_cost(r, left)}\n" for r in range(MATRIX_SIZE) for left in range(MATRIX_SIZE))
CATEGORIES = (("DEFAULT", 0, 1, 0), ("SPACE", 0, 1, 0), ("ALPHA", 1, 1, 2), ("ACCENT", 1, 1, 2), ("NUMERIC", 1, 1, 0), ("SYMBOL", 1, 0, 1))
#: First and last code point and category names; the last range with a code point holds.
RANGES = ((0x21, 0x7E, "SYMBOL"), (0x20, 0x20, "SPACE"), (0x30, 0x39, "NUMERIC"), (0x41, 0x5A, "ALPHA"), (0x61, 0x7A, "ALPHA"), (0xC0, 0xFF, "ACCENT ALPHA"))
CHAR = "".join(f"{n} {i} {g} {length}\n" for n, i, g, length in CATEGORIES) + "".join(f"0x{a:04X}..0x{b:04X} {names}\n" for a, b, names in RANGES)
UNKNOWN = (("DEFAULT", 0, 0, 8000), ("SPACE", 1, 1, 500), ("ALPHA", 2, 2, 4000), ("ALPHA", 3, 3, 4500), ("ACCENT", 2, 2, 4200), ("NUMERIC", 3, 3, 3000), ("SYMBOL", 1, 1, 1000))


def unknown_text(without: tuple[str, ...] = ()) -> str:
    return "".join(f"{n},{a},{b},{c},unknown,{n.lower()}\n" for n, a, b, c in UNKNOWN if n not in without)


USER = "of the,1,2,-500,user,phrase\ntherea,2,1,300,user,word\nan,3,3,800,user,article\n"


def latin(without: tuple[str, ...] = (), user: bool = False) -> Dictionary:
    """without: categories whose unknown entries are left out."""
    d = Dictionary.from_mecab_text(LEX, MATRIX, CHAR, unknown_text(without))
    return d.with_user_lexicon(USER) if user else d
