import random
from itertools import product

from seglattice.llm.chat import BETWEEN, CLOSING, FILL, INSERT, MERGE, NAMES, RELABEL, TAIL, format_chats, head, part_matrix, repair, role_of, walk


def brute(roles):
    """Every assignment of roles and every choice of merging."""
    best = 1 << 60
    for assigned in product((1, 2, 3), repeat=len(roles)):
        for merges in product((0, 1), repeat=len(roles)):
            cost, state = 0, 0
            for r, a, m in zip(roles, assigned, merges, strict=True):
                cost += 0 if r == a else FILL if r == 0 else RELABEL
                if m:
                    cost += MERGE if state == a else 1 << 50
                else:
                    cost += 1 << 50 if BETWEEN[state][a] is None else INSERT * len(BETWEEN[state][a])
                state = a
            best = min(best, cost + INSERT * len(CLOSING[state]))
    return best


def legal(text):
    turns = [t.partition("\n")[0] for t in text.split("<|end|>\n") if t]
    names = [t[2:-2] for t in turns]
    if names[:1] == ["system"]:
        names = names[1:]
    return names == ["user", "assistant"] * (len(names) // 2) and len(names) >= 2 and text.endswith(TAIL)


def test_costs_equal_brute_force():
    for n in range(1, 6):
        for roles in product(range(4), repeat=n):
            assert walk([part_matrix(list(roles))])[0] == brute(roles)


def test_parts_give_the_same_cost():
    rng = random.Random(1)
    for _ in range(200):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        cut = sorted(rng.sample(range(1, len(roles)), min(3, len(roles) - 1))) if len(roles) > 1 else []
        parts = [roles[a:b] for a, b in zip([0, *cut], [*cut, len(roles)], strict=True)]
        assert walk([part_matrix(p) for p in parts])[0] == walk([part_matrix(roles)])[0]


def test_repairs():
    assert repair([("user", "a"), ("assistant", "b")]) == (head(2) + "a" + TAIL + head(3) + "b" + TAIL, 0, 2)
    assert repair([("user", "a"), ("User ", "b"), ("assistant", "c")])[0] == head(2) + "a\nb" + TAIL + head(3) + "c" + TAIL
    assert repair([("user", "a")]) == (head(2) + "a" + TAIL + head(3) + TAIL, INSERT, 2)
    assert repair([(None, "s"), ("assistant", "b")])[1] == FILL
    for roles in product([None, "system", "user", "assistant", "tool"], repeat=4):
        text, cost, turns = repair([(r, f"t{i}") for i, r in enumerate(roles)])
        assert legal(text) and text.count("<|end|>") == turns
        assert all(f"t{i}" in text for i in range(4)) and cost == brute([role_of(r) for r in roles])


def test_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    by = {}
    for r in rows.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    want = {c: repair([t[1:] for t in sorted(turns)]) for c, turns in by.items()}
    whole = format_chats(rows).collect()
    assert {(r["conv_id"], r["part"]): (r["rendered"], r["cost"], r["turns_out"]) for r in whole} == {(c, 0): v for c, v in want.items()}
    pieces = {}
    for r in sorted(format_chats(rows, part=2).collect(), key=lambda r: (r["conv_id"], r["part"])):
        text, cost, turns = pieces.get(r["conv_id"], ("", r["cost"], 0))
        pieces[r["conv_id"]] = (text + r["rendered"], cost, turns + r["turns_out"])
    assert {c: v[1] for c, v in pieces.items()} == {c: v[1] for c, v in want.items()}
    assert all(legal(v[0]) and v[0].count("<|end|>") == v[2] for v in pieces.values())


def test_crowded_turn_numbers(spark):
    """Many rows of one turn number, null ones too, in parts: the same text as in one."""
    rng = random.Random(5)
    rows = [(1, rng.choice([None, 0, 0, 3, 700]), rng.choice(["user", "assistant", "system", None]), f"t{i}") for i in range(500)] + [(2, i, "user", "x") for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = sorted(format_chats(df, part=1000).collect(), key=lambda r: (r["conv_id"], r["part"]))
    assert len(whole) == 2
    parts = sorted(format_chats(df, part=8).collect(), key=lambda r: (r["conv_id"], r["part"]))
    assert len(parts) > 30 and max(r["turns_in"] for r in parts) < 60
    for c in (1, 2):
        own = [r for r in parts if r["conv_id"] == c]
        text, once = ("".join(r["rendered"] for r in some if r["conv_id"] == c) for some in (parts, whole))
        said = lambda t: [x for x in t.split("\n") if x[:1] in ("t", "x")]
        assert legal(text) and said(text) == said(once) and text.count("<|end|>") == sum(r["turns_out"] for r in own)
        assert {r["cost"] for r in own} == {r["cost"] for r in whole if r["conv_id"] == c} and sum(r["turns_in"] for r in own) == sum(r[0] == c for r in rows)


def test_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, cost string, part int"
    rows = [(1, None, None, None, "x", 1), (1, 5, "user", "u", "x", 1), (1, 5, "user", "u", "x", 1), (None, 0, "assistant", "z", None, None), (2, 10**12, "tool", "x" * 50_000, None, None)]
    got = {r["conv_id"]: r for r in format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 2, None} and all(legal(r["rendered"]) for r in got.values())
    assert got[1]["turns_in"] == 3 and got[1]["cost"] == FILL + RELABEL
    assert format_chats(spark.createDataFrame([], schema)).collect() == []
    assert NAMES[role_of(" SYSTEM ")] == "system"
