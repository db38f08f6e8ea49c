"""Chat formatting with role repair of least cost.

A legal conversation is an optional system turn, then user and assistant in turn, and ends with the assistant. Each
turn may keep its role (free), take another one (RELABEL; FILL if its own is unknown), join the turn before it of the
same role (MERGE), or come after empty turns that are put in (INSERT each; also at the end). Dynamic programming over
the automaton's states (the role of the last turn) finds the repair of least total cost. On equal costs the first state in
the order start, system, user, assistant wins, between parts (below) first and then from a part's end backwards.

The cost of any run of turns is a small min-plus matrix between states, so a conversation is worked on in parts of at
most PART turn numbers, and of about twice as many rows where turn numbers repeat: parts give matrices, the walk over a
conversation's matrices gives each part its states, and parts render by themselves. No task holds the texts of more than
one part of a conversation, however long; the walk holds its matrices, 16 numbers for each part. Between repairs of
equal cost the choice depends on where parts are cut, so on `part`.

Defined results: turns are ordered by number, null ones just before 0; those of one number by a hash of role and text, then role and
text; repeated rows are turns of their own (equal ones stay in one part); null texts are empty; roles are compared in lower case without outer spaces;
a null conversation id is an id like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import join_hot

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", *ROLES)
#: The roles that may follow each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, FILL, INSERT = 1, 2, 1, 3
PART = 256
FAR = 1 << 40


def inserted(a: int, b: int) -> tuple[int, ...] | None:
    """The fewest roles to put in between state a and a new turn of role b; None if no number of them helps."""
    paths = [((), a)]
    for _ in range(4):
        for path, state in paths:
            if b in LEGAL[state]:
                return path
        paths = [((*path, n), n) for path, state in paths for n in LEGAL[state]]
    return None


BETWEEN = [[inserted(a, b) for b in range(4)] for a in range(4)]
#: What has to be put in after the last state.
CLOSING = [(), (USER, ASSISTANT), (ASSISTANT,), ()]


def role_of(role: str | None) -> int:
    """The state of a role, START if it is unknown."""
    name = (role or "").strip().lower()
    return NAMES.index(name) if name in ROLES else START


def step_costs(role: int) -> tuple[np.ndarray, np.ndarray]:
    """The cost from each state to each, and whether it is a merge, for one turn."""
    cost, merged = np.full((4, 4), FAR, np.int64), np.zeros((4, 4), bool)
    for b in (SYSTEM, USER, ASSISTANT):
        named = 0 if role == b else FILL if role == START else RELABEL
        for a in range(4):
            if BETWEEN[a][b] is not None:
                cost[a, b] = named + INSERT * len(BETWEEN[a][b])
            if a == b and named + MERGE < cost[a, b]:
                cost[a, b], merged[a, b] = named + MERGE, True
    return cost, merged


STEPS = [step_costs(r) for r in range(4)]


def part_matrix(roles: list[int]) -> np.ndarray:
    """Least costs between the states before and after a run of turns."""
    total = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        total = np.minimum((total[:, :, None] + STEPS[r][0][None]).min(axis=1), FAR)
    return total


def walk(matrices: list[np.ndarray]) -> tuple[int, list[int]]:
    """The least cost of a conversation and the states before, between and after its parts."""
    best, back = np.array([0, FAR, FAR, FAR]), []
    for m in matrices:
        through = best[:, None] + m
        back.append(through.argmin(axis=0))
        best = np.minimum(through.min(axis=0), FAR)
    closed = best + np.array([INSERT * len(c) for c in CLOSING])
    states = [int(closed.argmin())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return int(closed.min()), states[::-1]


def decode(roles: list[int], before: int, after: int) -> list[tuple[int, bool, tuple[int, ...]]]:
    """For each turn its role, whether it merges, and the roles put in before it."""
    best, back = np.full(4, FAR, np.int64), []
    best[before] = 0
    for r in roles:
        through = best[:, None] + STEPS[r][0]
        back.append(through.argmin(axis=0))
        best = np.minimum(through.min(axis=0), FAR)
    out, state = [], after
    for r, b in zip(reversed(roles), reversed(back), strict=True):
        a = int(b[state])
        merge = bool(STEPS[r][1][a, state])
        out.append((state, merge, () if merge else BETWEEN[a][state]))
        state = a
    return out[::-1]


def head(role: int) -> str:
    return f"<|{NAMES[role]}|>\n"


TAIL = "\n<|end|>\n"


def render(turns: list[tuple[int, str]], before: int, after: int, last: bool) -> tuple[str, int]:
    """The text of one part and the number of turns that begin in it; parts of a conversation join without more."""
    out, begun, open_ = [], 0, before != START
    for (_, text), (role, merge, put) in zip(turns, decode([r for r, _ in turns], before, after), strict=True):
        if merge:
            out += ["\n", text]
            continue
        for extra in put:
            out += [TAIL if open_ else "", head(extra)]
            begun, open_ = begun + 1, True
        out += [TAIL if open_ else "", head(role), text]
        begun, open_ = begun + 1, True
    if last:
        for extra in CLOSING[after]:
            out += [TAIL, head(extra)]
            begun += 1
        out.append(TAIL)
    return "".join(out), begun


def repair(turns: list[tuple[str | None, str | None]]) -> tuple[str, int, int]:
    """The rendered text, cost and number of turns of one conversation held in memory."""
    known = [(role_of(r), t or "") for r, t in turns]
    cost, (before, after) = walk([part_matrix([r for r, _ in known])])
    text, begun = render(known, before, after, True)
    return text, cost, begun


def matrices(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in columns:
        yield pa.array([part_matrix([role_of(r) for r in roles]).ravel().tolist() for roles in batch.to_pylist()], pa.list_(pa.int64()))


_PLAN = pa.struct([("cost", pa.int64()), ("states", pa.list_(pa.int32()))])


def plans(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in columns:
        found = [walk([np.array(m, np.int64).reshape(4, 4) for m in parts]) for parts in batch.to_pylist()]
        yield pa.array([{"cost": c, "states": s} for c, s in found], _PLAN)


_RENDERED = pa.struct([("text", pa.string()), ("turns", pa.int32())])


def renderings(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for turns, before, after, last in columns:
        out = []
        for own, a, b, z in zip(turns.to_pylist(), before.to_pylist(), after.to_pylist(), last.to_pylist(), strict=True):
            text, begun = render([(role_of(t["role"]), t["text"]) for t in own], a, b, z)
            out.append({"text": text, "turns": begun})
        yield pa.array(out, _RENDERED)


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """(conv_id, part, cost, turns_in, turns_out, rendered): one row for each part of each conversation.

    cost is that of the whole conversation; the texts of its parts, in order, join to its rendered form.
    """
    tie = F.xxhash64(F.col(role_col), F.col(text_col))
    own = turns.select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.floor(F.col(turn_col) / F.lit(part)), F.lit(0)).cast("bigint").alias("block"), F.struct(F.col(turn_col).alias("turn"), tie.alias("tie"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t")
    )
    # the blocks of turn numbers with many rows fall apart further, by turn and range of the tie
    sizes = materialize(own.groupBy("conv_id", "block").agg(F.count("*").alias("rows"), F.count("*").alias("n")).where(F.col("n") > 2 * part), "blocks")
    crowded = sizes.select(F.struct("conv_id", "block").alias("k"), "rows", "n")
    keyed = own.withColumn("k", F.struct("conv_id", "block"))
    if crowded.isEmpty():
        placed = own.withColumn("sub", F.lit(0).cast("bigint"))
    else:
        slots = F.ceil(F.col("n") / F.lit(2 * part))
        share = F.least(F.floor((F.col("t.tie").cast("double") / F.lit(float(1 << 64)) + 0.5) * slots), slots - 1)  # grows with the tie
        sub = F.coalesce(F.col("t.turn") - F.col("block") * part, F.lit(-1)) * (slots + 1) + share
        few = join_hot(keyed, crowded, ["k"], "rows", own.count()).withColumn("sub", sub.cast("bigint"))
        rest = keyed.join(crowded.select("k"), "k", "left_anti").withColumn("sub", F.lit(0).cast("bigint"))
        placed = few.drop("k", "n").unionByName(rest.drop("k"))
    parts = materialize(placed.groupBy("conv_id", F.struct("block", "sub").alias("at")).agg(F.sort_array(F.collect_list("t")).alias("turns")), "chats")
    # role names only; then 16 numbers for each part
    small = parts.select("conv_id", "at", F.arrow_udf(matrices, "array<bigint>")(F.col("turns.role")).alias("m"))
    whole = small.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("p"))
    plan = whole.select("conv_id", "p", F.arrow_udf(plans, "struct<cost:bigint,states:array<int>>")(F.col("p.m")).alias("plan"))
    each = plan.select("conv_id", F.col("plan.cost").alias("cost"), F.col("plan.states").alias("s"), F.size("p").alias("n"), F.posexplode("p.at").alias("part", "at")).select(
        F.col("conv_id").alias("c"), F.col("at").alias("a"), "part", "cost", F.col("s")[F.col("part")].alias("before"), F.col("s")[F.col("part") + 1].alias("after"), (F.col("part") + 1 == F.col("n")).alias("last")
    )
    joined = parts.join(each, parts["conv_id"].eqNullSafe(each["c"]) & (parts["at"] == each["a"]))
    rendered = joined.select("conv_id", "part", "cost", F.size("turns").alias("turns_in"), F.arrow_udf(renderings, "struct<text:string,turns:int>")("turns", "before", "after", "last").alias("r"))
    return rendered.select("conv_id", "part", "cost", "turns_in", F.col("r.turns").alias("turns_out"), F.col("r.text").alias("rendered"))
