"""DuckDB SQL for the lattice and for best paths, built from a dictionary's tables as VALUES."""

from __future__ import annotations

from ..schema import BEGIN_ID, FALLBACK_COST, OUTSIDE_COST, UNKNOWN_BASE, USER_BASE
from ..sources.dictionary import Dictionary


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words_sql(own, base: int) -> str:
    return "(VALUES " + ", ".join(f"({base + i}::BIGINT, {text(e.surface)}, {e.left_id}, {e.right_id}, {e.word_cost}, {text(e.feature)})" for i, e in enumerate(own)) + ") AS lex(word_id, surface, left_id, right_id, word_cost, feature)"


def lexicon_sql(d: Dictionary) -> str:
    return words_sql(d.entries, 0)


def user_sql(d: Dictionary) -> str:
    return words_sql(d.user, USER_BASE)


def unknown_sql(d: Dictionary) -> str:
    return "(VALUES " + ", ".join(f"({i}, {u.category_id}, {u.left_id}, {u.right_id}, {u.word_cost}, {text(u.feature)})" for i, u in enumerate(d.unknown)) + ") AS unk(unk_id, category_id, left_id, right_id, word_cost, feature)"


def category_sql(d: Dictionary) -> str:
    return "(VALUES " + ", ".join(f"({i}, {text(c.name)}, {c.invoke}, {c.group}, {c.length})" for i, c in enumerate(d.categories)) + ") AS cat(category_id, name, invoke, grp, length)"


def range_sql(d: Dictionary) -> str:
    return "(VALUES " + ", ".join(f"({i}, {r.start}, {r.end}, {list(r.category_ids)})" for i, r in enumerate(d.ranges)) + ") AS rng(range_id, first, past, category_ids)"


def matrix_sql(d: Dictionary) -> str:
    m = d.matrix
    return "(VALUES " + ", ".join(f"({r}, {left}, {m.cost(r, left)})" for r in range(m.right_size) for left in range(m.left_size)) + ") AS mat(right_id, left_id, cost)"


def chars(source: str, d: Dictionary) -> str:
    """CTEs up to ch(id, pos, c, code, category_ids, base); source selects id and t."""
    return f"""src AS ({source}),
split AS (SELECT id, unnest(regexp_extract_all(t, '(?s).')) AS c, generate_subscripts(regexp_extract_all(t, '(?s).'), 1)::INTEGER - 1 AS pos FROM src),
codes AS (SELECT code, coalesce(max_by(category_ids, range_id), [0]) AS category_ids FROM (SELECT DISTINCT unicode(c) AS code FROM split) LEFT JOIN {range_sql(d)} ON code >= first AND code < past GROUP BY code),
ch AS (SELECT id, pos, c, unicode(c) AS code, category_ids, category_ids[1] AS base FROM split JOIN codes ON unicode(c) = code)"""


def runs(d: Dictionary) -> str:
    """CTE run(ch's columns, run_end): for each distinct category list the next position without any of it."""
    lists = sorted({(0,), *(r.category_ids for r in d.ranges)})
    picks = " ".join(f"WHEN category_ids = {list(s)} THEN min(CASE WHEN NOT list_has_any(category_ids, {list(s)}) THEN pos END) OVER later" for s in lists)
    return f"""run AS (SELECT *, coalesce(CASE {picks} END, max(pos) OVER (PARTITION BY id) + 1) AS run_end FROM ch
WINDOW later AS (PARTITION BY id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def known(d: Dictionary) -> str:
    """CTE known(id, s, e, wid, lid, rid, cost, surface)."""
    words = [lexicon_sql(d), *([user_sql(d)] if d.user else [])]
    every = " UNION ALL ".join(f"SELECT * FROM {w}" for w in words)
    longest = max(len(e.surface) for e in (*d.entries, *d.user))
    grown = ", ".join(f"lead(c, {k}) OVER w AS c{k}" for k in range(1, longest))
    parts = " UNION ALL ".join(f"SELECT id, pos AS s, pos + {n} AS e, {' || '.join(['c', *(f'c{k}' for k in range(1, n))])} AS surface FROM grown" for n in range(1, longest + 1))
    return f"""word AS ({every}), grown AS (SELECT id, pos, c{', ' + grown if grown else ''} FROM ch WINDOW w AS (PARTITION BY id ORDER BY pos)),
known AS (SELECT id, s, e, word_id AS wid, left_id AS lid, right_id AS rid, word_cost AS cost, surface FROM ({parts}) JOIN word USING (surface) WHERE surface IS NOT NULL)"""


def unknown(d: Dictionary, max_grouping: int = 0) -> str:
    """CTE made(id, s, e, wid, lid, rid, cost) and fallback of the same columns."""
    limit = f"AND run_end - pos - 1 <= {max_grouping}" if max_grouping else ""
    return f"""at_pos AS (SELECT r.id, pos, run_end, base, run_end - pos AS size, invoke, (grp {limit}) AS grouped, length, k.s IS NOT NULL AS matched
  FROM run r JOIN {category_sql(d)} ON category_id = base LEFT JOIN (SELECT DISTINCT id, s FROM known) k ON k.id = r.id AND k.s = pos
  WHERE k.s IS NULL OR invoke),
sized AS (SELECT *, unnest(CASE WHEN grouped THEN [size] ELSE []::INTEGER[] END || list_filter(range(1, least(length, size) + 1)::INTEGER[], lambda n: NOT (grouped AND n = size))) AS n FROM at_pos),
made AS (SELECT id, pos AS s, pos + n AS e, {UNKNOWN_BASE}::BIGINT + unk_id AS wid, left_id AS lid, right_id AS rid, word_cost AS cost FROM sized JOIN {unknown_sql(d)} ON category_id = base),
first_unk AS (SELECT category_id, min(unk_id) AS u FROM {unknown_sql(d)} GROUP BY category_id),
fallback AS (SELECT a.id, pos AS s, pos + 1 AS e, {UNKNOWN_BASE}::BIGINT + coalesce(u, 0) AS wid, coalesce(unk.left_id, 0) AS lid, coalesce(unk.right_id, 0) AS rid, coalesce(unk.word_cost, {FALLBACK_COST}) AS cost
  FROM at_pos a LEFT JOIN first_unk f ON f.category_id = base LEFT JOIN {unknown_sql(d)} ON unk_id = u
  WHERE NOT matched AND NOT EXISTS (SELECT 1 FROM made m WHERE m.id = a.id AND m.s = a.pos))"""


def edges(source: str, d: Dictionary, max_grouping: int = 0) -> str:
    return f"""{chars(source, d)},
{runs(d)},
{known(d)},
{unknown(d, max_grouping)},
edge AS MATERIALIZED (SELECT id, s, e, wid, lid, rid, cost FROM known UNION ALL FROM made UNION ALL FROM fallback)"""


def paths(source: str, d: Dictionary, max_grouping: int = 0, *, ignore_space: bool = False, right: str = "0") -> str:
    """WITH ... up to tok(id, position, s, e, wid, total): the best path of every text that is not empty.

    One recursion step for each position: edges that start there take their best node before, longer nodes wait.
    ignore_space: no edge starts at a space, and nodes that end there end after its run too. right: the right id before
    the text, an expression of the source's columns.
    """
    kind = f"CASE WHEN c.wid < {USER_BASE} THEN 1 WHEN c.wid < {UNKNOWN_BASE} THEN 0 ELSE 2 END"
    space = d.category_id("SPACE") if ignore_space else -1
    return f"""WITH RECURSIVE {edges(source, d, max_grouping)},
mat AS (SELECT * FROM {matrix_sql(d)}),
gap AS MATERIALIZED (SELECT id, pos, run_end FROM run WHERE list_contains(category_ids, {space})),
way AS MATERIALIZED (SELECT * FROM edge g WHERE NOT EXISTS (SELECT 1 FROM gap WHERE gap.id = g.id AND gap.pos = g.s)),
v AS (
  SELECT 0 AS p, id, -1 AS s, 0 AS e, 0 AS own_e, {BEGIN_ID}::BIGINT AS wid, ({right})::INTEGER AS rid, 0::BIGINT AS total, NULL::INTEGER AS ps, NULL::BIGINT AS pw
  FROM src WHERE length(t) > 0
  UNION ALL
  SELECT * FROM (
    WITH c AS (SELECT * FROM v),
    step AS (SELECT c.p + 1 AS p, g.id, g.s, g.e, g.e AS own_e, g.wid, g.rid, c.total + coalesce(mat.cost, {OUTSIDE_COST}) + g.cost AS total, c.s AS ps, c.wid AS pw,
        row_number() OVER (PARTITION BY g.id, g.s, g.e, g.wid ORDER BY c.total + coalesce(mat.cost, {OUTSIDE_COST}), c.s DESC, {kind} DESC, c.wid DESC) AS rn
      FROM c JOIN way g ON g.id = c.id AND g.s = c.e AND c.e = c.p LEFT JOIN mat ON mat.right_id = c.rid AND mat.left_id = g.lid)
    SELECT p, id, s, e, own_e, wid, rid, total, ps, pw FROM step WHERE rn = 1
    UNION ALL SELECT c.p + 1, c.id, s, gap.run_end, own_e, wid, rid, total, ps, pw FROM c JOIN gap ON gap.id = c.id AND gap.pos = c.e AND c.e = c.p
    UNION ALL SELECT p + 1, id, s, e, own_e, wid, rid, total, ps, pw FROM c WHERE e > p)
),
node AS (SELECT DISTINCT id, s, e, own_e, wid, total, ps, pw FROM v),
last AS (
  SELECT n.*, row_number() OVER (PARTITION BY n.id ORDER BY total, wid, CASE WHEN own_e < e THEN s ELSE -s END) AS rn
  FROM node n JOIN src ON src.id = n.id AND n.e = length(t) WHERE n.s >= 0),
back AS (
  SELECT id, s, own_e, wid, total, ps, pw FROM last WHERE rn = 1
  UNION ALL
  SELECT n.id, n.s, n.own_e, n.wid, n.total, n.ps, n.pw FROM back b JOIN node n ON n.id = b.id AND n.e = b.s AND n.s = b.ps AND n.wid = b.pw WHERE n.s >= 0
),
tok AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::INTEGER AS position, s, own_e AS e, wid, total FROM back)"""


def segmented(texts: str, d: Dictionary) -> str:
    """WITH ... up to part(id, seg) and tok over distinct segments; texts selects id and t.

    For dictionaries in which a space starts no word but the grouped unknown one and no word goes over a space: after a
    run of spaces there is one node only, so what follows depends on that node's right id alone, and a text falls into
    segments that each end with a run of spaces. Segments repeat, and each is recursed over once.
    """
    (_, after), = ((u.left_id, u.right_id) for u in d.unknown if u.category_id == d.category_id("SPACE"))
    cut = "regexp_extract_all(t, '(?s)[^ ]* +|[^ ]+')"
    part = f"(SELECT id, unnest({cut}) AS t, generate_subscripts({cut}, 1) AS place, generate_subscripts({cut}, 1) = 1 AS opening FROM ({texts}))"
    source = f"SELECT row_number() OVER (ORDER BY t, opening) AS id, t, opening FROM (SELECT DISTINCT t, opening FROM {part})"
    return f"""{paths(source, d, right=f"CASE WHEN opening THEN 0 ELSE {after} END")},
part AS (SELECT p.id, p.place, length(p.t) AS chars, src.id AS seg FROM {part} p JOIN src ON src.t = p.t AND src.opening = p.opening)"""


def document_tokens(texts: str, d: Dictionary) -> str:
    """segmented(texts) and word(id, s, e, wid, total, surface): the best path of whole texts, put together again."""
    return f"""{segmented(texts, d)},
seg_cost AS (SELECT id AS seg, max_by(total, position) AS cost FROM tok GROUP BY id),
laid AS (
  SELECT p.id, p.seg, sum(chars) OVER before - chars AS first_char, sum(cost) OVER before - cost AS paid FROM part p JOIN seg_cost USING (seg)
  WINDOW before AS (PARTITION BY p.id ORDER BY place)),
word_at AS (
  SELECT laid.id, (first_char + s)::INTEGER AS s, (first_char + e)::INTEGER AS e, wid, (paid + total)::BIGINT AS total, substr(src.t, s + 1, e - s) AS surface
  FROM laid JOIN tok ON tok.id = laid.seg JOIN src ON src.id = laid.seg)"""


def features(d: Dictionary) -> str:
    """A subquery feat(wid, feature) of all words."""
    parts = [f"SELECT word_id AS wid, feature FROM {lexicon_sql(d)}", f"SELECT {UNKNOWN_BASE}::BIGINT + unk_id, feature FROM {unknown_sql(d)}"]
    if d.user:
        parts.append(f"SELECT word_id, feature FROM {user_sql(d)}")
    return "(" + " UNION ALL ".join(parts) + ")"
