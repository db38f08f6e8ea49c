"""The named queries of the engine and, where DuckDB can run it on whole tables, the SQL of the same rows.

Best paths in SQL take one recursion step for each character, so token rows and output formats are held against SQL on
the tables of short texts (part names, benchmark items); counts and frequencies of documents, lines and pages recurse
once over each distinct segment between spaces. The q_document_* queries give token rows, spans, costs and all output
formats of whole documents without SQL; tests hold them against a plain implementation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import register
from ..operators import lattice
from ..operators.tokenizer import Tokenizer, explode_tokens, json_text, mecab_text, part_of_speech, reading, spread, wakati_text, word_frequencies
from ..schema import OUTSIDE_COST, UNKNOWN_BASE
from ..sources import html
from ..sources.binary import read_dictionary, write_dictionary
from ..sources.dictionary import Dictionary, invalid_ids
from ..streaming.jobs import windowed_counts
from . import oracle
from .latin import latin

Query = Callable[[SparkSession, str], DataFrame]

ITEMS = "SELECT item_id AS id, text AS t FROM benchmark"
PARTS = "SELECT p_partkey AS id, p_name AS t FROM part"
DOCUMENTS = "SELECT doc_id AS id, text AS t FROM documents"

latin = cache(latin)
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL if there is any."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("t"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("t")))


def run_rows(df: DataFrame, d: Dictionary) -> DataFrame:
    return lattice.with_runs(df, "id", "t", d)


# -- characters


@query(f"WITH {oracle.chars(ITEMS, latin())}, b AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY id ORDER BY pos) AS byte_end FROM ch) SELECT id, pos, c AS ch, code, (byte_end - strlen(c))::INTEGER AS byte_start, byte_end::INTEGER AS byte_end FROM b")
def q_char_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points with their byte ranges."""
    return lattice.characters(items(spark, sf_dir), "id", "t")


@query(f"SELECT id, length(t)::INTEGER AS chars, strlen(t)::INTEGER AS bytes FROM ({DOCUMENTS})")
def q_byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters and bytes of each document."""
    return lattice.text_sizes(documents(spark, sf_dir), "id", "t")


@query(f"WITH {oracle.chars(ITEMS, latin())} SELECT id, pos, base, array_to_string(category_ids, ',') AS category_ids FROM ch")
def q_char_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category list of each character and its base."""
    chars = lattice.with_categories(lattice.characters(items(spark, sf_dir), "id", "t"), latin())
    return chars.select("id", "pos", "base", F.array_join("category_ids", ",").alias("category_ids"))


@query(f"WITH {oracle.chars(DOCUMENTS, latin())} SELECT name, count(*) AS n FROM ch JOIN {oracle.category_sql(latin())} ON category_id = base GROUP BY name")
def q_category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all documents by base category."""
    each = documents(spark, sf_dir).select(F.explode(F.split("t", "")).alias("ch")).where("ch <> ''").groupBy(F.ascii("ch").alias("code")).agg(F.count("*").alias("n"))
    names = F.array(*(F.lit(c.name) for c in latin().categories))
    return each.groupBy(F.get(names, lattice.category_ids(F.col("code"), latin())[0]).alias("name")).agg(F.sum("n").alias("n"))


@query(f"WITH {oracle.chars(ITEMS, latin())} SELECT id, pos, name FROM ch JOIN {oracle.category_sql(latin())} ON category_id = base WHERE invoke")
def q_invoke_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters whose category makes unknown words even where known ones start."""
    chars = lattice.with_categories(lattice.characters(items(spark, sf_dir), "id", "t"), latin())
    category = latin().tables(spark)["category"]
    return chars.join(category, chars["base"] == category["category_id"]).where("invoke").select("id", "pos", "name")


@query(f"WITH {oracle.chars(ITEMS, latin())}, {oracle.runs(latin())} SELECT id, pos, run_end FROM run")
def q_char_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each character the end of the run that shares a category with it."""
    return run_rows(items(spark, sf_dir), latin()).select("id", "pos", "run_end")


@query(
    f"WITH {oracle.chars(DOCUMENTS, latin())}, {oracle.runs(latin())} SELECT s.id, CASE WHEN s.t IS NOT NULL THEN count(pos) END AS chars, "
    "CASE WHEN s.t IS NOT NULL THEN coalesce(sum(run_end - pos), 0) END::BIGINT AS total, CASE WHEN s.t IS NOT NULL THEN coalesce(max(run_end - pos), 0) END::INTEGER AS longest "
    "FROM src s LEFT JOIN run ON run.id = s.id GROUP BY s.id, s.t"
)
def q_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths of every document, summed and at most."""
    return lattice.run_lengths(documents(spark, sf_dir), "id", "t", latin())


# -- edges


@query(f"WITH {oracle.chars(ITEMS, latin())}, {oracle.known(latin())} SELECT id, s, e, wid, surface FROM known")
def q_prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lexicon word at every place."""
    found = lattice.known_edges(items(spark, sf_dir), "id", "t", latin())
    return found.select("id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("word_id").alias("wid"), "surface")


@query(f"WITH {oracle.chars(DOCUMENTS, latin())}, {oracle.known(latin())} SELECT surface, count(*) AS n, count(DISTINCT id) AS docs FROM known GROUP BY surface")
def q_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every lexicon word in all documents."""
    d = latin()
    words = d.tables(spark)["lexicon"].groupBy("surface").agg(F.count("*").alias("words"))
    counts = lattice.surface_counts(documents(spark, sf_dir), "id", "t", lattice.surfaces_of(d.entries))
    return counts.join(words, "surface").select("surface", (F.col("n") * F.col("words")).alias("n"), F.col("keys").alias("docs"))


@query(f"SELECT surface, count(*) AS n, min(word_id) AS first_id FROM {oracle.lexicon_sql(latin())} GROUP BY surface HAVING count(*) > 1")
def q_homographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of several words."""
    return latin().tables(spark)["lexicon"].groupBy("surface").agg(F.count("*").alias("n"), F.min("word_id").alias("first_id")).where("n > 1")


_USER_ONLY = oracle.known(latin(user=True)).replace("known AS (", "known AS (SELECT * FROM (", 1) + f" WHERE wid >= {1 << 30})"


@query(f"WITH {oracle.chars(ITEMS, latin())}, {_USER_ONLY} SELECT id, s, e, wid, surface FROM known")
def q_user_prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user word at every place."""
    found = lattice.known_edges(items(spark, sf_dir), "id", "t", latin(user=True), user=True)
    return found.select("id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("word_id").alias("wid"), "surface")


def made_edges(spark: SparkSession, sf_dir: str, d: Dictionary, max_grouping: int = 0) -> DataFrame:
    made = lattice.unknown_edges(run_rows(items(spark, sf_dir), d), d.tables(spark), "id", max_grouping)
    return made.select("id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("word_id").alias("wid"), F.col("left_id").alias("lid"), F.col("right_id").alias("rid"), F.col("word_cost").alias("cost"))


def _edges_sql(d: Dictionary, max_grouping: int = 0) -> str:
    return f"WITH {oracle.edges(ITEMS, d, max_grouping)} SELECT id, s, e, wid, lid, rid, cost FROM (FROM made UNION ALL FROM fallback)"


@query(_edges_sql(latin()))
def q_unknown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unknown word that the categories make."""
    return made_edges(spark, sf_dir, latin())


@query(_edges_sql(latin(), 1))
def q_unknown_edges_max1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with runs of more than two characters left ungrouped."""
    return made_edges(spark, sf_dir, latin(), 1)


SPARSE = ("NUMERIC", "SYMBOL", "SPACE")


@query(f"WITH {oracle.edges(ITEMS, latin(SPARSE))} SELECT id, s, e, wid, lid, rid, cost FROM fallback")
def q_fallback_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single characters where nothing else starts, with a dictionary that lacks unknown entries."""
    d = latin(SPARSE)
    own = [i for i, c in enumerate(d.categories) if c.name in SPARSE]
    runs = run_rows(items(spark, sf_dir), d)
    made = made_edges(spark, sf_dir, d).join(runs.where(F.col("base").isin(own)).select("id", F.col("pos").alias("s")), ["id", "s"], "left_semi")
    return made.select("id", "s", "e", "wid", "lid", "rid", "cost")


@query(f"WITH {oracle.chars(ITEMS, latin())}, {oracle.runs(latin())} SELECT id, pos, run_end FROM run WHERE list_contains(category_ids, 1)")
def q_space_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that ignore-space mode passes over, and where it goes on."""
    return lattice.space_links(run_rows(items(spark, sf_dir), latin()), latin(), "id")


@query(
    f"WITH RECURSIVE {oracle.edges(ITEMS, latin())}, met AS (SELECT id, 0 AS at FROM src UNION SELECT g.id, g.e FROM met JOIN edge g ON g.id = met.id AND g.s = met.at) "
    "SELECT g.id, s, e, wid FROM edge g JOIN met ON met.id = g.id AND met.at = g.s"
)
def q_reachable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that start where some chain of edges arrives."""
    texts, d = items(spark, sf_dir), latin()
    positions = texts.select("id", F.explode(Tokenizer(spark, d).reachable("t")).alias("start"))
    return lattice.reachable_edges(lattice.edges(texts, "id", "t", d), positions, "id").select("id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("word_id").alias("wid"))


@query(f"SELECT r.r::INTEGER AS right_id, l.l::INTEGER AS left_id, coalesce(cost, {OUTSIDE_COST}) AS cost FROM range(6) r(r) CROSS JOIN range(6) l(l) LEFT JOIN {oracle.matrix_sql(latin())} ON right_id = r.r AND left_id = l.l")
def q_connection_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of pairs inside and outside the matrix."""
    pairs = spark.range(36).select((F.col("id") % 6).cast("int").alias("right_id"), F.floor(F.col("id") / 6).cast("int").alias("left_id"))
    return lattice.connection_costs(pairs, latin())


# -- best paths


def token_rows(df: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    rows = explode_tokens(df.select("id", tokenizer.tokenize("t").alias("tokens")), "tokens", "id")
    return rows.select("id", "position", "surface", F.col("start_char").alias("s"), F.col("end_char").alias("e"), F.col("word_id").alias("wid"), "feature", F.col("total_cost").alias("total"), "is_unknown")


def _tokens_sql(source: str, d: Dictionary, max_grouping: int = 0, ignore_space: bool = False) -> str:
    return (
        f"{oracle.paths(source, d, max_grouping, ignore_space=ignore_space)} SELECT tok.id, position, substr(t, s + 1, e - s) AS surface, s, e, wid, feature, total, wid >= {UNKNOWN_BASE} AS is_unknown "
        f"FROM tok JOIN src ON src.id = tok.id JOIN {oracle.features(d)} AS feat USING (wid)"
    )


@query(_tokens_sql(PARTS, latin()))
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every part name."""
    return token_rows(parts(spark, sf_dir), Tokenizer(spark, latin()))


@query(_tokens_sql(ITEMS, latin()))
def q_tokens_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every benchmark item."""
    return token_rows(items(spark, sf_dir), Tokenizer(spark, latin()))


@query(_tokens_sql(ITEMS, latin(user=True)))
def q_tokens_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a user lexicon."""
    return token_rows(items(spark, sf_dir), Tokenizer(spark, latin(user=True)))


@query(_tokens_sql(ITEMS, latin(), 3))
def q_tokens_max_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with grouped unknown words of up to four characters."""
    return token_rows(items(spark, sf_dir), Tokenizer(spark, latin(), max_grouping=3))


@query(_tokens_sql(ITEMS, latin(SPARSE)))
def q_tokens_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a dictionary that lacks unknown entries."""
    return token_rows(items(spark, sf_dir), Tokenizer(spark, latin(SPARSE)))


@query(_tokens_sql(ITEMS, latin(), ignore_space=True))
def q_tokens_ignore_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every benchmark item, spaces passed over."""
    return token_rows(items(spark, sf_dir), Tokenizer(spark, latin(), ignore_space=True))


@query(f"{oracle.paths(ITEMS, latin())}, place AS (SELECT tok.*, strlen(substr(t, 1, s))::INTEGER AS a, strlen(substr(t, 1, e))::INTEGER AS b FROM tok JOIN src USING (id)) SELECT id, position, a AS start, b AS \"end\", wid AS word_id FROM place")
def q_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges and ids only."""
    rows = items(spark, sf_dir).select("id", Tokenizer(spark, latin()).tokenize_spans("t").alias("spans"))
    return explode_tokens(rows, "spans", "id")


@query(f"{oracle.paths(ITEMS, latin())} SELECT id, max_by(total, position) AS best_cost FROM tok GROUP BY id")
def q_best_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of each item's best path."""
    return items(spark, sf_dir).select("id", Tokenizer(spark, latin()).path_cost("t").alias("best_cost"))


@query(f"{oracle.paths(PARTS, latin())} SELECT id, count(*)::INTEGER AS n FROM tok GROUP BY id")
def q_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of words of every part name."""
    return parts(spark, sf_dir).select("id", Tokenizer(spark, latin()).tokenize_count("t").alias("n"))


@query(f"{oracle.paths(PARTS, latin())} SELECT count(*) AS words FROM tok")
def q_batch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of words of all part names."""
    return parts(spark, sf_dir).select(Tokenizer(spark, latin()).tokenize_count("t").alias("n")).agg(F.sum("n").alias("words"))


_COUNTED = "counted AS (SELECT src.id AS seg, count(tok.id) AS n FROM src LEFT JOIN tok USING (id) GROUP BY src.id)"


@query(
    f"{oracle.segmented(DOCUMENTS, latin())}, {_COUNTED}, summed AS (SELECT id, sum(n) AS n FROM part JOIN counted USING (seg) GROUP BY id) "
    f"SELECT d.id, CASE WHEN d.t IS NOT NULL THEN coalesce(n, 0) END::INTEGER AS n FROM ({DOCUMENTS}) d LEFT JOIN summed ON summed.id = d.id"
)
def q_count_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of words of every document."""
    return documents(spark, sf_dir).select("id", Tokenizer(spark, latin()).tokenize_count("t").alias("n"))


@query(
    f"{oracle.segmented(DOCUMENTS, latin())}, often AS (SELECT id AS doc, seg, count(*) AS k FROM part GROUP BY ALL), "
    f"found AS (SELECT tok.id AS seg, substr(t, s + 1, e - s) AS surface, wid >= {UNKNOWN_BASE} AS is_unknown, count(*) AS n FROM tok JOIN src USING (id) GROUP BY ALL) "
    "SELECT surface, is_unknown, sum(n * k)::BIGINT AS n, count(DISTINCT doc) AS docs FROM found JOIN often USING (seg) GROUP BY ALL"
)
def q_token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents by surface and kind, with the number of documents."""
    return word_frequencies(documents(spark, sf_dir), "t", Tokenizer(spark, latin())).withColumnRenamed("rows", "docs")


@query(f"{oracle.paths(ITEMS, latin())} SELECT id, sum((wid >= {UNKNOWN_BASE})::INTEGER)::BIGINT AS unknown, count(*) AS words FROM tok GROUP BY id")
def q_unknown_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words of every item."""
    rows = token_rows(items(spark, sf_dir), Tokenizer(spark, latin()))
    return rows.groupBy("id").agg(F.sum(F.col("is_unknown").cast("int")).alias("unknown"), F.count("*").alias("words"))


_SPLIT = "string_split(regexp_replace(d.t, '\\r?\\n', chr(10), 'g'), chr(10))"
_LINES = (
    f"SELECT row_number() OVER () AS id, doc, t FROM (SELECT d.id AS doc, unnest({_SPLIT}) AS t, generate_subscripts({_SPLIT}, 1) AS line, "
    f"len({_SPLIT}) AS lines FROM ({DOCUMENTS}) d) WHERE line < lines OR t <> ''"
)


@query(
    f"{oracle.segmented('SELECT id, t FROM line', latin()).replace('WITH RECURSIVE', f'WITH RECURSIVE line AS MATERIALIZED ({_LINES}),', 1)}, {_COUNTED}, "
    "summed AS (SELECT doc, count(DISTINCT line.id) AS lines, sum(n) AS words FROM line LEFT JOIN part ON part.id = line.id LEFT JOIN counted USING (seg) GROUP BY doc) "
    f"SELECT d.id, CASE WHEN d.t IS NOT NULL THEN coalesce(lines, 0) END::INTEGER AS lines, CASE WHEN d.t IS NOT NULL THEN coalesce(words, 0) END::BIGINT AS words FROM ({DOCUMENTS}) d LEFT JOIN summed ON doc = d.id"
)
def q_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and words of every document, lines taken one by one."""
    return documents(spark, sf_dir).select("id", Tokenizer(spark, latin()).line_counts("t").alias("c")).select("id", "c.lines", "c.words")


# -- whole documents, a row for each with digests of its words


@query(
    f"{oracle.document_tokens(DOCUMENTS, latin())} SELECT id, count(*) AS words, md5(string_agg(s || '-' || e || '-' || wid || '-' || total, ',' ORDER BY s)) AS digest FROM word_at GROUP BY id"
)
def q_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, ids and running costs of all words of every document that has any."""
    rows = documents(spark, sf_dir).select("id", Tokenizer(spark, latin()).tokenize("t").alias("tokens")).where(F.size("tokens") > 0)
    each = F.transform("tokens", lambda t: F.concat_ws("-", t["start_char"].cast("string"), t["end_char"].cast("string"), t["word_id"].cast("string"), t["total_cost"].cast("string")))
    return rows.select("id", F.size("tokens").cast("bigint").alias("words"), F.md5(F.array_join(each, ",").cast("binary")).alias("digest"))


@query(
    f"{oracle.document_tokens(DOCUMENTS, latin())} SELECT id, max_by(total, s)::BIGINT AS best_cost, sum((wid >= {UNKNOWN_BASE})::INTEGER)::BIGINT AS unknown FROM word_at GROUP BY id"
)
def q_document_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of the best path and the unknown words of every document that has words."""
    t = Tokenizer(spark, latin())
    rows = documents(spark, sf_dir).select("id", t.path_cost("t").alias("best_cost"), t.tokenize_spans("t").alias("spans")).where(F.size("spans") > 0)
    return rows.select("id", "best_cost", F.size(F.filter("spans", lambda s: s["word_id"] >= F.lit(UNKNOWN_BASE))).cast("bigint").alias("unknown"))


@query(
    f"{oracle.document_tokens(DOCUMENTS, latin())} SELECT id, md5(string_agg(surface, ' ' ORDER BY s)) AS wakati, "
    f"md5(string_agg(surface || chr(9) || feature || chr(10), '' ORDER BY s) || 'EOS') AS mecab FROM word_at JOIN {oracle.features(latin())} AS feat USING (wid) GROUP BY id"
)
def q_document_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the text formats of every document that has words."""
    rows = documents(spark, sf_dir).select("id", Tokenizer(spark, latin()).tokenize("t").alias("tokens")).where(F.size("tokens") > 0)
    return rows.select("id", *(F.md5(form(F.col("tokens")).cast("binary")).alias(name) for name, form in (("wakati", wakati_text), ("mecab", mecab_text))))


@query()
def q_document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of the JSON form of every document."""
    rows = documents(spark, sf_dir).select("id", Tokenizer(spark, latin()).json("t").alias("json"))
    return rows.select("id", F.octet_length("json").alias("bytes"), F.md5(F.col("json").cast("binary")).alias("digest"))


@query()
def q_document_ignore_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and digest of byte ranges of every document, spaces passed over."""
    rows = documents(spark, sf_dir).select("id", Tokenizer(spark, latin(), ignore_space=True).tokenize_spans("t").alias("spans"))
    each = F.transform("spans", lambda t: F.concat_ws("-", t["start"].cast("string"), t["end"].cast("string"), t["word_id"].cast("string")))
    return rows.select("id", F.size("spans").alias("words"), F.md5(F.array_join(each, ",").cast("binary")).alias("digest"))


@query(
    f"WITH {oracle.edges(DOCUMENTS, latin())} SELECT id, count(*) AS edges, sum((wid >= {UNKNOWN_BASE})::INTEGER)::BIGINT AS unknown, sum(cost)::BIGINT AS cost FROM edge GROUP BY id"
)
def q_document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and unknown edges of every document that has characters."""
    every = lattice.edges(documents(spark, sf_dir), "id", "t", latin())
    unknown = F.sum((F.col("word_id") >= F.lit(UNKNOWN_BASE)).cast("int")).cast("bigint")
    return every.groupBy("id").agg(F.count("*").alias("edges"), unknown.alias("unknown"), F.sum("word_cost").cast("bigint").alias("cost"))


# -- output formats


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", Tokenizer(spark, latin()).tokenize("t").alias("tokens"))


_SURFACE = "substr(t, s + 1, e - s)"
_FEATURED = f"FROM tok JOIN src USING (id) JOIN {oracle.features(latin())} AS feat USING (wid) GROUP BY id"


@query(f"{oracle.paths(ITEMS, latin())} SELECT id, string_agg({_SURFACE}, ' ' ORDER BY s) AS wakati FROM tok JOIN src USING (id) GROUP BY id")
def q_wakati(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words joined by spaces."""
    return _outputs(spark, sf_dir).select("id", wakati_text(F.col("tokens")).alias("wakati"))


@query(f"{oracle.paths(ITEMS, latin())} SELECT id, string_agg({_SURFACE} || chr(9) || feature || chr(10), '' ORDER BY s) || 'EOS' AS mecab {_FEATURED}")
def q_mecab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each word, then EOS."""
    return _outputs(spark, sf_dir).select("id", mecab_text(F.col("tokens")).alias("mecab"))


_OBJECT = (
    f"'{{\"surface\":' || to_json({_SURFACE})::VARCHAR || ',\"feature\":' || to_json(feature)::VARCHAR || ',\"start\":' || strlen(substr(t, 1, s)) || ',\"end\":' || strlen(substr(t, 1, e)) || ',\"startChar\":' || s || "
    f"',\"endChar\":' || e || ',\"wordId\":' || wid || ',\"totalCost\":' || total || ',\"unknown\":' || (wid >= {UNKNOWN_BASE})::VARCHAR || '}}'"
)


@query(f"{oracle.paths(ITEMS, latin())} SELECT id, '[' || string_agg({_OBJECT}, ',' ORDER BY s) || ']' AS json {_FEATURED}")
def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as a JSON array."""
    return _outputs(spark, sf_dir).select("id", json_text(F.col("tokens")).alias("json"))


@query(f"{oracle.paths(PARTS, latin())} SELECT id, count(*)::INTEGER AS words, string_agg({_SURFACE}, ' ' ORDER BY s) AS wakati FROM tok JOIN src USING (id) GROUP BY id")
def q_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions on part names."""
    register(spark, Tokenizer(spark, latin()), "latin_")
    parts(spark, sf_dir).createOrReplaceTempView("latin_parts")
    return spark.sql("SELECT id, latin_count(t) AS words, latin_wakati(t) AS wakati FROM latin_parts")


@query(
    f"{oracle.paths(PARTS, latin())} SELECT id, max_by(total, position)::BIGINT AS cost, '[' || string_agg({_OBJECT}, ',' ORDER BY s) || ']' AS json, "
    f"string_agg({_SURFACE} || chr(9) || feature || chr(10), '' ORDER BY s) || 'EOS' AS mecab, count(*)::INTEGER AS tokens, sum(e - s)::BIGINT AS chars {_FEATURED}"
)
def q_sql_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other registered SQL functions on part names."""
    register(spark, Tokenizer(spark, latin()), "latin_")
    parts(spark, sf_dir).createOrReplaceTempView("latin_parts")
    return spark.sql(
        "SELECT id, latin_cost(t) AS cost, latin_json(t) AS json, latin_mecab(t) AS mecab, size(latin_tokens(t)) AS tokens, "
        "aggregate(latin_spans(t), 0L, (n, s) -> n + s.end - s.start) AS chars FROM latin_parts"
    )


@query(_tokens_sql(PARTS, latin()).replace("SELECT tok.id", "SELECT tok.id AS id"))
def q_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function joined laterally to part names."""
    register(spark, Tokenizer(spark, latin()), "latin_")
    parts(spark, sf_dir).createOrReplaceTempView("latin_parts")
    return spark.sql("SELECT id, position, surface, start_char AS s, end_char AS e, word_id AS wid, feature, total_cost AS total, is_unknown FROM latin_parts, LATERAL latin_rows(t)")


@query(f"SELECT word_id, surface, CASE WHEN p = '' THEN feature ELSE p END AS pos, CASE WHEN r = '*' THEN '' ELSE r END AS reading FROM (SELECT *, array_to_string(list_filter(string_split(feature, ',')[1:4], lambda x: x NOT IN ('', '*')), '-') AS p, coalesce(string_split(feature, ',')[8], '') AS r FROM {oracle.lexicon_sql(latin())})")
def q_feature_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of speech and reading of every word."""
    return latin().tables(spark)["lexicon"].select("word_id", "surface", part_of_speech(F.col("feature")).alias("pos"), reading(F.col("feature")).alias("reading"))


# -- dictionary tables


@query(f"SELECT * FROM {oracle.lexicon_sql(latin())}")
def q_lexicon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon as a table."""
    return latin().tables(spark)["lexicon"]


@query(f"SELECT right_id, left_id, cost::SMALLINT AS cost FROM {oracle.matrix_sql(latin())}")
def q_matrix_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connection matrix as a table."""
    return latin().tables(spark)["connection"]


MINIMAL = "# two words\nmatrix\t2\t2\n0\t-5\n7\t2\n\nentry\tab\t0\t1\t100\tnoun,x\nentry\tb\t1\t0\t-3\tverb\n"


@query(
    "SELECT * FROM (VALUES ('minimal', 0::BIGINT, 'ab', 0, 1, 100, 'noun,x'), ('minimal', 1, 'b', 1, 0, -3, 'verb')) AS m(source, word_id, surface, left_id, right_id, word_cost, feature) "
    + "".join(f"UNION ALL SELECT '{name}', * FROM {oracle.lexicon_sql(latin())} " for name in ("binary", "folder"))
    + "UNION ALL SELECT 'builtin', * FROM (VALUES (0::BIGINT, '本', 0, 0, 10, '名詞-普通名詞-一般,ホン'), (1, 'と', 0, 0, 1, '助詞-格助詞,ト'), (2, 'カレー', 0, 0, 10, '名詞-普通名詞-一般,カレー'))"
)
def q_dictionary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicons that the other sources give: the minimal text, a binary file, a saved folder, and the built-in one."""
    kept = latin()
    made = {"minimal": Dictionary.from_minimal(MINIMAL), "binary": read_dictionary(write_dictionary(kept)), "folder": Dictionary.from_tables(kept.tables(spark)), "builtin": Dictionary.builtin()}
    every = [d.tables(spark)["lexicon"].select(F.lit(name).alias("source"), "*") for name, d in made.items()]
    return reduce(DataFrame.unionByName, every)


@query(f"SELECT * FROM {oracle.lexicon_sql(latin())} WHERE left_id > 2 OR right_id > 2")
def q_invalid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose ids a smaller matrix does not have."""
    tables = latin().tables(spark)
    return invalid_ids(tables["lexicon"], tables["connection"].where("right_id < 3 AND left_id < 3"))


@query(f"SELECT surface, left_id, right_id, min(word_cost) AS word_cost FROM {oracle.lexicon_sql(latin())} GROUP BY ALL")
def q_dedup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest word of each surface and pair of ids."""
    return lattice.cheapest_terms(latin().tables(spark)["lexicon"])


_EXTRA = "UNION ALL SELECT surface, (left_id + 1) % 4 AS left_id, right_id, word_cost + 150 AS word_cost FROM terms"


@query(
    f"WITH terms AS (SELECT surface, left_id, right_id, min(word_cost) AS word_cost FROM {oracle.lexicon_sql(latin())} GROUP BY ALL), every AS (SELECT * FROM terms {_EXTRA}), mat AS (SELECT * FROM {oracle.matrix_sql(latin())}), "
    "pair AS (SELECT t.surface, t.right_id, t.left_id AS tl, o.left_id AS ol, bool_and(a.cost + o.word_cost <= b.cost + t.word_cost) AS below, bool_and(a.cost + o.word_cost = b.cost + t.word_cost) AS same "
    "FROM every t JOIN every o ON o.surface = t.surface AND o.right_id = t.right_id AND o.left_id <> t.left_id JOIN mat a ON a.left_id = o.left_id JOIN mat b ON b.left_id = t.left_id AND b.right_id = a.right_id GROUP BY ALL) "
    "SELECT surface, left_id, right_id, word_cost FROM every e WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.surface = e.surface AND p.right_id = e.right_id AND p.tl = e.left_id AND below AND (NOT same OR ol < tl))"
)
def q_dominated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms, and dearer variants of them, without those that no best path can take."""
    terms = lattice.cheapest_terms(latin().tables(spark)["lexicon"])
    variants = terms.select("surface", ((F.col("left_id") + 1) % 4).alias("left_id"), "right_id", (F.col("word_cost") + 150).alias("word_cost"))
    return lattice.undominated_terms(terms.unionByName(variants), latin()).select("surface", "left_id", "right_id", "word_cost")


@query(
    f"WITH terms AS (SELECT category_id, left_id, right_id, min(word_cost) AS word_cost FROM {oracle.unknown_sql(latin())} GROUP BY ALL), every AS (SELECT * FROM terms UNION ALL SELECT category_id, (left_id + 2) % 4, right_id, word_cost + 400 FROM terms), mat AS (SELECT * FROM {oracle.matrix_sql(latin())}), "
    "pair AS (SELECT t.category_id, t.right_id, t.left_id AS tl, o.left_id AS ol, bool_and(a.cost + o.word_cost <= b.cost + t.word_cost) AS below, bool_and(a.cost + o.word_cost = b.cost + t.word_cost) AS same "
    "FROM every t JOIN every o ON o.category_id = t.category_id AND o.right_id = t.right_id AND o.left_id <> t.left_id JOIN mat a ON a.left_id = o.left_id JOIN mat b ON b.left_id = t.left_id AND b.right_id = a.right_id GROUP BY ALL) "
    "SELECT category_id, left_id, right_id, word_cost FROM every e WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.category_id = e.category_id AND p.right_id = e.right_id AND p.tl = e.left_id AND below AND (NOT same OR ol < tl))"
)
def q_dominated_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown entries of each category, and dearer variants of them, without those that no best path can take."""
    terms = latin().tables(spark)["unknown"].groupBy("category_id", "left_id", "right_id").agg(F.min("word_cost").alias("word_cost"))
    variants = terms.select("category_id", ((F.col("left_id") + 2) % 4).alias("left_id"), "right_id", (F.col("word_cost") + 400).alias("word_cost"))
    return lattice.undominated_terms(terms.unionByName(variants), latin(), on="category_id").select("category_id", "left_id", "right_id", "word_cost")


# -- pages and streams


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


#: Character references of the tables' pages; the last one resolves what the others leave.
_REFERENCES = (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&"))


def _page_sql() -> str:
    shown = "html"
    for pattern, put in ((html.UNSEEN, ""), (html.BREAK, "\n"), (html.TAG, ""), *_REFERENCES):
        shown = f"regexp_replace({shown}, {oracle.text(pattern)}, {oracle.text(put)}, 'g')"
    folded = f"list_transform(string_split({shown}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
    return f"SELECT page_id, array_to_string(list_filter({folded}, lambda x: x <> ''), chr(10)) AS text FROM pages"


@query(_page_sql())
def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return pages(spark, sf_dir).select("page_id", html.page_text("html").alias("text"))


@query(
    f"{oracle.segmented('SELECT page_id AS id, text AS t FROM page', latin()).replace('WITH RECURSIVE', f'WITH RECURSIVE page AS MATERIALIZED ({_page_sql()}),', 1)}, {_COUNTED}, "
    "summed AS (SELECT id, sum(n) AS n FROM part JOIN counted USING (seg) GROUP BY id) "
    "SELECT page_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END::INTEGER AS words FROM page LEFT JOIN summed ON id = page_id"
)
def q_page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the visible text of every page."""
    return pages(spark, sf_dir).select("page_id", Tokenizer(spark, latin()).tokenize_count(html.page_text("html")).alias("words"))


PROPS = "SELECT row_number() OVER () AS id, props AS t FROM (SELECT DISTINCT props FROM events WHERE props IS NOT NULL)"


@query(
    f"{oracle.paths(PROPS, latin())}, counted AS (SELECT src.t, count(tok.id) AS n FROM src LEFT JOIN tok USING (id) GROUP BY ALL) "
    "SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS rows, sum(n)::BIGINT AS words FROM events LEFT JOIN counted ON t = props GROUP BY ALL"
)
def q_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of event properties in windows of one hour, by event type; streams take the same column and plan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = windowed_counts(events, Tokenizer(spark, latin()), time="ts", text="props", window="1 hour", by="event_type")
    return counts.withColumn("window_start", F.unix_timestamp("window_start"))
