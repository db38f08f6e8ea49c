"""Schemas of the dictionary tables and of tokens, and the numbers that tell kinds of words apart."""

from __future__ import annotations

# Word ids of user words start here, those of unknown words here; BEGIN is the id before the first word.
USER_BASE = 1 << 30
UNKNOWN_BASE = 1 << 31
BEGIN_ID = (1 << 32) - 1
#: The cost of a pair of connection ids outside the matrix (fixed value).
OUTSIDE_COST = 536870911
#: The cost and feature of an unknown word whose category has no entry (fixed values).
FALLBACK_COST, FALLBACK_FEATURE = 10000, "UNK"

LEXICON = "word_id bigint, surface string, left_id int, right_id int, word_cost int, feature string"
CONNECTION = "right_id int, left_id int, cost smallint"
CATEGORY = "category_id int, name string, invoke boolean, `group` boolean, length int"
RANGE = "range_id int, start int, end int, category_ids array<int>"
UNKNOWN = "unk_id int, category_id int, left_id int, right_id int, word_cost int, feature string"

TOKEN = "struct<surface:string,start:int,end:int,start_char:int,end_char:int,word_id:bigint,feature:string,total_cost:bigint,is_unknown:boolean>"
TOKENS = f"array<{TOKEN}>"
SPANS = "array<struct<start:int,end:int,word_id:bigint>>"


class DictionaryError(ValueError):
    """A dictionary source is malformed or inconsistent."""
