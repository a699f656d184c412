"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from tidemark.llm.codes import op6_addressable_codes
from tidemark.llm.extraction import op3_host_suffix_array
from tidemark.llm.language import op8_rank_order_language
from tidemark.llm.merkle import op7_merkle_fingerprints
from tidemark.llm.neardup import op10_bbit_minhash
from tidemark.llm.oracle import jump_shards_sql, language_sql, merkle_sql, near_duplicates_sql, quality_sql
from tidemark.llm.packing import op5_pattern_packing
from tidemark.llm.pieces import op9_prefix_table_pieces
from tidemark.llm.quality import op2_repetition_coverage
from tidemark.llm.sharding import op4_jump_sharding
from tidemark.llm.suffixtree import op1_suffix_tree

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_tree, op2_repetition_coverage, op3_host_suffix_array, op4_jump_sharding, op5_pattern_packing,
        op6_addressable_codes, op7_merkle_fingerprints, op8_rank_order_language, op9_prefix_table_pieces, op10_bbit_minhash,
    )
}
#: The others need a tokenizer, a learned model or a hash that DuckDB lacks: tests hold them against brute force or an exact round trip.
ORACLE_SQL: dict[str, str] = {
    "op2_repetition_coverage": quality_sql(),
    "op4_jump_sharding": jump_shards_sql(),
    "op7_merkle_fingerprints": merkle_sql(),
    "op8_rank_order_language": language_sql(),
    "op10_bbit_minhash": near_duplicates_sql(3, 85),
}
