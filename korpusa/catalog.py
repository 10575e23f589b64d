"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import answers, audits, chunking, composed, indexed, operations, paragraphs, parsing, records, regulations, retrieval, rules, star, stores, streams, vector_indexes

MODULES = (retrieval, composed, indexed, operations, rules, answers, audits, chunking, regulations, paragraphs, parsing, records, streams, stores, vector_indexes, star)
#: Rules over a few inline rows, which other queries apply to whole tables (named in the README): tested, not registered.
INLINE = frozenset(
    "metadata_boost rerank_boosted literal_table_search literal_indicator_search classify_queries expand_queries focus_terms natural_order sse_events "
    "answer_quality answer_validation regulation_nodes regulation_chunks score_rows markdown_sections letter_sections indicator_blocks".split()
)
_ALL = {name: f for m in MODULES for name, f in m.QUERIES.items()}
QUERIES = {name: f for name, f in _ALL.items() if name not in INLINE}
RULES = {name: _ALL[name] for name in INLINE}
#: SQL of both.
SQL = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
ORACLES = {name: sql for name, sql in SQL.items() if name in QUERIES}
