"""The SQL that joins on the similarity of shingle sets are checked against: all pairs that share a shingle, compared in full."""

from __future__ import annotations


def components_sql(shingle_words: int, threshold: tuple[int, int], kept: bool = False) -> str:
    """``doc_id, n_shingles, component_id`` of ``documents``, and with ``kept`` whether a document is its component's first."""
    numerator, denominator = threshold
    more = ", doc_id = component_id AS kept" if kept else ""
    return rf"""
    WITH RECURSIVE own AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), shingles AS (
      SELECT DISTINCT doc_id, array_to_string(words[i:i + {shingle_words - 1}], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - {shingle_words - 1}) + 1)) AS i FROM own WHERE len(words) > 0)
    ), sizes AS (
      SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
    ), shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM shingles a JOIN shingles b USING (shingle)
      WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
    ), linked AS (
      SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE {denominator} * both_have >= {numerator} * (x.n + y.n - both_have)
    ), ways AS (
      SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
    ), reached AS (
      SELECT doc_id, doc_id AS node FROM documents
      UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON reached.node = ways.a
    ), found AS (
      SELECT doc_id, min(node) AS component_id FROM reached GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{more} FROM found LEFT JOIN sizes USING (doc_id)"""
