"""Operator 1, substring dedup: passages repeated word for word leave all but their first place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import documents
from quillmesh.llm.repeats import remove_repeats

WINDOW = 20


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, keep_columns: list[str] | None = None) -> DataFrame:
    """Removes words covered by a ``window``-word sequence that also starts earlier.

    Recompression gives every document its symbols; names seen once in the corpus rule out the
    windows that hold them, and the windows left are compared by 96-bit hashes.  See
    ``remove_repeats`` for the defined results of nulls, ties, repeated rows and empty tables.
    """
    return remove_repeats(docs, unit="words", window=window, prefilter=True, id_col=id_col, text_col=text_col, keep_columns=keep_columns, with_text=with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
y AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS s FROM x),
z AS (SELECT doc_id, p, first_value(doc_id) OVER k AS d0, first_value(p) OVER k AS p0
      FROM y WINDOW k AS (PARTITION BY s ORDER BY doc_id, p)),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM z WHERE (doc_id, p) <> (d0, p0)),
gl AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
n AS (SELECT d.doc_id, w, coalesce(ps, []::BIGINT[]) AS ps FROM d LEFT JOIN gl USING (doc_id)),
u AS (SELECT n.doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM n) AS n
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = n.doc_id AND g.p = n.i)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u GROUP BY doc_id)
SELECT n.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)
"""
