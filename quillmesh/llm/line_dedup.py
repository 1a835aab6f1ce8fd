"""Operator 3, line dedup: overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm.common import documents
from quillmesh.llm.repeats import remove_repeats

WINDOW = 3


def line_dedup(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Removes lines covered by ``window`` consecutive lines that also stand earlier in the corpus.

    Lines are the parts between line feeds, compared byte for byte; a document of fewer lines than a
    window loses none.  Covered positions of overlapping windows are merged before lines go.  See
    ``remove_repeats`` for the defined results of nulls, ties, repeated rows and empty tables.
    """
    return remove_repeats(docs, unit="lines", window=window, prefilter=False, id_col=id_col, text_col=text_col, keep_columns=keep_columns, with_text=with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return out.withColumnsRenamed({"n_units": "n_lines"})


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p
           FROM documents),
w AS (SELECT doc_id, p, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM l
      WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM f WHERE k > 1),
m AS (SELECT l.doc_id, l.p, line, g.p IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.p = g.p)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
