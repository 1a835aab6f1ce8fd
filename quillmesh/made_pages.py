"""Pages, files and records that Spark makes from rows of the given tables, for queries over what ``pages`` does not show.

A template names a row's values as @K (its key), @N (a name) and @S (a size); the SQL of a query fills the
same values into what the template gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: for each table: its columns that stand for @K, @N and @S
VALUES = {
    "part": ("p_partkey", "p_name", "p_size"),
    "customer": ("c_custkey", "c_mktsegment", "c_nationkey"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
}

#: rows of a table that one task makes pages or files of
ROWS_A_PART = 4_000

#: a page with every kind of block and of metadata
PRODUCT = """<html lang="en"><head><title>plain @N</title><meta name="author" content="Ann Lee"><meta name="description" content="Item @K"><meta property="og:title" content=" @N @K "><meta name="og:title" content="other"><meta property="og:image" content="/i/@K.png"><meta property="og:image" content="/j/@K.png"><meta name="twitter:card" content="s"><meta property="twitter:card" content="p@S"><meta property="article:published_time" content="2024-05-06"><link rel="apple-touch-icon" href="/t.png"><link rel="canonical" href="/c/@K"><meta name="generator" content="Hugo 0.1"><script type="application/ld+json">[{"@type":"Organization","@id":"#o","name":"Makers"},{"@context":"x","@graph":[{"@type":"schema:Product","@id":"#p@K","name":"@N","author":{"name":"Ann Lee"}}]}]</script><script type="application/ld+json">{bad</script></head><body class="flex px-2 py-3 bg-red-5"><p id="i@K" class="c d">by Ann Lee</p><h1>@N <em>@K</em></h1><div><section><h2>in @K</h2><p><img src="@K.png" alt="x"></p></section><p><a href="/l/@K">go</a></p></div><blockquote>q *@K*</blockquote><pre class="language-py">x = @K
y</pre><ol><li>a @K</li><li><a href="/u/@K">b</a></li></ol><table><tr><th>h</th><th>k</th></tr><tr><td>1|@K</td><td>$@S</td></tr></table><h2>Second</h2>loose @N<img src="/j@K.png"><p>call 555-123-4567, 4/5</p><h2>Third @K</h2></body></html>"""


def filled(text: str | None, table: str) -> Column:
    """A template with a row's values."""
    out = F.lit(text).cast("string")
    for mark, column in zip(("@K", "@N", "@S"), VALUES[table]):
        out = F.replace(out, F.lit(mark), F.col(column).cast("string"))
    return out


def filled_sql(expression: str, table: str) -> str:
    """The same in SQL, of an expression."""
    for mark, column in zip(("@K", "@N", "@S"), VALUES[table]):
        expression = f"replace({expression}, '{mark}', CAST({column} AS VARCHAR))"
    return expression


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def table_rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """What templates need of a table, dealt out by rows: a few MB of a table make GB of pages, which the splits of its file would leave to one task."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*VALUES[table])
    return rows.repartition(max(1, -(-rows.count() // ROWS_A_PART)))


def made(spark: SparkSession, sf_dir: str, table: str, **templates: str | None) -> DataFrame:
    """(k, the named templates) of every row of a table."""
    rows = table_rows(spark, sf_dir, table)
    return rows.select(F.col(VALUES[table][0]).alias("k"), *[filled(t, table).alias(n) for n, t in templates.items()])


def made_rows(spark: SparkSession, sf_dir: str, table: str, names: str, rows: list[tuple]) -> DataFrame:
    """(k, n, the named columns): for every row of a table one row for each of ``rows``; strings are templates."""
    each = [F.struct(F.lit(n).alias("n"), *[(filled(v, table) if v is None or isinstance(v, str) else F.lit(v)).alias(c) for c, v in zip(names.split(), row)]) for n, row in enumerate(rows)]
    return table_rows(spark, sf_dir, table).select(F.col(VALUES[table][0]).alias("k"), F.explode(F.array(*each)).alias("x")).select("k", "x.*")


def rows_sql(table: str, names: str, rows: list[tuple], key: str = "k") -> str:
    """SQL of known rows, templates again, for every row of a table."""
    columns = names.split()
    text = {c for i, c in enumerate(columns) if any(isinstance(r[i], str) for r in rows)}
    said = ", ".join("(" + ", ".join(quoted(v) if v is None or isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    shown = ", ".join(f"{filled_sql(c, table)} AS {c}" if c in text else c for c in columns)
    return f"SELECT {VALUES[table][0]} AS {key}, {shown} FROM {table}, (VALUES {said}) AS t({', '.join(columns)})"


def product_pages(spark: SparkSession, sf_dir: str, html: str = PRODUCT) -> DataFrame:
    """A page for each part."""
    return made(spark, sf_dir, "part", url="https://x.org/d/@K#f", html=html).withColumnRenamed("k", "page_id")
