"""What must hold so that work spreads and stays bounded as tables grow."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import _cell
from quillmesh import catalog, made_pages
from quillmesh.functions.text import trimmed
from quillmesh.sources import pages
from quillmesh.sources.pages import ParseOptions, parse_page


def test_pages_of_a_small_file_are_dealt_out(spark, data, monkeypatch):
    """A table's single small file would be one task, whatever is made of its rows."""
    monkeypatch.setattr(made_pages, "ROWS_A_PART", 30)
    for frame in (made_pages.product_pages(spark, data), made_pages.made_rows(spark, data, "customer", "raw", [("@K",), ("b",)])):
        counts = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
        assert len(counts) >= 4 and max(counts) <= 3 * min(counts)


def test_references_cut_short(spark, tmp_path):
    """Titles cut inside a reference: &amp without a semicolon is read in whole reads, not in titles, headings and texts."""
    html = "<html lang='en'><title>A &amp; B&amp</title><body><h1>A &amp; B&amp</h1><p>a&b &amp;&am x &lt</p><script type='application/ld+json'>{'a':'b&c'}</script></body></html>".replace("'", '"')
    spark.createDataFrame([(1, "https://x.org/a", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    title, heading = (catalog.QUERIES[q](spark, str(tmp_path)).collect()[0] for q in ("page_title_lang", "page_headings"))
    assert title["title"] == heading["heading"] == "A & B&amp"
    assert {catalog.QUERIES[q](spark, str(tmp_path)).collect()[0][c] for q, c in (("page_text", "body"), ("page_parsed_text", "text_content"))} == {"A & B&ampa&b &&am x &lt"}
    assert parse_page(html, "", ParseOptions(), ("facts",))["title_tag"] == "A & B&"
    assert parse_page(html, "", ParseOptions(bare_references=False), ("facts",))["jsonld"] == ['{"a":"b&c"}']


def test_ids_of_a_graph_name_labels(spark, tmp_path):
    """A paragraph that the rules call an author's keeps the type of a page's element, but its id names the label."""
    html = "<html><body><p>By Ann Lee</p></body></html>"
    spark.createDataFrame([(1, "https://x.org/a", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    document = catalog.QUERIES["page_graph"](spark, str(tmp_path)).collect()[0]["document"]
    assert "#block-author-" in document and '"Person"' not in document


def test_lines_are_trimmed_once(spark, data):
    """A filter by label takes the text's expression along; it must not stand there once for each rule."""
    for name in ("marker_wrap", "marker_round_trip"):
        plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("trim(both") + plan.count("trim(") <= 4


def test_trimmed_takes_wide_spaces(spark):
    said = spark.createDataFrame([("\u00a0\u3000 a b\t\ufeff\n",), (" \u2003",), ("x",), (None,)], "c string").select(trimmed(F.col("c")).alias("c"))
    assert [r["c"] for r in said.collect()] == ["a b", "", "x", None]


def test_slices_are_bounded(monkeypatch):
    """Python turns a batch into objects in parts of bounded size; rows keep their order, and a long row is a part of its own."""
    monkeypatch.setattr(pages, "CHUNK_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4, 5], "t": ["abcd", "efgh", None, "x" * 40, "y" * 9]})
    parts = list(pages.slices(batch, 1))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2, 3], [4], [5]]


def _dealt(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_changes_and_nodes_are_dealt_out_once(spark):
    """Both sides of a comparison by their group, a graph's nodes by their page: nothing that follows deals them out again."""
    from quillmesh.operators import diff as D
    from quillmesh.operators import graph as K

    ddl = "url string, key string, ord int, content string, classification string"
    before = spark.createDataFrame([("u", "a", 0, "x", "p"), ("u", "b", 1, "y", None), ("u", "b", 3, "z", None), (None, "a", 0, "x", None)], ddl)
    after = spark.createDataFrame([("u", "b", 0, "z", "q"), ("u", "c", 1, "n", None), ("w", "a", None, None, None), (None, "a", 0, "x", None)], ddl)
    found = D.changes(before, after)
    assert _dealt(found) == 1
    assert {(r.url, r.change_ord, r.key, r.change, r.classification, r.before, r.after) for r in found.collect()} == {
        ("u", 0, "b", "unchanged", "q", "z", "z"), ("u", 1, "c", "added", None, None, "n"), ("u", 2, "a", "removed", "p", "x", None),
        ("w", 0, "a", "added", None, None, None), (None, 0, "a", "added", None, None, "x"), (None, 1, "a", "removed", None, "x", None),
    }
    pairs = spark.createDataFrame([(1, 0, "a", "@type", 0, '"T"'), (1, 0, "a", "name", 1, '"x"'), (1, 2, "a", "name", 1, '"y"'), (2, 0, "b", "@type", 0, '"T"')], "page_id long, node_ord int, id string, prop string, prop_ord int, value string")
    documents = K.graph_documents(K.merge_nodes(pairs))
    assert _dealt(documents) == 1
    assert sorted((r.page_id, r.n_nodes, r.document.partition('"@graph":')[2]) for r in documents.collect()) == [(1, 1, '[{"@id":"a","@type":"T","name":"x"}]}'), (2, 1, '[{"@id":"b","@type":"T"}]}')]


def test_bodies_of_graphs_are_made_in_the_page_s_row(spark, data):
    """Spark takes a table of a few MB for its pages' documents too, and would send these to the driver to join them."""
    frame = catalog.QUERIES["part_graph"](spark, data)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan and _dealt(frame) == 0


def test_nodes_merge_alike_in_a_row_and_over_rows(spark):
    """An id that comes back, properties that do, nodes without an id, a type or a value, and separators of lines in a text."""
    from quillmesh.operators import graph as K

    ddl = "page_id long, every array<struct<k:int,o:int,id:string,type:string,pairs:array<struct<prop:string,value:string>>>>"
    a = (1, 1, "a", "T", [("name", '"x"'), ("more", "1")])
    pages = [
        (1, [(0, 0, "z", "W", []), a, (2, 0, "b", None, [("name", None)]), (2, 1, "a", "U", [("name", '"y"'), ("last", "2")]), (2, 2, "_:anon2", "V", [("name", '"z"')]), (3, 0, None, "P", [("name", '"n"')]), (3, 0, "b", None, [("q", "3")])]),
        (2, [a, a]), (3, []), (4, None), (5, [(0, 0, None, "P", [])]), (6, [(0, 0, " \x85\"]", "W", [])]),
    ]
    rows = spark.createDataFrame(pages, ddl)
    mine = {r.page_id: (r.x.n_nodes, r.x.document) for r in rows.select("page_id", K.page_document(K.node_props(F.col("every"))).alias("x")).collect() if r.x}
    flat = rows.select("page_id", F.posexplode("every").alias("node_ord", "n"))
    pairs = flat.select("page_id", "node_ord", "n.id", F.posexplode(K._typed(F.col("n"))).alias("prop_ord", "p")).select("page_id", "node_ord", "id", "prop_ord", "p.*").filter("value IS NOT NULL AND id IS NOT NULL")
    assert mine == {r.page_id: (r.n_nodes, r.document) for r in K.graph_documents(K.merge_nodes(pairs)).collect()}
    graph = {k: v[1].partition('"@graph":')[2] for k, v in mine.items()}
    assert graph[1] == '[{"@id":"z","@type":"W"},{"@id":"a","@type":"T","name":"x","more":1,"last":2},{"@type":"V","name":"z"},{"@id":"b","q":3}]}'
    assert graph[6] == '[{"@id":" \x85\\"]","@type":"W"}]}' and sorted(graph) == [1, 2, 6]


def test_part_labels_heeds_the_time(spark, data):
    """Each of a page's stages shows in its labels: the time beats the author, and that the linked data."""
    from collections import Counter

    frame = catalog.QUERIES["part_labels"](spark, data)
    found = Counter((r.classification, r.confidence) for r in frame.select("classification", "confidence").collect())
    parts = spark.read.parquet(f"{data}/part.parquet").count()
    assert found["date", 0.9] == found["author", 0.9] == parts and found["product", 0.95] == 2 * parts


CUT = """
page_blocks_flat
page_blocks_lateral
page_graph
page_json
page_markdown
page_marked_markdown
page_metadata_record
page_snapshots
page_toon
""".split()


@pytest.mark.parametrize("name", CUT)
def test_cut_references_of_whole_reads_are_those_of_their_sql(name, spark, tmp_path):
    """Of references without a semicolon the SQL of whole reads takes &amp alone for one."""
    import duckdb

    shown = ["&quot", "&lt b", "&gt", "&copy", "&amp", "A&AMP", "&middot", "&amplt;", "&amp;lt", "&ampquot", "&quot;&lt;"]
    html = '<html lang="en"><head><title>T {0}</title><script>x="&amp &lt"</script></head><body><nav><ul><li><a href="/a">n {0}</a></li></ul></nav><div class="ad">d {0}</div><article><h1>T {0}</h1><p><b>b {0}<br><p>c {0} d</p></article><footer>&copy; f</footer></body></html>'
    rows = [(k, f"https://x.org/{k}", html.format(x)) for k, x in enumerate(shown)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    mine = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = base.execute(catalog.ORACLES[name]).df()
    said = [sorted(tuple(_cell(v) for v in r) for r in x[sorted(mine.columns)].itertuples(index=False)) for x in (mine, theirs)]
    assert said[0] == said[1] and len(mine) >= len(rows)


def test_cached_graphs_differ_by_their_references():
    from quillmesh.plans.options import GraphOptions, cache_key

    keys = [cache_key("https://x.org/a", GraphOptions(bare_references=b)) for b in (True, False, ("amp",))]
    assert len(set(keys)) == 3 and keys[0] == cache_key("https://x.org/a", GraphOptions())
