import os

import pytest

import __spark_entry__
from folia import bindings

SF = "/root/testdata/sf0.001"


def test_queries_and_oracles_agree_on_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(bindings.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and {"doc_id", "status"} <= set(df.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
@pytest.mark.parametrize("name", ["page_confidence", "gate_status_strict", "consensus", "question_segments", "otsu", "job_latest", "document_assembly", "image_question_assoc",
                                  "output_valid", "degraded_pages", "options", "fuzzy_similarity", "table_rows", "job_with_stored", "latex_text", "document_html",
                                  "uploads", "missing_pages", "storage_keys", "usable_diagrams", "canonical_json", "doc_stats", "image_paths", "enriched_pages", "engine_routing", "question_order", "json_list", "safe_limits"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = bindings.QUERIES[name](spark, SF).toPandas(), c.execute(bindings.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    value = lambda v: "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    plain = lambda df: sorted(tuple(map(value, row)) for row in df[columns].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
def test_figures_of_the_whole_table(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = sorted(c.execute(bindings.ORACLE_SQL["figure_area_whole"]).fetchall())
    got = bindings.QUERIES["figure_area_whole"](spark, SF).collect()
    assert sorted(tuple(map(int, r)) for r in got) == [tuple(map(int, r)) for r in want] and len(got) > 0


def test_figures_up_to_a_page(spark):
    kind = "doc_id long, xref long, page_number long, idx long, box_w double, box_h double"
    rows = spark.createDataFrame([(1, 1, 5000, 1, 50.0, 50.0), (1, 2, 5001, 1, 50.0, 50.0), (1, 3, 1, 1, 5.0, 5.0)], kind)
    from folia.operators import images

    assert {r.xref for r in images.figures(rows).collect()} == {1, 2}
    assert {r.xref for r in images.figures(rows, max_pages=5000).collect()} == {1}
