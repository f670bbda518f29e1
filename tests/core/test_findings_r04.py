"""Edges of the queries' SQL: empty lines, other marks and other spaces at fences. What the layout of pages does once."""

import time

import duckdb
import pytest
from folioforge.operators import layout
from folioforge.plans import queries
from pyspark.sql import functions as F

TEXTS = ["", "a.\nb.\n", "a.\nb.\n\nc.\nd", "\na", "~~~\na\n~~~", "~~~\n```\n~~~\nb", "　```\na\n  ```x\nb", "\t```\na", "```\n```\n```", None]


@pytest.mark.parametrize("first", [1, 3, 4, 12])
def test_lines_of_fences_and_of_prose(spark, tmp_path, first):
    """Each text by an id with and without a fence before it and an open one after it."""
    rows = [(first + 12 * k, x) for k, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = db.execute(queries.SQL["doc_fence_segments"]).fetchall()
    got = queries.doc_fence_segments(spark, str(tmp_path)).select("doc_id", "prose_lines", "code_lines", "n_code").collect()
    assert sorted(map(tuple, got)) == sorted(wanted) and len(wanted) == len(TEXTS) - 1


def test_words_of_pages_are_made_once(spark, tmp_path):
    """Words become lines before anything is measured: no join, no window over a page's words; lines are dealt once more, so that no task has too many generated classes."""
    rows = [(k, "Title\na bb ccc dddd eeeee ff\ngg hh") for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (queries.ocr_reconstruct, queries.ocr_blocks):
        out = query(spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Join" not in plan and plan.count("Generate posexplode") == 2 and plan.count("Exchange hashpartitioning") == 2
        assert out.count() >= 12


def test_columns_of_many_positions(spark):
    """Positions are sorted once, not for each of them."""
    xs = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: (x * 7919) % 20_011).alias("xs"))
    begun = time.monotonic()
    got = xs.select(layout.column_anchors(F.col("xs")).alias("a")).first()["a"]
    assert got[0] == 1.0 and all(b - a > 1200 for a, b in zip(got, got[1:], strict=False)) and time.monotonic() - begun < 20
