"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from conftest import SF

import __spark_entry__ as entry
import check

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, connection, name):
    result, _, _ = check.compare(spark, SF, name, connection)
    assert result.startswith("ok" if name in ORACLES else "rows only"), result
    assert "TYPES" not in result, result


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.rows_flagged for r in rows) > 0 and sum(r.rows_clean for r in rows) > 0


def test_queries_hold_the_rows_that_they_are_about(spark):
    """Null, empty, blank and padded texts, titles beside contents, six classes, an absent class file, changed keys."""
    query = entry.queries()
    by_field = {r.field: r for r in query["spans_by_field"](spark, SF).collect()}
    assert by_field["title"].with_spans > 0 and by_field["title"].padded_spans == 0
    assert all(by_field["content"][c] > 0 for c in ("with_spans", "without", "blank_spans", "padded_spans"))
    found = query["mentions_padded"](spark, SF)
    assert found.filter("field = 'title'").count() > 0 and found.filter("field = 'content'").count() > 0
    assert found.filter("entity = '' or entity <> trim(entity)").count() == 0
    assert query["inventory_file_sizes"](spark, SF).filter("mentions > 0 and sized").count() == 6
    assert {r.context for r in query["inventory_class_files"](spark, SF).select("context").distinct().collect()} == {"pers", "loc", "org", "pro", "event"}
    assert {r.status for r in query["table_verify_by_ranges"](spark, SF).collect()} == {"missing", "mismatch"}
    assert query["first_n_most_keys"](spark, SF).count() > 1000
    assert query["stream_run_metrics"](spark, SF).first().mentions_committed > 0


def test_supplier_files_are_written_by_many_tasks_one_for_each_supplier(spark):
    import os

    from nomenroll.catalog.queries import _supplier_files

    root = _supplier_files(spark, SF).removeprefix("file:")
    files = [os.listdir(f"{root}/{d}") for d in os.listdir(root) if d.startswith("s_suppkey=")]
    names = [f for inside in files for f in inside if f.startswith("part-")]
    assert len(names) == len(files) > 1 and len({f.split("-")[1] for f in names}) > 1
