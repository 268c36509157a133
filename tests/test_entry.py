from pathlib import Path

import pytest

import __spark_entry__ as e

DATA = Path("/root/testdata/sf0.001")


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_flagship(spark):
    df = e.entry(spark)
    assert df.columns == ["corpus", "outlet_clean", "frame", "n_applicable", "n_present", "pct"] and df.count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("rows", ["none", "with nulls"])
def test_empty_tables_and_nulls(spark, tmp_path, rows):
    """No query of the core fails on tables without rows, or on rows that are null in every column."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from loomline.plans import catalog

    for f in DATA.glob("*.parquet"):
        t = pq.read_table(f)
        nulls = pa.table({c: pa.nulls(2, t.schema.field(c).type) for c in t.column_names})
        pq.write_table(t.slice(0, 0) if rows == "none" else pa.concat_tables([t.slice(0, 40), nulls]), tmp_path / f.name)
    failed = {}
    for name, q in catalog.queries().items():
        try:
            q(spark, str(tmp_path)).collect()
        except Exception as e:
            failed[name] = str(e)[:200]
    assert not failed
