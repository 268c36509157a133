from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomline.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("rows", ["none", "with nulls"])
def test_empty_tables_and_nulls(spark, tmp_path, rows):
    """No query fails on tables without rows, or on rows that are null in every column."""
    for f in DATA.glob("*.parquet"):
        t = pq.read_table(f)
        nulls = pa.table({c: pa.nulls(2, t.schema.field(c).type) for c in t.column_names})
        pq.write_table(t.slice(0, 0) if rows == "none" else pa.concat_tables([t.slice(0, 60), nulls]), tmp_path / f.name)
    failed = {}
    for name, q in queries.queries().items():
        try:
            q(spark, str(tmp_path)).collect()
        except Exception as e:
            failed[name] = str(e)[:200]
    assert not failed
