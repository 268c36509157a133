import pytest

from loomline.plans import catalog


def broadcast_files(df) -> list[str]:
    """The file scans below a broadcast in the plan that ran."""
    df.collect()
    found, below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        below = None if below is not None and depth <= below else below
        if below is None and "BroadcastExchange" in line:
            below = depth
        elif below is not None and "Scan parquet" in line:
            found.append(line)
    return found


@pytest.mark.parametrize("name", ["annotated_rows", "response_state", "skip_reason"])
def test_answers_are_joined_by_shuffle(spark, name):
    """However small the files are, what is parsed from them is not sent through the driver."""
    assert broadcast_files(catalog.queries()[name](spark, "/root/testdata/sf0.001")) == []
