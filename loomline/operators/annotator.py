"""Annotation by a pluggable function, in batches beside the data; no client of any service is part of it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (text) -> answer; may raise, and is then tried again.
Annotate = Callable[[str], str]


def annotate(df: DataFrame, id_col: str, text_col: str, call: Annotate, tries: int = 3, wait: float = 2.0) -> DataFrame:
    """(id, answer, error, attempts) of every row: a failing call is repeated after wait, 2 wait, 4 wait ... seconds.

    A text that is null is not asked for. The last error stays with the row, and the job goes on.
    """
    kind = dict(df.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["t"]:
                answer = error = None
                n = 0
                while text is not None and answer is None and n < tries:
                    n += 1
                    try:
                        answer, error = call(text), None
                    except Exception as e:  # of whatever kind the function raises
                        error = f"{type(e).__name__}: {e}"
                        if n < tries:
                            time.sleep(wait * 2 ** (n - 1))
                out.append((answer, error, n))
            yield pd.DataFrame({"id": frame["id"], "answer": [a for a, _, _ in out], "error": [e for _, e, _ in out], "attempts": pd.Series([n for _, _, n in out], index=frame.index, dtype="int32")})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, answer string, error string, attempts int")
    return rows.withColumnRenamed("id", id_col)


def gate(df: DataFrame, id_col: str, text_col: str, eligible: str, call: Annotate, field: str = "central", wait: float = 2.0) -> DataFrame:
    """(id, flag, reason): yes or no of a field of the answer's object; rows that are not eligible are no without being asked.

    A call that failed to the end, or an answer without an object, gives a null flag and the error.
    """
    open_ = df.where(F.coalesce(F.col(eligible), F.lit(False)))
    asked = annotate(open_, id_col, text_col, call, wait=wait)
    found = F.regexp_extract("answer", r"(?s)\{.*\}", 0)
    value = F.get_json_object(found, f"$.{field}")
    known = F.col("error").isNull() & (found != "")
    flag = F.when(known, F.coalesce(F.lower(F.trim(value)) == "yes", F.lit(False)))
    reason = F.when(known, F.coalesce(F.trim(F.get_json_object(found, "$.reason")), F.lit(""))).otherwise(F.concat(F.lit("ERROR: "), F.coalesce("error", F.lit("no object"))))
    closed = df.where(~F.coalesce(F.col(eligible), F.lit(False))).select(id_col, F.lit(False).alias("flag"), F.lit("excluded before").alias("reason"))
    return asked.select(id_col, flag.alias("flag"), reason.alias("reason")).unionByName(closed)
