"""Searches in model answers that Spark's JSON functions cannot express."""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def outermost(text: str | None) -> str | None:
    """The JSON object that ends last in a text (the outer one of nested ones); null without any."""
    decoder, best, end = json.JSONDecoder(), None, -1
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, stop = decoder.raw_decode(text, at)
        except ValueError:
            stop = -1
        if stop > end and isinstance(value, dict):
            best, end = value, stop
        # objects inside a decoded one end before it
        at = text.find("{", max(stop, at + 1))
    return None if best is None else json.dumps(best, ensure_ascii=False)


def shallowest(text: str | None, key: str) -> str | None:
    """The object under ``key`` that is nearest to the root, also through lists."""
    try:
        queue = deque([json.loads(text)])
    except (TypeError, ValueError):
        return None
    while queue:
        node = queue.popleft()
        if isinstance(node, dict):
            if isinstance(node.get(key), dict):
                return json.dumps(node[key], ensure_ascii=False)
            queue.extend(node.values())
        elif isinstance(node, list):
            queue.extend(node)
    return None


@F.pandas_udf(StringType())
def outermost_json(c: pd.Series) -> pd.Series:
    return c.map(outermost)


@F.pandas_udf(StringType())
def frames_json(c: pd.Series) -> pd.Series:
    return c.map(lambda t: shallowest(t, "frames"))


def labels_of(text: str | None, key: str = "frames") -> list[dict] | None:
    """The labels under the key nearest to the root: what is stated, the indicators in their order, and all other plain fields."""
    found = shallowest(text, key)
    if found is None:
        return None
    out = []
    for name, data in json.loads(found).items():
        data = data if isinstance(data, dict) else {}
        marks = data.get("indicators")
        pairs = list(marks.items()) if isinstance(marks, dict) else []
        extra = {k: v for k, v in data.items() if k not in ("present", "indicators") and isinstance(v, str)}
        out.append(
            {
                "frame": name,
                "stated": None if data.get("present") is None else str(data["present"]),
                "marks": [{"question": q, "answer": str(a)} for q, a in pairs],
                "indicators": json.dumps(marks, ensure_ascii=False) if marks else None,
                "extra": extra,
            }
        )
    return out


_MARKS = ArrayType(StructType().add("question", StringType()).add("answer", StringType()))
_LABEL = StructType().add("frame", StringType()).add("stated", StringType()).add("marks", _MARKS).add("indicators", StringType()).add("extra", MapType(StringType(), StringType()))


@F.pandas_udf(ArrayType(_LABEL))
def labels_list(c: pd.Series) -> pd.Series:
    return c.map(labels_of)


def script_payload(html: str | None, name: str = "DATA") -> str | None:
    """The object literal assigned to a constant in the last script of a page, by counting braces outside strings."""
    if not html or (start := html.rfind("<script")) < 0 or (at := html.find(f"const {name} = {{", start)) < 0:
        return None
    at = first = html.index("{", at)
    depth, quote = 0, ""
    while at < len(html):
        c = html[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return html[first : at + 1]
        at += 1
    return None


@F.pandas_udf(StringType())
def html_payload(c: pd.Series) -> pd.Series:
    return c.map(script_payload)
