"""Token counts of whole texts by a public byte-level tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which the public vocabulary was made.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank that may form one piece with the white space after or before it.
_JOINED = re.compile(r" \s|\s \Z")
#: Distinct words whose counts a worker remembers.
_REMEMBER = 500_000


def counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """A function that counts tokens.

    A blank before a visible character always starts a new piece, so a text without other
    blanks has the tokens of its words, which repeat and are remembered.
    """
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    words: dict[str, int] = {}

    def count(text: str) -> int:
        if _JOINED.search(text):
            return len(encode(text))
        first, *rest = text.split(" ")
        n = len(encode(first)) if first else 0
        for word in rest:
            k = words.get(word)
            if k is None:
                if len(words) > _REMEMBER:
                    words.clear()
                k = words[word] = len(encode(" " + word))
            n += k
        return n

    return count


def count_tokens(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, kept columns, ``tokens``) of every row; null and empty texts have 0 tokens."""
    types = dict(df.dtypes)
    cols = [F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t")]
    schema = ", ".join(["id " + types[id_col], *[f"k{i} {types[c]}" for i, c in enumerate(keep)], "tokens long"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for frame in frames:
            tokens = [count(t) if t else 0 for t in frame["t"]]
            yield frame.drop(columns="t").assign(tokens=pd.Series(tokens, index=frame.index, dtype="int64"))

    counted = df.select(*cols).mapInPandas(run, schema)
    return counted.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "tokens")
