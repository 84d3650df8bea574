"""Sizes of texts in tokens of a public tokenizer, read from a file whose path is a parameter.

Null texts have no size (null); empty ones have 0. A text on which the tokenizer's own splitting fails, as on very long runs
of one character, is encoded in pieces of ``PIECE`` characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the public splitting pattern of that vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 20_000


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str) -> int:
    e = encoding(path)
    try:
        return len(e.encode_ordinary(text))
    except BaseException as x:  # noqa: BLE001 - the library panics outside Exception
        if isinstance(x, KeyboardInterrupt | SystemExit | MemoryError):
            raise
        return sum(len(e.encode_ordinary(text[i : i + PIECE])) for i in range(0, len(text), PIECE))


def sizes(df: DataFrame, keep: list[str], text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep``, a hash ``text_hash`` of the text, and ``n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [None if t is None else count(t, path) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keep, "text_hash")], pa.array(n, pa.int64())], names=[*keep, "text_hash", "n_tokens"])

    rows = df.select(*keep, F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, "text_hash")) + ", n_tokens bigint"
    return rows.mapInArrow(run, schema)
