"""Token counts of texts by a public tokenizer, inside Arrow partitions."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str = VOCABULARY):
    """The byte-level BPE of the rank file at ``path``; texts are encoded whole, special strings as text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text_column: str = "text", path: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all other columns by default) and ``n_tokens``; NULL texts have 0 tokens.

    The texts go to Python once and don't come back.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text_column]
    inner = df.select(*keep, F.col(text_column).alias("__text"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            counts = pa.array([len(encode.encode_ordinary(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, "n_tokens"])

    return inner.mapInArrow(run, schema)
