"""Sizes of texts in tokens of a public tokenizer.

The vocabulary files are read where they lie (``vocabulary``, a parameter); nothing of them is stored here. Each Python
worker loads the file once. Cases: a null or empty text has 0 tokens; texts are measured whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from colligo.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the byte-level BPE family (fixed value of that public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, vocabulary: str = VOCABULARY) -> int:
    return len(encoding(vocabulary).encode_ordinary(text)) if text else 0


def token_sizes(records: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens bigint``; the text itself goes no further."""
    fields = [f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return spread(records.select(*keep, text), records).mapInArrow(run, ", ".join([*fields, "n_tokens bigint"]))
