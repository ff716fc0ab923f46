"""Exact byte-pair token counts by a vocabulary of the caller's: a file of base64 tokens and ranks, one a line."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Fixed value: how texts are cut before pairs are merged, for the vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def with_exact_tokens(rows: DataFrame, vocabulary: str, text: str = "text", name: str = "tokens", pattern: str = PATTERN) -> DataFrame:
    """Adds the number of tokens of each text, over the whole text; null texts have none. The vocabulary, a file of the driver's, is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks_of(vocabulary))  # a vocabulary
    schema = StructType([*rows.schema.fields, StructField(name, LongType())])

    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], schema.names)

    return rows.withColumn(text, F.col(text).cast("string")).mapInArrow(run, schema)
