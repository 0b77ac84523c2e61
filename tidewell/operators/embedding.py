"""Vectors for texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import constants as K
from tidewell.functions.text import terms

Provider = Callable[[list[str]], list[list[float]]]


def embed_chunks(
    df: DataFrame,
    provider: Provider | None = None,
    text: str = "content",
    out: str = "embedding",
    dim: int = 768,
    batch: int = K.EMBEDDING_BATCH,
) -> DataFrame:
    """Add `out`, array<float>. Without a provider: hashed term counts at unit length.

    A provider gets lists of up to `batch` texts and returns their vectors in order. It
    runs inside tasks, so its own limits bound the number of tasks, not the batch.
    """
    if provider is None:
        return _hashed(df, text, out, dim)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    vector = pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = provider(part.column(text).to_pylist())
                column = pa.array(vectors, type=vector)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, column], names=[*part.schema.names, out]
                )

    return df.mapInArrow(run, schema)


def _hashed(df: DataFrame, text: str, out: str, dim: int) -> DataFrame:
    listed = df.withColumn("_terms", F.coalesce(terms(F.col(text)), F.array().cast("array<string>")))
    counted = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dim).transform(listed)
    scaled = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return scaled.withColumn(out, vector_to_array("_unit", "float32")).drop("_terms", "_tf", "_unit")
