"""What the operators on embeddings share: which rows take part, shards of a table, blocks of a query set."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a query set that are held by every task at a time; a larger set is taken block by block.
BLOCK_ROWS = 1 << 16


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite."""
    lost = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~lost, F.lit(False))


def fixed_point(vector: Column, scale: int = 256) -> Column:
    """Each component times `scale`, rounded down, as long; null where one does not fit a long."""
    big = F.transform(vector.cast("array<double>"), lambda x: x * scale)
    fits = F.forall(big, lambda x: (x >= -9.2e18) & (x <= 9.2e18))
    return F.when(fits, F.transform(big, lambda x: F.floor(x).cast("long")))


def matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """A list column, all of whose lists have `dim` values, as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def shard_count(rows: int, shard_rows: int) -> int:
    """Partitions dealt by hash, so that hardly one holds more than `shard_rows`."""
    return max(1, math.ceil(rows / (0.8 * shard_rows)))


def shards(batches: Iterator[pa.RecordBatch], vector: str, rows: int) -> Iterator[tuple[int, pa.Table]]:
    """(dimension, up to `rows` rows) of a partition. Vectors of different lengths never share a shard."""
    held: dict[int, list[pa.Table]] = {}
    for batch in batches:
        t = pa.Table.from_batches([batch])
        dims = np.diff(batch.column(vector).offsets.to_numpy())
        for d in np.unique(dims).tolist():
            held.setdefault(d, []).append(t.filter(pa.array(dims == d)))
            if sum(map(len, held[d])) >= rows:
                whole = pa.concat_tables(held[d])
                yield d, whole.slice(0, rows)
                held[d] = [whole.slice(rows)] if len(whole) > rows else []
    for d, parts in held.items():
        if parts:
            yield d, pa.concat_tables(parts)


def blocks(queries: DataFrame, key: str, most: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """A query set in parts of about `most` rows by the hash of its key. The set must be a saved table: each part reads it once."""
    n = math.ceil(queries.count() / most)
    for k in range(n):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else queries
        t = part.toArrow()
        if len(t):
            yield t
