"""What the two vector operators share: which vectors take part, and vectors as bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000


def usable(vector: Column) -> Column:
    """True for vectors that are not null, not all zero and hold only finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(rows: DataFrame) -> int:
    """The most frequent vector length; vectors of another length take no part. 0 without any."""
    row = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def sample(rows: DataFrame, dims: int, limit: int = SAMPLE) -> np.ndarray:
    """Unit vectors of the ``limit`` ids that hash lowest, to fit on; ``limit`` bounds what reaches the driver."""
    low = rows.where(F.size("vector") == dims).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "vector").limit(limit)
    got = np.array([r["vector"] for r in low.select("vector").collect()], dtype=np.float64).reshape(-1, dims)
    return got / np.linalg.norm(got, axis=1, keepdims=True)


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column as a double matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def groups(batches, keys: int):
    """(key values, Arrow table) of each run of equal keys over sorted batches; a run may span batches."""
    import pyarrow as pa

    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]).combine_chunks() if kept is not None else table
        key = np.column_stack([table.column(i).to_numpy() for i in range(keys)])
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield tuple(key[a].tolist()), table.slice(a, b - a)
        kept = table.slice(starts[-1])
    if kept is not None:
        yield tuple(kept.column(i)[0].as_py() for i in range(keys)), kept
