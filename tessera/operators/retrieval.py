"""Vector retrieval over arrays of floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: Queries compared in one block: what the driver reads and each task holds beside its rows.
BLOCK = 2_000


def _matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the right size and of some length, scaled to length 1; their places)."""
    values = [v.as_py() for v in column]
    at = [k for k, v in enumerate(values) if v is not None and len(v) == dim and None not in v]
    m = np.array([values[k] for k in at], float).reshape(len(at), dim)
    length = np.sqrt((m * m).sum(1))
    some = length > 0
    return m[some] / length[some, None], np.array(at, int)[some]


def _best(ids: np.ndarray, unit: np.ndarray, k: int, places: int | None):
    """The best k of a task's rows for each query, kept batch by batch."""

    def run(batches):
        kept_id = np.zeros((len(ids), 0), np.int64)
        kept = np.zeros((len(ids), 0))
        for batch in batches:
            m, at = _matrix(batch.column("vector"), unit.shape[1])
            own = batch.column("vec_id").to_numpy(zero_copy_only=False)[at]
            value = unit @ m.T
            value = np.round(value, places) if places is not None else value
            value[ids[:, None] == own[None, :]] = -np.inf
            value = np.concatenate([kept, value], 1)
            every = np.concatenate([kept_id, np.broadcast_to(own, (len(ids), len(own)))], 1)
            order = np.lexsort((every, -value), axis=1)[:, :k]
            kept, kept_id = np.take_along_axis(value, order, 1), np.take_along_axis(every, order, 1)
        use = np.isfinite(kept)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, use.sum(1))), pa.array(kept_id[use]), pa.array(kept[use])], ["query_id", "vec_id", "similarity"])

    return run


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", places: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity): the k most similar rows of each query, ties by id, itself left out.

    Queries are a stated set and run in blocks. A task keeps the best k of its
    rows, and only these meet. Null vectors, those of another size and those
    without length are similar to nothing.
    """
    spark = rows.sparkSession
    own = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).alias("vector")).where("query_id is not null and vector is not null")
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id is not null")
    schema = "query_id long, vec_id long, similarity double"
    blocks = max(1, -(-own.count() // BLOCK))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        column = part.column("vector").combine_chunks()
        unit, at = _matrix(column, len(column[0]))
        out = out.unionByName(base.mapInArrow(_best(part.column("query_id").to_numpy()[at], unit, k, places), schema))
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
