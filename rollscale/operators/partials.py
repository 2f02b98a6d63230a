"""Vectors per group from rows that stay where they are: the accumulators of Python kernels.

A task answers for the rows it holds with one vector per group; vectors of a group are then joined
in a fixed order, so the result does not depend on the order in which tasks finish.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import ship_package

#: Numbers that a task holds before it sends its vectors on.
HELD = 4_000_000
VECTOR = "key bigint, task int, part int, vector array<double>"
RESULT = "key bigint, vector array<double>"


def lists(vectors) -> pa.Array:
    """Vectors of any lengths as one Arrow column."""
    offsets = np.cumsum([0, *map(len, vectors)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(vectors)))


def vectors_by_key(rows: DataFrame, key: str, part, combine=np.add, finish=None) -> DataFrame:
    """(key, vector) of every group of the bigint column `key`.

    part(batch, present, number) gives a vector (or None) for each key in `present`, the sorted keys
    of an Arrow batch, `number` being the index in it of every row; `combine` joins two vectors of
    a group and finish(key, vector) runs on the joined one, still in a task.
    """
    ship_package(rows.sparkSession)

    def record(held, number):
        return pa.record_batch(
            {
                "key": pa.array(list(held), pa.int64()),
                "task": pa.array(np.full(len(held), TaskContext.get().partitionId()), pa.int32()),
                "part": pa.array(np.full(len(held), number), pa.int32()),
                "vector": lists(list(held.values())),
            }
        )

    def answer(batches):
        held, size, number = {}, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            present, at = np.unique(batch.column(key).to_numpy(), return_inverse=True)
            for name, vector in zip(present.tolist(), part(batch, present, at), strict=True):
                if vector is None:
                    continue
                if name in held:
                    held[name] = combine(held[name], vector)
                else:
                    held[name] = vector
                    size += len(vector)
            if size > HELD:
                yield record(held, number)
                held, size, number = {}, 0, number + 1
        if held:
            yield record(held, number)

    def join(table: pa.Table) -> pa.Table:
        name = table.column("key")[0].as_py()
        vectors = table.column("vector").combine_chunks()
        total = None
        for i in np.lexsort((table.column("part").to_numpy(), table.column("task").to_numpy())):
            vector = vectors[int(i)].values.to_numpy()
            total = vector if total is None else combine(total, vector)
        if finish is not None:
            total = finish(name, total)
        return pa.table({"key": pa.array([name], pa.int64()), "vector": lists([total])})

    return rows.mapInArrow(answer, VECTOR).groupBy("key").applyInArrow(join, RESULT)
