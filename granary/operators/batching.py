"""Requests handed to a backend in batches of one padded length."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded_length

#: A backend: a batch with the requests' keys, `ids` and `attention_mask` (lists of one length) to a batch of the same rows with what it says of them.
Backend = Callable[[pa.RecordBatch], pa.RecordBatch]


def generate_batches(requests: DataFrame, backend: Backend, answers: str, key: Sequence[str] = ("seed", "example_id"), size: int = 32, multiple: int = 8, pad: int = 0) -> DataFrame:
    """requests: the key and ids (array of int). The key, padded (int, the length to which the batch was padded) and the columns of `answers` (DDL) that the backend gives, a row a request.

    Requests are ranged by padded length and key and sorted in each task, so a task meets few lengths and a length that many requests have is dealt to many tasks; a batch holds up to `size` requests of one padded length
    and no other. Batches come and go one by one. Null ids are an empty list, which is padded to `multiple`; an empty table gives an empty result."""
    kinds = requests.select(*key).withColumn("padded", F.lit(0)).schema
    answered = requests.sparkSession.createDataFrame([], answers).schema
    schema = requests.sparkSession.createDataFrame([], kinds).schema
    for f in answered.fields:
        schema = schema.add(f)
    ids = F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>"))
    work = requests.select(*key, ids.alias("ids")).withColumn("padded", padded_length(F.greatest(F.size("ids"), F.lit(1)), multiple).cast("int"))
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    work = work.repartitionByRange(tasks, "padded", *key).sortWithinPartitions("padded", *key)
    n = len(key)

    def asked(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists, padded = rows.column(n), rows.column(n + 1)[0].as_py()
        lengths = np.array([len(x) for x in lists], np.int64)
        mask = (np.arange(padded) < lengths[:, None]).astype(np.int32)
        filled = np.full(mask.shape, pad, np.int32)
        filled[mask == 1] = np.concatenate([x.values.to_numpy() for x in lists]) if lengths.sum() else []
        wide = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel(), pa.int32()), padded).cast(pa.list_(pa.int32()))
        out = backend(pa.RecordBatch.from_arrays([*rows.columns[:n], wide(filled), wide(mask)], [*key, "ids", "attention_mask"]))
        if out.num_rows != rows.num_rows:
            raise ValueError(f"the backend gave {out.num_rows} rows for {rows.num_rows}")
        return pa.RecordBatch.from_arrays([*rows.columns[:n], rows.column(n + 1), *[out.column(f.name) for f in answered.fields]], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have, length = 0, None

        def whole() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return asked(table.to_batches()[0])

        for b in batches:
            padded = b.column(n + 1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(padded)) + 1).tolist(), b.num_rows]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                if have and padded[a] != length:
                    yield whole()
                    have = 0
                length = padded[a]
                while a < z:
                    take = min(size - have, z - a)
                    held.append(b.slice(a, take))
                    a, have = a + take, have + take
                    if have == size:
                        yield whole()
                        have = 0
        if have:
            yield whole()

    return work.mapInArrow(run, schema)
