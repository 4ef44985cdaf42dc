"""Places in a total order, and greedy chains along it, over sorted partitions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksift.session import cut, ship, unused


def placed(rows: DataFrame, *by: str, into: str = "at") -> DataFrame:
    """rows with their place (from 0) in the order of `by`, which must tell all rows apart.

    Rows are dealt out by ranges of the order and numbered within each; only the ranges' sizes come to the driver.
    """
    part = unused(rows, "_part")
    ranged = cut(rows.repartitionByRange(*by).withColumn(part, F.spark_partition_id()), "order")
    before, total = {}, 0
    for r in ranged.groupBy(part).count().orderBy(part).collect():
        before[r[0]], total = total, total + r[1]
    if not before:
        return ranged.drop(part).withColumn(into, F.lit(None).cast("long"))
    offset = F.from_json(F.lit(json.dumps(before)), "map<string,long>")[F.col(part).cast("string")]
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*by)) - 1
    return ranged.withColumn(into, offset + nth).drop(part)


def chained(rows: DataFrame, keys: list[str], at: str, micros: str, span_s: float, breaks: Column | None = None, into: str = "started") -> DataFrame:
    """rows with the time (micros) at which their chain started: a row starts one where `breaks` says so, or span_s or more after its key's last start.

    at orders a key's rows. They pass through a task as a sorted stream: its memory doesn't grow with the key.
    """
    ship(rows.sparkSession)
    flag = unused(rows, "_breaks")
    own = rows.withColumn(flag, F.coalesce(breaks, F.lit(False)) if breaks is not None else F.lit(False)).repartition(*keys).sortWithinPartitions(*keys, at)
    span = int(span_s * 1_000_000)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = None, 0
        for b in batches:
            starts = []
            names = zip(*(b.column(k).to_pylist() for k in keys), strict=True)
            for key, t, new in zip(names, b.column(micros).to_pylist(), b.column(flag).to_pylist(), strict=True):
                if key != last or new or t - start >= span:
                    last, start = key, t
                starts.append(start)
            keep = [i for i, n in enumerate(b.schema.names) if n != flag]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(starts, pa.int64())], names=[b.schema.names[i] for i in keep] + [into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return own.mapInArrow(walk, f"{fields}, `{into}` long")


def limited(requests: DataFrame, key: str, at: str, micros: str, limit: int, span_s: float = 60) -> DataFrame:
    """requests with allowed and retry_after (whole seconds, one at least; null if allowed): `limit` a window, which a key's first request after the last window opens."""
    own = chained(requests, [key], at, micros, span_s)
    nth = F.row_number().over(Window.partitionBy(key, "started").orderBy(at))
    wait = F.greatest(F.ceil((F.col("started") + F.lit(int(span_s * 1_000_000)) - F.col(micros)) / 1_000_000), F.lit(1)).cast("int")
    return own.withColumn("allowed", nth <= limit).withColumn("retry_after", F.when(~F.col("allowed"), wait)).drop("started")
