"""Feather (Arrow IPC) files as a Spark data source: ``spark.read.format("feather")`` and ``df.write.format("feather")``.

A table is a file or a folder of files on a path that the driver and all executors share.  Each record batch is a
partition, so a large file is read by many tasks; of a batch only the wanted columns are decoded.  A write stages its
files beside the table and puts them in place when all tasks have succeeded, so a failed one leaves the table as it was.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Rows of a record batch that is written, and so of a partition when it is read again.
BATCH_ROWS = 1 << 17

#: Filters that a batch is narrowed by before it leaves its task.
_TESTS = {
    D.EqualTo: pc.equal, D.GreaterThan: pc.greater, D.GreaterThanOrEqual: pc.greater_equal, D.LessThan: pc.less, D.LessThanOrEqual: pc.less_equal,
    D.In: lambda c, v: pc.is_in(c, pa.array(list(v), c.type)), D.IsNotNull: lambda c, _: pc.is_valid(c), D.IsNull: lambda c, _: pc.is_null(c),
}


def _local(path: str) -> str:
    return re.sub(r"^file:(//)?(?=/)", "", path)


def _files(path: str) -> list[str]:
    path = _local(path)
    if not os.path.isdir(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".feather") and f[0] not in "._")


@dataclass
class Batch(D.InputPartition):
    path: str
    number: int


@dataclass
class Written(D.WriterCommitMessage):
    path: str | None


class Reader(D.DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.tests = path, columns, []

    def partitions(self):
        out = []
        for f in _files(self.path):
            with pa.memory_map(f) as m:
                out += [Batch(f, k) for k in range(pa.ipc.open_file(m).num_record_batches)]
        return out

    def read(self, partition):
        if partition is None:  # a table without batches
            return
        wanted = [*self.columns, *[c for c, _, _ in self.tests if c not in self.columns]]
        with pa.memory_map(partition.path) as m:
            names = pa.ipc.open_file(m).schema.names
            options = pa.ipc.IpcReadOptions(included_fields=sorted(names.index(c) for c in wanted))
            batch = pa.ipc.open_file(m, options=options).get_batch(partition.number)
            keep = None
            for c, test, value in self.tests:
                one = pc.fill_null(test(batch.column(batch.schema.get_field_index(c)), value), False)
                keep = one if keep is None else pc.and_(keep, one)
            batch = batch.select(self.columns)
            yield batch if keep is None else batch.filter(keep)


class FilteringReader(Reader):
    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], _TESTS[type(f)], getattr(f, "value", None)))
            else:
                yield f


class Writer(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.schema, self.overwrite = _local(path).rstrip("/"), to_arrow_schema(schema), overwrite
        self.staged = f"{self.path}._staged-{uuid.uuid4().hex}"
        os.makedirs(self.staged)

    def write(self, iterator):
        path = f"{self.staged}/part-{uuid.uuid4().hex}.feather"
        with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, self.schema) as out:
            for batch in iterator:
                batch = pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(batch.columns, self.schema, strict=True)], schema=self.schema)
                for k in range(0, batch.num_rows, BATCH_ROWS):
                    out.write_batch(batch.slice(k, BATCH_ROWS))
        return Written(path)

    def commit(self, messages):
        """Only files of tasks that succeeded stay; they replace the table, or join it."""
        whole = {m.path for m in messages if m is not None}
        for f in _files(self.staged):
            if f not in whole:
                os.remove(f)
        if not whole:
            with pa.OSFile(f"{self.staged}/part-none.feather", "wb") as f, pa.ipc.new_file(f, self.schema):
                pass
        if self.overwrite or not os.path.exists(self.path):
            old = f"{self.path}._old-{uuid.uuid4().hex}"
            if os.path.exists(self.path):
                os.rename(self.path, old)
            os.rename(self.staged, self.path)
            shutil.rmtree(old, ignore_errors=True) if os.path.isdir(old) else os.path.exists(old) and os.remove(old)
        else:
            for f in _files(self.staged):
                os.rename(f, f"{self.path}/{os.path.basename(f)}")
            shutil.rmtree(self.staged)

    def abort(self, messages):
        shutil.rmtree(self.staged, ignore_errors=True)


class Feather(D.DataSource):
    @classmethod
    def name(cls):
        return "feather"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(_files(self.options["path"])[0]) as m:
            return from_arrow_schema(pa.ipc.open_file(m).schema)

    def reader(self, schema):
        kind = FilteringReader if self.options.get("pushdown", "false") == "true" else Reader
        return kind(self.options["path"], schema.names)

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Feather)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Feather table, or some of its columns; the others are not decoded.

    Spark pushes filters into the source where the session sets ``spark.sql.python.filterPushdown.enabled``.
    """
    register(spark)
    r = spark.read.format("feather").option("pushdown", str(spark.conf.get(PUSHDOWN, "false")).lower())
    if columns is not None:
        whole = Feather({"path": path}).schema()
        r = r.schema(StructType([whole[c] for c in columns]))
    return r.load(path)


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a Feather folder, a file a partition; ``mode`` is overwrite or append."""
    register(df.sparkSession)
    df.write.format("feather").mode(mode).save(path)
