"""An event table in several layouts that always hold the same batches.

    root/data/batch=<id>/layout=<name>/event_date=<day>/   sorted files; layout "refused" holds refused messages
    root/commits/<id>.json                                 one small file per committed batch

A batch is one Spark job: every good row goes to each layout, every refused one to "refused", from one pass over the
source. Its commit file is put in place by a rename after the job; readers take the batches that have one, so a failure
at any moment leaves nothing half visible, in no layout. A batch that is committed already is not written again, which
makes replays of a stream harmless; leftovers of a failed attempt are overwritten. The commit log has one name per batch
and is listed by the driver, like Spark's own log of a file sink. Renames must not overwrite, as on HDFS.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import EVENT_SCHEMA
from tidelog.session import delete, prepare
from tidelog.sources.layout import (
    DEFAULT_HOT_COLUMNS, LAYOUTS, HotColumn, add_hot_columns, choose_layout, footer_rows, layout_stats, with_event_date,
)

REFUSED = "refused"
VALUE, ERROR = "value", "error"
_REFUSED_FIELDS = [T.StructField(VALUE, T.StringType()), T.StructField(ERROR, T.StringType())]


class TooManyRefused(ValueError):
    """A batch had more refused messages than allowed; nothing of it was committed."""


class EventStore:
    def __init__(self, spark: SparkSession, root: str, layouts: Iterable[str] = tuple(LAYOUTS),
                 hot: Iterable[HotColumn] = DEFAULT_HOT_COLUMNS):
        self.spark, self.root, self.layouts, self.hot = prepare(spark), root.rstrip("/"), tuple(layouts), tuple(hot)
        unknown = set(self.layouts) - set(LAYOUTS)
        if unknown or not self.layouts:
            raise ValueError(f"no such layouts: {sorted(unknown)}")

    # Commit log

    def _fs(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def batches(self) -> list[str]:
        """Committed batches, by name."""
        fs, folder = self._fs(f"{self.root}/commits")
        if not fs.exists(folder):
            return []
        names = [str(f.getPath().getName()) for f in fs.listStatus(folder)]
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def is_committed(self, batch: str) -> bool:
        fs, path = self._fs(f"{self.root}/commits/{batch}.json")
        return fs.exists(path)

    def commits(self) -> DataFrame:
        """batch, rows, refused, layouts of each commit."""
        schema = "batch string, rows bigint, refused bigint, layouts array<string>"
        if not self.batches():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/commits")

    def _commit(self, batch: str, facts: dict) -> bool:
        """False if another writer has committed this batch meanwhile."""
        fs, final = self._fs(f"{self.root}/commits/{batch}.json")
        _, draft = self._fs(f"{self.root}/commits/.{batch}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(json.dumps({"batch": batch, **facts}).encode())
        finally:
            out.close()
        if not fs.exists(final) and fs.rename(draft, final):
            return True
        fs.delete(draft, False)
        return False

    # Writing

    def placed(self, rows: DataFrame) -> DataFrame:
        """Classified rows once per layout, or once under "refused"; days come together and are sorted as their layout is.

        A row is shuffled once and copied to the layouts by the task that writes it.
        """
        wide = with_event_date(add_hot_columns(rows, self.hot))
        if ERROR not in rows.columns:
            wide = wide.withColumns({f.name: F.lit(None).cast(f.dataType) for f in _REFUSED_FIELDS})
        bad = F.col(ERROR).isNotNull()
        targets = F.when(bad, F.array(F.lit(REFUSED))).otherwise(F.array(*[F.lit(n) for n in self.layouts]))
        dealt = wide.withColumns({
            VALUE: F.when(bad, F.col(VALUE)), "event_date": F.when(~bad, F.col("event_date")),
        }).hint("rebalance", "event_date").withColumn("layout", F.explode(targets))
        keys = [F.when(F.col("layout") == n, F.col(k)) for n in self.layouts for k in LAYOUTS[n]]
        return dealt.sortWithinPartitions("layout", "event_date", *keys)

    def append(self, rows: DataFrame, batch: str | None = None, max_refused: int | None = None,
               bloom: Mapping[str, int] | None = None, rows_per_file: int | None = None) -> dict | None:
        """Write one batch to all layouts and commit it; None if the batch was committed before.

        ``rows`` are event rows; with columns value and error, those with an error are refused messages. With more than
        ``max_refused`` of them the batch is not committed and ``TooManyRefused`` is raised.
        """
        batch = batch or uuid.uuid4().hex
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch) or batch.startswith("_"):
            raise ValueError(f"not a batch name: {batch}")
        if self.is_committed(batch):
            return None
        writer = self.placed(rows).write.mode("overwrite").partitionBy("layout", "event_date").option("compression", "zstd")
        for column, distinct in (bloom or {}).items():
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
                f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(f"{self.root}/data/batch={batch}")
        written = {n: self._rows_written(batch, n) for n in (self.layouts[0], REFUSED)}
        facts = {"schema": self._columns(rows).json(), "rows": written[self.layouts[0]], "refused": written[REFUSED],
                 "layouts": list(self.layouts)}
        if max_refused is not None and facts["refused"] > max_refused:
            raise TooManyRefused(f"{facts['refused']} refused messages in batch {batch}, {max_refused} allowed")
        if not self._commit(batch, facts):
            return None
        return {n: facts[n] for n in ("rows", "refused", "layouts")}

    def _rows_written(self, batch: str, layout: str) -> int:
        """From the footers of the batch's files; a batch without such rows has no folder for them."""
        fs, path = self._fs(f"{self.root}/data/batch={batch}/layout={layout}")
        return footer_rows(self.spark, [path.toString()]) if fs.exists(path) else 0

    def sweep(self) -> list[str]:
        """Delete what uncommitted batches have left; for times without writers. Returns their names."""
        fs, folder = self._fs(f"{self.root}/data")
        committed = set(self.batches())
        there = [str(f.getPath().getName()).removeprefix("batch=") for f in fs.listStatus(folder)] if fs.exists(folder) else []
        left = sorted(set(there) - committed)
        for batch in left:
            delete(self.spark, f"{self.root}/data/batch={batch}")
        return left

    # Reading

    def paths(self, layout: str) -> list[str]:
        """Folders of the committed batches of a layout."""
        paths = []
        for batch in self.batches():
            fs, path = self._fs(f"{self.root}/data/batch={batch}/layout={layout}")
            if fs.exists(path):
                paths.append(path.toString())
        return paths

    def _read(self, layout: str, schema: T.StructType) -> DataFrame | None:
        paths = self.paths(layout)
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.root}/data").schema(schema).parquet(*paths)

    def _columns(self, rows: DataFrame) -> T.StructType:
        return with_event_date(add_hot_columns(rows.drop(VALUE, ERROR), self.hot)).schema

    def schema(self) -> T.StructType:
        """Columns of the newest batch, hot columns included; those of an event table before the first one."""
        fs, folder = self._fs(f"{self.root}/commits")
        files = [f for f in fs.listStatus(folder) if str(f.getPath().getName()).endswith(".json")] if fs.exists(folder) else []
        if not files:
            return self._columns(self.spark.createDataFrame([], EVENT_SCHEMA))
        newest = max(files, key=lambda f: f.getModificationTime()).getPath()
        text = self.spark.read.text(newest.toString(), wholetext=True).first()[0]
        return T.StructType.fromJson(json.loads(json.loads(text)["schema"]))

    def read(self, filters: Iterable[str] = ()) -> DataFrame:
        """The committed event rows, from the layout whose leading sort keys the filters cover best.

        A column that an older batch lacks is null there.
        """
        schema = self.schema()
        table = self._read(choose_layout(filters, self.layouts), schema)
        return self.spark.createDataFrame([], schema) if table is None else table.select(*schema.names)

    def stats(self) -> DataFrame:
        """Files, rows and bytes of each layout, committed batches only."""
        return layout_stats(self.spark, {n: self.paths(n) for n in self.layouts})

    def refused(self) -> DataFrame:
        """Text and reason of refused messages."""
        table = self._read(REFUSED, T.StructType(_REFUSED_FIELDS))
        return self.spark.createDataFrame([], T.StructType(_REFUSED_FIELDS)) if table is None else table.select(VALUE, ERROR)


def is_store(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/commits")
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
