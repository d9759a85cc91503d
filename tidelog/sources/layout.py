"""Physical layouts of the event table.

A layout is a set of Parquet files partitioned by day. Within a day, rows are
range-partitioned and sorted on the layout's key, so the min/max statistics of
files and row groups let a scan skip most of a day. Ranges are cut on the full
key down to the event time: a user or type that fills a third of a day spreads
over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.attributes import lookup_attribute
from tidelog.functions.numbers import int_or_zero
from tidelog.session import materialize, prepare


@dataclass(frozen=True)
class HotColumn:
    """A stored column derived from an attribute.

    ``expression`` is Spark SQL; without it the attribute's text is stored, or
    its whole number (0 if it is none) when ``type`` is ``int``.
    """

    name: str
    source_key: str
    type: str = "string"
    expression: str | None = None

    def column(self) -> Column:
        if self.expression and self.expression.strip():
            return F.expr(self.expression).cast(self.type)
        text = lookup_attribute(self.source_key)
        return int_or_zero(text) if self.type == "int" else text.cast(self.type)

    def described(self) -> str:
        if self.expression and self.expression.strip():
            return self.expression
        return f"attrs['{self.source_key}']"


DEFAULT_HOT_COLUMNS = (
    HotColumn("attr_lang", "lang"),
    HotColumn("attr_source", "source"),
    HotColumn("attr_score", "moderation_score", "int"),
)

# Sort keys of the two layouts.
LAYOUTS = {
    "by_user": ("user_id", "record_type", "event_time"),
    "by_type": ("record_type", "event_time", "user_id"),
}


def with_event_date(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("event_time"))


def add_hot_columns(df: DataFrame, specs: Iterable[HotColumn] = DEFAULT_HOT_COLUMNS) -> DataFrame:
    return df.withColumns({s.name: s.column() for s in specs if s.name not in df.columns})


def write_events(df: DataFrame, path: str, layout: str = "by_user", hot: Iterable[HotColumn] = DEFAULT_HOT_COLUMNS,
                 tasks: int | None = None, bloom: Mapping[str, int] | None = None, mode: str = "append",
                 rows_per_file: int | None = None) -> None:
    """Write a day-partitioned, sorted copy of event rows.

    ``tasks`` sets the number of ranges (default: the session's shuffle
    partitions); aim at some hundred megabytes each. ``bloom`` maps columns to
    the expected number of distinct values per file.
    """
    keys = ("event_date",) + LAYOUTS[layout]
    rows = with_event_date(add_hot_columns(df, hot))
    ranged = rows.repartitionByRange(tasks, *keys) if tasks else rows.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).write.mode(mode).partitionBy("event_date").option(
        "compression", "zstd")
    for column, distinct in (bloom or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def write_layouts(df: DataFrame, root: str, layouts: Iterable[str] = tuple(LAYOUTS), **options) -> dict[str, str]:
    """Write ``df`` to every layout; appended to, each of them holds the same rows.

    The batch is written to scratch once and all layouts are written from that, so that they agree even where ``df``
    would not give the same rows twice.
    """
    paths = {name: f"{root}/{name}" for name in layouts}
    batch = materialize(df, "batch") if len(paths) > 1 else df
    for name, path in paths.items():
        write_events(batch, path, name, **options)
    return paths


def choose_layout(filters: Iterable[str], available: Iterable[str] = tuple(LAYOUTS)) -> str:
    """The layout whose leading sort keys the filters cover best; the base layout on a tie."""
    asked, names = {f.lower() for f in filters}, list(available)

    def covered(name: str) -> int:
        depth = 0
        for key in LAYOUTS[name]:
            if key not in asked:
                break
            depth += 1
        return depth

    return max(names, key=lambda n: (covered(n), -names.index(n)))


def read_layout(spark: SparkSession, paths: Mapping[str, str], filters: Iterable[str]) -> DataFrame:
    return prepare(spark).read.parquet(paths[choose_layout(filters, paths)])


def hot_columns_status(df: DataFrame, specs: Iterable[HotColumn] = DEFAULT_HOT_COLUMNS) -> DataFrame:
    """Which hot columns the table has."""
    rows = [(s.name, s.source_key, s.type, s.described(), s.name in df.columns) for s in specs]
    return df.sparkSession.createDataFrame(
        rows, "name string, sourceKey string, type string, expression string, exists boolean")


def apply_hot_columns(spark: SparkSession, path: str, target: str,
                      specs: Iterable[HotColumn] = DEFAULT_HOT_COLUMNS) -> dict:
    """Write ``path`` with its missing hot columns to ``target``.

    Files are immutable, so the table is rewritten next to the old one, which
    readers keep until they switch. The copy needs no shuffle. A column whose
    expression does not resolve is reported and left out.
    """
    table = prepare(spark).read.parquet(path)
    created, skipped, errors, wider = [], [], [], table
    for spec in specs:
        if spec.name in table.columns:
            skipped.append(spec.name)
            continue
        try:
            wider = wider.withColumn(spec.name, spec.column())
            wider.schema  # resolve now, so that a bad expression is caught here
            created.append(spec.name)
        except PySparkException as problem:
            errors.append(f"{spec.name}: {problem.getMessage() or problem}")
    if created:
        writer = wider.write.option("compression", "zstd")
        if "event_date" in table.columns:
            writer = writer.partitionBy("event_date")
        writer.parquet(target)
    return {"created": created, "skipped": skipped, "errors": errors, "path": target if created else path}


def footer_rows(spark: SparkSession, paths: list[str]) -> int:
    """Rows of Parquet files from their footers: the count is pushed to the scan, which gives one row per file.

    Runs in a session of its own, since the push-down is a setting of the session.
    """
    own = spark.newSession()
    sources = spark.conf.get("spark.sql.sources.useV1SourceList", "").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in sources if s.strip() not in ("parquet", "")))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return footer_count(own, paths).first()[0]


def footer_count(own: SparkSession, paths: list[str]) -> DataFrame:
    return own.read.option("recursiveFileLookup", "true").parquet(*paths).agg(F.count("*").alias("rows"))


def file_stats(spark: SparkSession, *paths: str) -> DataFrame:
    """Files, rows and bytes of a table in one or more folders.

    Files and bytes come from the listing, rows from the footers; both are read by tasks, a row per file, and no row of the
    table is. An empty or missing folder counts as no file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").option("ignoreMissingFiles", "true")
    found = listed.load(list(paths)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).first() if paths else None
    rows = footer_rows(spark, list(paths)) if found and found["files"] else 0
    size = found["bytes"] or 0 if found else 0
    return spark.createDataFrame(
        [(found["files"] if found else 0, rows, size, size / max(rows, 1))], "files bigint, rows bigint, bytes bigint, bytes_per_row double")


def layout_stats(spark: SparkSession, paths: Mapping[str, str | list[str]]) -> DataFrame:
    """``file_stats`` of several layouts, one row each; a layout may lie in several folders."""
    out = None
    for name, path in paths.items():
        folders = [path] if isinstance(path, str) else path
        stats = file_stats(spark, *folders).select(F.lit(name).alias("layout"), "*")
        out = stats if out is None else out.unionByName(stats)
    if out is None:
        raise ValueError("no layout given")
    return out
