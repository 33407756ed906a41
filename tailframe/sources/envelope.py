"""Price files of one series each, as a Spark data source: batch and stream reader, and a writer that commits.

A file prices_<series>_<period>.json is an envelope: fetched_at, and, as a string, a table split into
columns, index and data. Register the source once (`spark.dataSource.register(PriceEnvelope)`), then

    df.write.format("price_envelope").option("period", "3y").mode("overwrite").save(path)
    spark.read.format("price_envelope").load(path)
    spark.readStream.format("price_envelope").load(path)

Paths are those of pyarrow's file systems (a local or shared folder, hdfs://, s3://...), which executors have to
reach. Tasks write under a name of their own; the driver moves the files into place once all tasks are done, and a
failed or aborted job leaves none.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .prices import cache_name

SCHEMA = "series_id string, d date, close double, adj_close double, volume bigint, ingest_seq bigint, period string, fetched_at timestamp"
NAMED = re.compile(r"^prices_(.*)_([^_]*)\.json$")
COLUMNS = ["close", "adj_close", "volume"]


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def listed(path: str) -> list[tuple[str, str]]:
    """(version, path) of the files of a folder: a version is the time of the last change and the name, so that it
    rises and a file that is written anew comes again. A folder that isn't there has none."""
    from pyarrow import fs

    system, root = filesystem(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f"{f.mtime_ns or 0:020d}/{f.base_name}", f.path) for f in found if f.is_file and NAMED.match(f.base_name))


class FilePartition(InputPartition):
    def __init__(self, root: str, file: str):
        super().__init__(file)
        self.root, self.file = root, file


def rows_of(root: str, file: str) -> Iterator[tuple]:
    """The rows of one file; one that isn't an envelope has none."""
    system, _ = filesystem(root)
    series, period = NAMED.match(file.rsplit("/", 1)[-1]).groups()
    with system.open_input_stream(file) as stream:
        text = stream.read().decode("utf-8")
    try:
        envelope = json.loads(text)
        table = json.loads(envelope["data"])
        at = [table["columns"].index(c) if c in table["columns"] else None for c in COLUMNS]
        fetched = dt.datetime.fromisoformat(envelope["fetched_at"])
        if fetched.tzinfo is None:
            fetched = fetched.replace(tzinfo=dt.UTC)
        rows = list(zip(table["index"], table["data"], strict=True))
    except (ValueError, KeyError, TypeError):
        return
    for k, (day, values) in enumerate(rows):
        close, adjusted, volume = (values[i] if i is not None else None for i in at)
        number = lambda x: None if x is None else float(x)
        yield series, dt.date.fromisoformat(day[:10]), number(close), number(close if at[1] is None else adjusted), None if volume is None else int(volume), k, period, fetched


class BatchReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(self.path, f) for _, f in listed(self.path)]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        return rows_of(partition.root, partition.file) if partition else iter(())  # None: there is no file


class StreamReader(DataSourceStreamReader):
    """The files in order of their versions; an offset is the last version seen."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"version": ""}

    def latestOffset(self) -> dict:
        return {"version": max((v for v, _ in listed(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [FilePartition(self.path, f) for v, f in listed(self.path) if start["version"] < v <= end["version"]]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        return rows_of(partition.root, partition.file) if partition else iter(())  # None: there is no file

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (as written, its place)


class Writer(DataSourceWriter):
    """One file a series. The rows of a series have to come in one task, one after another (see write_envelopes);
    a series that comes again in the same job is refused."""

    def __init__(self, path: str, period: str, fetched_at: str | None, overwrite: bool):
        self.path, self.period, self.overwrite = path, period, overwrite
        self.fetched_at = fetched_at or dt.datetime.now(dt.UTC).isoformat()
        self.job = uuid.uuid4().hex

    def _folder(self) -> str:
        return f"_writing-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = filesystem(self.path)
        folder = f"{root}/{self._folder()}"
        system.create_dir(folder, recursive=True)
        written, seen = [], set()

        def close(series: str, days: list[str], data: list[list]) -> None:
            name = f"prices_{cache_name(series)}_{self.period}.json"
            own = f"{folder}/{uuid.uuid4().hex}.json"  # of this attempt of the task
            table = json.dumps({"columns": COLUMNS, "index": days, "data": data})
            with system.open_output_stream(own) as out:
                out.write(json.dumps({"fetched_at": self.fetched_at, "data": table}).encode("utf-8"))
            written.append((own, f"{root}/{name}"))

        last, days, data = None, [], []
        for row in iterator:
            if row["series_id"] != last:
                if last is not None:
                    close(last, days, data)
                if row["series_id"] is None or row["series_id"] in seen:
                    raise ValueError(f"the rows of {row['series_id']!r} don't come together")
                last, days, data = row["series_id"], [], []
                seen.add(last)
            days.append(f"{row['d'].isoformat()}T00:00:00.000")
            data.append([row["close"], row["adj_close"], row["volume"]])
        if last is not None:
            close(last, days, data)
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        places = [place for _, place in files]
        if len(set(places)) < len(places):
            self.abort(messages)
            raise ValueError("a series was written by two tasks, or two names are one file's")
        if self.overwrite:
            keep = set(places)
            for _, old in listed(self.path):
                if NAMED.match(old.rsplit("/", 1)[-1]).group(2) == self.period and old not in keep:
                    system.delete_file(old)
        for own, place in files:
            system.move(own, place)
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        folder = f"{root}/{self._folder()}"
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class PriceEnvelope(DataSource):
    @classmethod
    def name(cls) -> str:
        return "price_envelope"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], self.options.get("period", "3y"), self.options.get("fetched_at"), overwrite)


def write_envelopes(prices: DataFrame, path: str, period: str = "3y", fetched_at: str | None = None, mode: str = "append") -> None:
    """Writes each series' prices, in order of days, as one file; a task holds one series at a time. append
    replaces the files of the series written, overwrite also removes the period's other files."""
    from tailframe.plans.shipping import ship

    spark = prices.sparkSession
    ship(spark)
    spark.dataSource.register(PriceEnvelope)
    ready = prices.select("series_id", "d", F.col("close").cast("double").alias("close"), F.col("adj_close").cast("double").alias("adj_close"), F.col("volume").cast("bigint").alias("volume"))
    writer = ready.repartition("series_id").sortWithinPartitions("series_id", "d").write.format("price_envelope").option("period", period).mode(mode)
    if fetched_at is not None:
        writer = writer.option("fetched_at", fetched_at)
    writer.save(path)


def read_envelopes(spark, path: str, stream: bool = False) -> DataFrame:
    from tailframe.plans.shipping import ship

    ship(spark)
    spark.dataSource.register(PriceEnvelope)
    return (spark.readStream if stream else spark.read).format("price_envelope").load(path)
