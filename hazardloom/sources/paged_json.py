"""A paged JSON endpoint as a Spark data source.

A provider answers ``fetch(where, limit, offset)`` with a list of records; the first empty page
ends the data. The page count is found with a logarithmic number of probes, then the pages are
read in parallel, each partition an even stripe of them.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, replace
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

# workers receive these classes with the job and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE_SIZE = 1000
PAGES_PER_TASK = 16


class PageProvider(Protocol):
    def fetch(self, where: str | None, limit: int, offset: int) -> list[dict]: ...


@dataclass
class RecordPages:
    """Pages over a list of records; ``where`` reads ``column='value'``."""

    records: list[dict]

    def fetch(self, where: str | None, limit: int, offset: int) -> list[dict]:
        rows = self.records
        if where:
            name, value = where.split("=", 1)
            rows = [r for r in rows if str(r.get(name.strip())) == value.strip().strip("'")]
        return rows[offset : offset + limit]


@dataclass
class FolderPages:
    """Pages kept as JSON-lines files below ``<root>/filter=<value>/page=<n>/`` on shared storage.

    ``value`` is the constant of the filter ``column='value'``, or ``all`` without a filter. A root
    without a scheme belongs to the session's default file system, see :func:`read_pages`; one that
    does not exist is an error, not an empty source.
    """

    root: str
    page_size: int = PAGE_SIZE

    def fetch(self, where: str | None, limit: int, offset: int) -> list[dict]:
        if limit != self.page_size or offset % limit:
            raise ValueError("stored pages have a fixed size")
        value = where.split("=", 1)[1].strip().strip("'") if where else "all"
        system, root = _file_system(self.root)
        if system.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        folder = fs.FileSelector(f"{root}/filter={value}/page={offset // limit}", allow_not_found=True)
        names = sorted(f.path for f in system.get_file_info(folder) if f.path.endswith(".json"))
        rows: list[dict] = []
        for name in names:
            with system.open_input_stream(name) as file:
                rows.extend(json.loads(line) for line in file.read().decode("utf-8").splitlines() if line.strip())
        return rows


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def page_count(provider: PageProvider, where: str | None, size: int) -> int:
    """Number of pages before the first empty one: double the reach, then halve the gap."""

    def filled(page: int) -> bool:
        return bool(provider.fetch(where, size, page * size))

    if not filled(0):
        return 0
    low, high = 0, 1
    while filled(high):
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if filled(middle) else (low, middle)
    return high


class PageRange(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first = first
        self.stop = stop


class PagedJsonReader(DataSourceReader):
    def __init__(self, provider: PageProvider, schema, options: dict):
        self.provider = provider
        self.names = schema.fieldNames()
        self.where = options.get("where") or None
        self.size = int(options.get("page_size", PAGE_SIZE))
        self.stripes = int(options.get("partitions", 0))
        self.schema = schema

    def partitions(self):
        pages = page_count(self.provider, self.where, self.size)
        stripes = max(1, min(self.stripes or -(-pages // PAGES_PER_TASK), pages))
        edges = [pages * i // stripes for i in range(stripes + 1)]
        return [PageRange(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition):
        arrow = to_arrow_schema(self.schema)
        for page in range(partition.first, partition.stop):
            records = self.provider.fetch(self.where, self.size, page * self.size)
            columns = [pa.array([r.get(f.name) for r in records], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)


def paged_json_source(provider: PageProvider) -> type[DataSource]:
    """The data source class ``paged_json`` bound to one provider; register it with the session."""

    class PagedJsonSource(DataSource):
        @classmethod
        def name(cls):
            return "paged_json"

        def schema(self):
            return self.options["schema"]

        def reader(self, schema):
            return PagedJsonReader(provider, schema, self.options)

    return PagedJsonSource


def read_pages(
    spark: SparkSession, provider: PageProvider, schema: str, where: str | None = None, page_size: int = PAGE_SIZE,
    partitions: int | None = None,
) -> DataFrame:
    """All records the endpoint has for the filter; one task per ``PAGES_PER_TASK`` pages by default."""
    if isinstance(provider, FolderPages):
        where_it_is = spark._jvm.org.apache.hadoop.fs.Path(provider.root)
        system = where_it_is.getFileSystem(spark._jsc.hadoopConfiguration())
        provider = replace(provider, root=system.makeQualified(where_it_is).toString())
    spark.dataSource.register(paged_json_source(provider))
    reader = spark.read.format("paged_json").schema(schema).option("page_size", str(page_size))
    reader = reader.option("partitions", str(partitions or 0))
    return (reader.option("where", where) if where else reader).load()


def land_pages(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
