"""Chain CSV trees as a Spark data source (A09, X04): `spark.read.format("chain_csv").load(root)`.

A tree holds a file per symbol and day, nested (SPY/2024-01-15.csv) or flat (SPY_20240115.csv). Symbol and day come from the
path, so filters on them are pushed down and decide which files are opened at all; every file is a partition of its own.
Files are listed and read through the file system of the root's URI, which on a cluster is the shared one.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)
from pyspark.sql.types import DateType, StringType, StructField, StructType

NAME = "chain_csv"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_NESTED = re.compile(r"([^/]+)/(\d{4}-\d{2}-\d{2})\.csv$")
_FLAT = re.compile(r"(?:^|/)([^/_]+)_(\d{8})\.csv$")


@dataclass
class ChainFile(InputPartition):
    path: str
    symbol: str
    day: dt.date

    def __post_init__(self):
        super().__init__(self.path)


def _system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; `file:/x` and plain paths are local or mounted ones."""
    plain = re.sub(r"^file:(?://(?=/))?(?=/)", "", root)
    return (fs.LocalFileSystem(), plain) if "://" not in plain else fs.FileSystem.from_uri(plain)


def _named(path: str, layout: str) -> ChainFile | None:
    """The file's symbol and day, or None for a file that is not named like one of the tree."""
    flat, nested = (_FLAT.search(path) if layout != "nested" else None), (_NESTED.search(path) if layout != "flat" else None)
    try:
        if flat:
            return ChainFile(path, flat[1], dt.datetime.strptime(flat[2], "%Y%m%d").date())
        return ChainFile(path, nested[1], dt.date.fromisoformat(nested[2])) if nested else None
    except ValueError:
        return None


class ChainReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.root, self.layout = options["path"], options.get("layout", "auto")
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what it can decide from a path and hands the rest back."""
        for f in filters:
            mine = isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("symbol",), ("quote_date",))
            if mine:
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, file: ChainFile) -> bool:
        for f in self.tests:
            x = file.symbol if f.attribute == ("symbol",) else file.day
            y = f.value
            ok = (x in y if isinstance(f, In) else x == y if isinstance(f, EqualTo) else x > y if isinstance(f, GreaterThan) else x >= y if isinstance(f, GreaterThanOrEqual)
                  else x < y if isinstance(f, LessThan) else x <= y)
            if not ok:
                return False
        return True

    def partitions(self) -> list[ChainFile]:
        system, path = _system(self.root)
        found = (_named(i.path, self.layout) for i in system.get_file_info(fs.FileSelector(path, recursive=self.layout != "flat")) if i.type == fs.FileType.File)
        files = [f for f in found if f is not None and self._wanted(f)]
        return files or [ChainFile("", "", dt.date.min)]  # Spark wants one

    def read(self, partition: ChainFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _system(self.root)[0].open_input_stream(partition.path) as stream:
            table = _as_text(stream)
        own = {name.lower(): column for name, column in zip(table.column_names, table.columns)}
        own |= {"symbol": pa.repeat(partition.symbol, table.num_rows), "quote_date": pa.repeat(pa.scalar(partition.day, pa.date32()), table.num_rows)}
        columns = [own.get(n.lower(), pa.nulls(table.num_rows, pa.string())) for n in self.names]
        yield from pa.table(columns, names=self.names).to_batches()


def _as_text(stream) -> pa.Table:
    """All values as text, empty ones null; a file without any line has no columns."""
    head, data = None, stream.read()
    if data.strip():
        head = data.split(b"\n", 1)[0].decode().strip().split(",")
    if not head:
        return pa.table({})
    kinds = {name.strip('"'): pa.string() for name in head}
    return pc.read_csv(pa.BufferReader(data), convert_options=pc.ConvertOptions(column_types=kinds, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True))


class ChainCsv(DataSource):
    """Options: `path`, `layout` (`nested`, `flat` or `auto`). Without a schema the columns are those of the first file, as text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        reader = ChainReader(StructType(), self.options)
        first = reader.partitions()[0]
        names: list[str] = []
        if first.path:
            with _system(reader.root)[0].open_input_stream(first.path) as stream:
                names = [n.lower() for n in _as_text(stream).column_names]
        text = [StructField(n, StringType()) for n in names if n not in ("symbol", "quote_date", "date")]
        return StructType([StructField("symbol", StringType()), StructField("quote_date", DateType()), *text])

    def reader(self, schema: StructType) -> ChainReader:
        return ChainReader(schema, self.options)


def read_chain_tree(spark: SparkSession, root: str, layout: str = "auto", schema: StructType | str | None = None) -> DataFrame:
    """The tree as a table of text columns with `symbol` and `quote_date`, to be typed by `standardize_chain`. Filters on
    symbol and day decide which files are opened."""
    spark.dataSource.register(ChainCsv)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format(NAME).option("layout", layout)
    return (reader.schema(schema) if schema is not None else reader).load(root)


def write_chain_tree(chain: DataFrame, root: str, layout: str = "nested") -> DataFrame:
    """A file per symbol and day below `root`, written by the tasks that hold them; returns (symbol, quote_date, rows) once the
    result is read. A day of a symbol is a bounded group; a task that runs again writes the same files again."""

    def save(key, rows: pd.DataFrame) -> pd.DataFrame:
        symbol, day = key
        system, base = _system(root)
        path = f"{base}/{symbol}/{day:%Y-%m-%d}.csv" if layout == "nested" else f"{base}/{symbol}_{day:%Y%m%d}.csv"
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(rows.drop(columns=["symbol", "quote_date"]).to_csv(index=False).encode())
        return pd.DataFrame({"symbol": [symbol], "quote_date": [day], "rows": [len(rows)]})

    return chain.withColumn("quote_date", F.col("quote_date").cast("date")).groupBy("symbol", "quote_date").applyInPandas(save, "symbol string, quote_date date, rows bigint")
