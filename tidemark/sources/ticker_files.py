"""One price file per ticker as a Spark data source.

The ticker is the file's name, or, where Spark wrote the files, that of the folder ``ticker=...``. The source lists the
files with their sizes, puts small ones together into partitions of about ``target_bytes``, and takes filters on ``ticker``
itself: files of other tickers are never opened. It delivers text; Spark's own functions read dates and numbers, so values
are those of the other scans. No row is lost: what cannot be read is NULL, and ``problem`` names the first such column.

Files are opened by pyarrow, so any path it knows works (``s3://``, ``hdfs://``, local). A file is read as a stream.

The source writes such files, too: tasks put them in their place themselves, so nothing is left to move for the driver, whose
work would grow with the tickers.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    WriterCommitMessage)

from tidemark import schemas
from tidemark.functions.numeric import to_number
from tidemark.sources.tables import PRICE_FILE_COLUMNS, utc_date

NAME = "ticker_files"
TARGET_BYTES = 32 << 20
ROWS_AT_ONCE = 8192
NO_TICKER = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for NULL and the empty string
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_FOLDER = re.compile(r"(?:^|/)ticker=([^/]+)/[^/]*$")


def ticker_of(path: str) -> str:
    """Ticker of a file, as scans write it."""
    folder = _FOLDER.search(path)
    name = unquote(folder[1]) if folder else path.rsplit("/", 1)[-1].removesuffix(".csv")
    return name.strip(" ").upper()


@dataclass
class Files(InputPartition):
    """Some files, each with its ticker."""

    files: list[tuple[str, str]]


class TickerFilesReader(DataSourceReader):
    def __init__(self, path: str, target_bytes: int):
        self.path, self.target_bytes = path, target_bytes
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and membership of ``ticker`` choose files; the rest goes back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ticker",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files in the order of their names, as many to a partition as ``target_bytes`` holds; at least one partition."""
        system, root = open_path(self.path)
        infos = system.get_file_info(pafs.FileSelector(root, recursive=True))
        found = sorted((i.path, i.size or 0) for i in infos if i.type == pafs.FileType.File and i.path.endswith(".csv"))
        out, held = [Files([])], 0
        for path, size in found:
            ticker = ticker_of(path[len(root):])
            if self.wanted is not None and ticker not in self.wanted:
                continue
            if out[-1].files and held + size > self.target_bytes:
                out.append(Files([]))
                held = 0
            out[-1].files.append((ticker, path))
            held += size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_path(self.path)
        names = list(PRICE_FILE_COLUMNS)
        schema = pa.schema([("ticker", pa.string()), ("row", pa.int64()), ("n_fields", pa.int32()), ("n_columns", pa.int32()),
                            *[(n, pa.string()) for n in names]])
        for ticker, path in partition.files:
            with system.open_input_stream(path) as raw, io.TextIOWrapper(io.BufferedReader(raw), "utf-8", errors="replace", newline="") as f:
                lines = csv.reader(f)
                header = [h.strip() for h in next(lines, [])]
                at = [header.index(n) if n in header else None for n in names]
                rows: list[tuple] = []
                for number, line in enumerate((x for x in lines if x), 1):
                    rows.append((ticker, number, len(line), len(header),
                                 *[line[i] or None if i is not None and i < len(line) else None for i in at]))
                    if len(rows) == ROWS_AT_ONCE:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)


def folder_of(ticker: str | None) -> str:
    """Folder of a ticker, with the characters escaped that Spark escapes, too."""
    return f"ticker={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', ticker) if ticker else NO_TICKER}"


class TickerFilesWriter(DataSourceArrowWriter):
    """Rows (ticker, line) as one file per ticker and task; those of a ticker come one after another.

    A file has the task's number in its name and gets it once it is whole: a task that runs again replaces it by the same
    file. A run that fails deletes the folder, which must not have been there before.
    """

    def __init__(self, path: str, header: str):
        self.path, self.header = path, header
        system, root = open_path(path)
        if system.get_file_info(root).type != pafs.FileType.NotFound:
            raise ValueError(f"{path} is there already")
        system.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = open_path(self.path)
        task = TaskContext.get().partitionId()
        rows = (row for batch in iterator for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for ticker, lines in itertools.groupby(rows, lambda row: row[0] or None):
            folder = f"{root}/{folder_of(ticker)}"
            system.create_dir(folder, recursive=True)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(f"{self.header}\n".encode())
                while some := list(itertools.islice(lines, ROWS_AT_ONCE)):
                    f.write("".join([f"{line}\n" for _, line in some]).encode())
            system.move(part, f"{folder}/bars-{task:05d}.csv")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = open_path(self.path)
        system.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = open_path(self.path)
        system.delete_dir(root)


class TickerFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "ticker string, row bigint, n_fields int, n_columns int, " + ", ".join(
            f"`{n}` string" for n in PRICE_FILE_COLUMNS)

    def reader(self, schema) -> TickerFilesReader:
        return TickerFilesReader(self.options["path"], int(self.options.get("target_bytes", TARGET_BYTES)))

    def writer(self, schema, overwrite: bool) -> TickerFilesWriter:
        return TickerFilesWriter(self.options["path"], ",".join(PRICE_FILE_COLUMNS))


def price_rows(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Every line of every file: the columns of bars, ``row`` (from 1, in its file) and ``problem``, NULL for a good row.

    ``problem`` is ``columns`` for a line with another number of fields than the header, else the first column whose text
    is there but unreadable; a missing date is unreadable, too. Blank lines are no rows; an empty file has none.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TickerFiles)
    rows = spark.read.format(NAME).option("target_bytes", target_bytes).load(path)
    numbers = {c: n for c, n in PRICE_FILE_COLUMNS.items() if c != "Date"}
    read = {c: F.col(c).try_cast("double") for c in numbers}  # "nan" is read, and becomes NULL below
    bad = F.when(F.col("n_fields") != F.col("n_columns"), "columns").when(utc_date("Date").isNull(), "date")
    for c, n in numbers.items():
        bad = bad.when(F.col(c).isNotNull() & read[c].isNull(), n)
    named = rows.select("ticker", utc_date("Date").alias("date"), *[to_number(c).alias(n) for c, n in numbers.items()],
                        "row", bad.alias("problem"))
    types = {f.name: f.dataType for f in schemas.BARS.fields}
    return named.select(*[F.col(n).try_cast(t).alias(n) if n != "ticker" else F.col(n) for n, t in types.items()], "row", "problem")


def bars_of(rows: DataFrame) -> DataFrame:
    """Bars from ``price_rows``: those with a date; a number that cannot be read is NULL in its row."""
    return rows.where(F.col("date").isNotNull()).select(schemas.BARS.fieldNames())


def file_report(rows: DataFrame) -> DataFrame:
    """Per ticker: lines, lines with a problem, lines without a date, and the first line with a problem."""
    return rows.groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.count("problem").alias("n_problems"), F.count_if(F.col("date").isNull()).alias("n_undated"),
        F.min(F.when(F.col("problem").isNotNull(), F.col("row"))).alias("first_problem"))


def write_ticker_files(bars: DataFrame, path: str, dealt: bool = False) -> None:
    """Bars as one csv per ticker, below ``ticker=...``, in the columns that the source reads. ``dealt`` says that ``bars`` come from a
    repartition by ticker, and spares another one."""
    bars.sparkSession.dataSource.register(TickerFiles)
    named = bars.select("ticker", *[F.col(n).cast("string").alias(c) for c, n in PRICE_FILE_COLUMNS.items()])
    rows = named if dealt else named.repartition("ticker")
    line = F.to_csv(F.struct(*PRICE_FILE_COLUMNS), {"emptyValue": ""})
    (rows.sortWithinPartitions("ticker", "Date").select("ticker", line.alias("line"))
     .write.format(NAME).mode("append").save(path))
