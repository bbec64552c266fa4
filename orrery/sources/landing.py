"""Landed pages as a Spark format of its own: spark.read.format("landed_pages") and spark.readStream.format("landed_pages").

An extraction run lands a folder below the source's: <folder>/<run>/<page>.json, each page a file of JSON records, one a line, and an empty _SUCCESS once the run is
whole. Runs are named so that later ones sort behind (a date and time, say). A read has a partition for each page; a stream's offset is the last whole run that it has
seen, so each run is read once, and a run that is still being written is not read before its mark is there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "landed_pages"
#: Records handed to Spark at a time.
ROWS = 4096


def _files(folder: str):
    """The file system of a folder's address, and the folder's path there."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder.rstrip("/")
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return system, path.rstrip("/")


def _runs(folder: str, marked: bool) -> list[str]:
    """Names of the runs below a folder in order, with `marked` the whole ones only."""
    from pyarrow import fs

    system, path = _files(folder)
    runs = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == fs.FileType.Directory and not x.base_name.startswith(("_", ".")))
    if not marked:
        return runs
    marks = system.get_file_info([f"{path}/{r}/_SUCCESS" for r in runs])
    return [r for r, x in zip(runs, marks, strict=True) if x.type == fs.FileType.File]


class Page(InputPartition):
    """One page of one run."""

    def __init__(self, folder: str, run: str, name: str) -> None:
        super().__init__((run, name))
        self.folder, self.run, self.name = folder, run, name


def _pages(folder: str, runs: list[str]) -> list[InputPartition]:
    from pyarrow import fs

    system, path = _files(folder)
    found = [Page(folder, run, x.base_name) for run in runs for x in sorted(system.get_file_info(fs.FileSelector(f"{path}/{run}")), key=lambda x: x.base_name) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
    # Spark reads a source without partitions as one of no value.
    return found or [InputPartition(None)]


def _records(page: InputPartition) -> Iterator:
    """Record batches (run, page, number, record) of a page, read as a stream; blank lines are no records."""
    import io

    import pyarrow as pa

    if not isinstance(page, Page):
        return
    schema = pa.schema([("run", pa.string()), ("page", pa.string()), ("number", pa.int64()), ("record", pa.string())])
    system, path = _files(page.folder)
    held: list[tuple[int, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([page.run] * len(held), pa.string()), pa.array([page.name] * len(held), pa.string()), pa.array([n for n, _ in held], pa.int64()), pa.array([r for _, r in held], pa.string())], schema=schema)

    with system.open_input_stream(f"{path}/{page.run}/{page.name}") as raw:
        for n, line in enumerate(io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="\n"), 1):
            if line.strip():
                held.append((n, line.rstrip("\r\n")))
            if len(held) == ROWS:
                yield batch()
                held = []
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, folder: str, whole: bool) -> None:
        self.folder, self.whole = folder, whole

    def partitions(self):
        return _pages(self.folder, _runs(self.folder, self.whole))

    def read(self, partition):
        return _records(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"run": ""}

    def latestOffset(self) -> dict:
        runs = _runs(self.folder, True)
        return {"run": runs[-1] if runs else ""}

    def partitions(self, start: dict, end: dict):
        return _pages(self.folder, [r for r in _runs(self.folder, True) if start["run"] < r <= end["run"]])

    def read(self, partition):
        return _records(partition)


class LandedPages(DataSource):
    """Options: path, the landing folder; whole=false reads runs without a mark too (batch reads only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "run string, page string, number long, record string"

    def _folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError(f"{FORMAT} needs a path")
        return self.options["path"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._folder(), self.options.get("whole", "true").lower() != "false")

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._folder())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(LandedPages)
