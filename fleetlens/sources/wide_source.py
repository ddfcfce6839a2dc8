"""Data source ``widecsv``: wide metric text as long rows, read once in byte ranges.

``spark.read.format("widecsv").load(path)`` gives ``ts, node, gpu_idx, gpu, value``.
Planning reads each file's header line only; files may have headers of their own.
A task takes the lines that begin inside its byte range. Filters on ``ts`` and
``gpu``, and ``value IS NOT NULL``, are pushed: a line outside the times is dropped
at its first comma, and cells of other devices are never made.

Options: ``origin`` (an instant that times in seconds count from; without it they
fail), ``alias`` (JSON object of node names), ``partitionBytes``. An empty cell is a
null value, ``0`` a reading, and a cell missing from a short line no row.
"""

from __future__ import annotations

import io
import json
import posixpath
import sys
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from fleetlens.functions import ids

SCHEMA = "ts timestamp, node string, gpu_idx int, gpu string, value double"
PARTITION_BYTES = 64 << 20
#: Most of a header line, and lines whose cells make one batch.
HEADER_BYTES = 8 << 20
BATCH_CELLS = 100_000

# workers get these modules' code with the plan, so they need not find the package
for module in (sys.modules[__name__], ids):
    cloudpickle.register_pickle_by_value(module)
parse_header_name = ids.parse_header_name


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def data_files(path: str) -> list[tuple[str, int]]:
    """Path and size of every file under ``path`` (a file, a folder, or a folder's glob); hidden ones are left out."""
    system, inner = opened(path)
    pattern = None
    if any(c in posixpath.basename(inner) for c in "*?["):
        inner, pattern = posixpath.split(inner)
    info = system.get_file_info(inner)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    keep = []
    for f in found:
        parts = f.path[len(inner) :].split("/")
        if f.is_file and f.size and not any(p.startswith(("_", ".")) for p in parts) and (not pattern or fnmatch(f.base_name, pattern)):
            keep.append((prefix + f.path if prefix else f.path, f.size))
    return sorted(keep)


class Range(ds.InputPartition):
    """A byte range of one file; ``columns`` has place, node, slot and name of the wanted device columns."""

    def __init__(self, path: str, start: int, end: int, header: bytes, columns: list) -> None:
        self.path, self.start, self.end, self.header, self.columns = path, start, end, header, columns


def instant(text: str, origin: datetime | None) -> datetime:
    """An ISO instant (UTC where no zone is named), or seconds after ``origin``."""
    try:
        seconds = float(text)
    except ValueError:
        try:
            at = datetime.fromisoformat(text)
        except ValueError:
            raise ValueError(f"unparseable timestamp: {text!r}") from None
        return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    if origin is None:
        raise ValueError("the times are relative seconds: give an origin")
    return origin + timedelta(seconds=seconds)


def _aware(value: object) -> datetime | None:
    if not isinstance(value, datetime):
        return None
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


class WideReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        lowered = {k.lower(): v for k, v in options.items()}
        self.path = lowered["path"]
        self.alias = json.loads(lowered.get("alias") or "{}")
        self.origin = instant(lowered["origin"], None) if lowered.get("origin") else None
        self.partition_bytes = int(lowered.get("partitionbytes") or PARTITION_BYTES)
        self.bounds: list[tuple[str, datetime]] = []
        self.gpus: set[str] | None = None
        self.filled = False

    def pushFilters(self, filters: list[ds.Filter]):  # noqa: N802
        """Takes bounds on ``ts``, sets of ``gpu`` and ``value IS NOT NULL``; gives back the rest."""
        names = {ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.EqualTo: "="}
        for f in filters:
            kind, column = type(f), getattr(f, "attribute", None)
            at = _aware(getattr(f, "value", None))
            if column == ("ts",) and kind in names and at is not None:
                self.bounds.append((names[kind], at))
            elif column == ("gpu",) and kind in (ds.EqualTo, ds.In):
                wanted = {f.value} if kind is ds.EqualTo else set(f.value)
                self.gpus = wanted if self.gpus is None else self.gpus & wanted
            elif column == ("value",) and kind is ds.IsNotNull:
                self.filled = True
            elif kind is not ds.IsNotNull or column not in (("ts",), ("gpu",), ("node",), ("gpu_idx",)):
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path, size in data_files(self.path):
            system, inner = opened(path)
            with system.open_input_file(inner) as f:
                head = f.read(min(size, 1 << 16))
                while b"\n" not in head and len(head) < min(size, HEADER_BYTES):
                    head += f.read(1 << 16)
            header = head.split(b"\n", 1)[0].rstrip(b"\r")
            cells = header.decode().split(",")
            if cells[0] != "Time" or len(cells) < 2:
                raise ValueError(f"not a wide time-series source, no header line (need 'Time' and at least one device column): {path}")
            columns = []
            for place, raw in enumerate(cells[1:], start=1):
                node, slot = parse_header_name(raw, self.alias)
                gpu = f"{node}#{slot}"
                if self.gpus is None or gpu in self.gpus:
                    columns.append((place, node, slot, gpu))
            if columns:
                out += [Range(path, at, min(at + self.partition_bytes, size), header, columns) for at in range(0, size, self.partition_bytes)]
        return out

    def _inside(self, at: datetime) -> bool:
        for op, bound in self.bounds:
            ok = at > bound if op == ">" else at >= bound if op == ">=" else at < bound if op == "<" else at <= bound if op == "<=" else at == bound
            if not ok:
                return False
        return True

    def lines(self, part: Range) -> Iterator[bytes]:
        """The lines that begin in the range, without their ends."""
        system, inner = opened(part.path)
        with io.BufferedReader(system.open_input_file(inner), 1 << 20) as f:
            at = part.start
            if at:  # the line that holds the byte before belongs to the range before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(0)
            while at < part.end:
                line = f.readline()
                if not line:
                    return
                at += len(line)
                yield line.rstrip(b"\r\n")

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's call where no range is left
            return
        times: list[datetime] = []
        places: list[int] = []
        values: list[float | None] = []

        def batch() -> pa.RecordBatch:
            of = pa.array(places, pa.int32())
            columns = [pa.array(times, pa.timestamp("us", "UTC"))]
            for k, kind in ((1, pa.string()), (2, pa.int32()), (3, pa.string())):
                columns.append(pa.array([c[k] for c in part.columns], kind).take(of))
            columns.append(pa.array(values, pa.float64()))
            for x in (times, places, values):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["ts", "node", "gpu_idx", "gpu", "value"])

        for line in self.lines(part):
            if not line.strip() or line == part.header:
                continue
            head, comma, rest = line.partition(b",")
            if head == b"Time":
                raise ValueError(f"a second header line differs from the first: {part.path}")
            at = instant(head.decode(), self.origin)
            if not self._inside(at):
                continue
            cells = rest.split(b",") if comma else []
            for k, (place, *_) in enumerate(part.columns):
                if place > len(cells):
                    continue
                cell = cells[place - 1]
                if cell or not self.filled:
                    times.append(at)
                    places.append(k)
                    values.append(float(cell) if cell else None)
            if len(times) >= BATCH_CELLS:
                yield batch()
        if times:
            yield batch()


class WideCsv(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "widecsv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WideReader:
        return WideReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``widecsv`` known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WideCsv)
