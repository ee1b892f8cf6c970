"""``file_catalogue``: a distributed listing of regular files, bodies unopened.

Spark's own file sources skip empty and hidden files; a catalogue must not.
"""

from __future__ import annotations

import operator
import sys
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

SCHEMA = "path string, relative_path string, name string, size_bytes bigint, modified_at timestamp"
ARROW_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("relative_path", pa.string()),
        ("name", pa.string()),
        ("size_bytes", pa.int64()),
        ("modified_at", pa.timestamp("us", tz="UTC")),
    ]
)
BATCH_ROWS = 10_000


def plain_path(uri: Column) -> Column:
    """A file URI, as Spark reports it, to the form the catalogue uses."""
    bare = F.regexp_replace(uri, r"\Afile:/+", "/")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def plain_root(location: str) -> str:
    """A root in the form of catalogue paths, without its closing slash."""
    _, path, prefix = open_filesystem(location)
    return prefix + path


# Clients of a worker, one per scheme and host.
_CLIENTS: dict = {}


def open_filesystem(location: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path inside it, and the prefix that turns such paths back into locations."""
    if location.startswith("file:"):
        filesystem, path = pafs.FileSystem.from_uri(location)
        return filesystem, path.rstrip("/") or "/", ""
    scheme, found, rest = location.partition("://")
    if not found:
        return pafs.LocalFileSystem(), location.rstrip("/") or "/", ""
    host, _, path = rest.partition("/")
    if (scheme, host) not in _CLIENTS:
        _CLIENTS[scheme, host] = pafs.FileSystem.from_uri(f"{scheme}://{host}/")
    filesystem, base = _CLIENTS[scheme, host]
    base = base.rstrip("/")
    prefix = f"{scheme}://{host}"
    return filesystem, f"{base}/{path}".rstrip("/") or "/", prefix[: len(prefix) - len(base)]


def qualified(spark: SparkSession, location: str) -> str:
    """A location without a scheme lies on the cluster's default file system, as for Spark's own sources."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if ":/" in location or default.startswith("file:"):
        return location
    return default.rstrip("/") + "/" + location.lstrip("/")


def _excluded(relative: str, fragments: tuple[str, ...]) -> bool:
    return any(f in relative for f in fragments)


# Filters that the listing itself can judge, on these columns (by their place in a row; none is ever NULL).
_COLUMNS = {"path": 0, "relative_path": 1, "name": 2, "size_bytes": 3}
_JUDGES = {
    "EqualTo": operator.eq,
    "GreaterThan": operator.gt,
    "GreaterThanOrEqual": operator.ge,
    "LessThan": operator.lt,
    "LessThanOrEqual": operator.le,
    "In": lambda value, wanted: value in wanted,
    "StringStartsWith": str.startswith,
    "StringEndsWith": str.endswith,
    "StringContains": lambda value, part: part in value,
}
_PUSHED = (
    EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, StringStartsWith, StringEndsWith, StringContains,
)


@dataclass(frozen=True)
class Condition:
    column: str
    judge: str
    value: object

    def holds(self, row: tuple) -> bool:
        return _JUDGES[self.judge](row[_COLUMNS[self.column]], self.value)

    def may_hold_below(self, directory: str) -> bool:
        """Whether a file somewhere below a directory, given in the form of the column, can meet the condition."""
        if self.column not in ("path", "relative_path"):
            return True
        inside = directory.rstrip("/") + "/" if directory else ""
        wanted = {"EqualTo": [self.value], "StringStartsWith": [self.value], "In": self.value}.get(self.judge)
        if wanted is None:
            return True
        equal = self.judge != "StringStartsWith"
        return any(w.startswith(inside) or (not equal and inside.startswith(w)) for w in wanted)


def split_filters(filters: list[Filter]) -> tuple[list[Condition], list[Filter]]:
    """Conditions for the listing, and the filters that are left to Spark."""
    taken, left = [], []
    for f in filters:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column in _COLUMNS and isinstance(f, IsNotNull):
            continue
        value = getattr(f, "value", None)
        if column in _COLUMNS and isinstance(f, _PUSHED) and value is not None:
            taken.append(Condition(column, type(f).__name__, value))
        else:
            left.append(f)
    return taken, left


@dataclass
class Subtree(InputPartition):
    """A directory to list, with all below it or (``deep`` false) for its own files; or a root that is a file."""

    directory: str | None
    deep: bool = True
    file: tuple | None = None
    # Microseconds since 1970: only files that changed after the first and until the second.
    changed: tuple[int, int] | None = None
    # Further directories that the same task lists, and whether with all below them.
    also: tuple[tuple[str, bool], ...] = ()

    def __post_init__(self):
        super().__init__(self.directory)


@dataclass
class Listing:
    """How a tree is dealt out to tasks and listed by them."""

    root: str
    exclude: tuple[str, ...] = ()
    fan_out: int = 64
    suffixes: tuple[str, ...] = ()
    conditions: list[Condition] = field(default_factory=list)

    def __post_init__(self):
        _, path, self.prefix = open_filesystem(self.root)
        self.base = path.rstrip("/") + "/"

    def partitions(self):
        """Open directories level by level until there are enough to deal out.

        Only the top of the tree is opened here, never a directory past the
        ``fanOut``-th, and only names of directories go into the plan: files are
        listed by the tasks. If one directory has so many others that there are more than ``fanOut``,
        a task lists several, as its start costs more than a small directory.
        """
        filesystem, path, _ = open_filesystem(self.root)
        info = filesystem.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        if info.type == pafs.FileType.File:
            return [Subtree(None, file=self._row(info))]
        parts, frontier = [], [path]
        while frontier and len(parts) + len(frontier) < self.fan_out:
            directory = frontier.pop(0)
            has_files = False
            for entry in filesystem.get_file_info(pafs.FileSelector(directory)):
                if entry.type == pafs.FileType.Directory and self._wanted_directory(entry.path):
                    frontier.append(entry.path)
                has_files |= entry.type == pafs.FileType.File
            if has_files:
                parts.append(Subtree(directory, deep=False))
        parts += [Subtree(d) for d in frontier]
        tasks = max(1, self.fan_out)
        for i, part in enumerate(parts[:tasks]):
            part.also = tuple((p.directory, p.deep) for p in parts[i + tasks :: tasks])
        return parts[:tasks] or [Subtree(None)]

    def read(self, partition: Subtree):
        rows = [partition.file] if partition.file and self._wanted(partition.file, partition.changed) else []
        if partition.directory is not None:
            filesystem, _, _ = open_filesystem(self.root)
            pending = [(partition.directory, partition.deep), *partition.also]
            while pending:
                directory, deep = pending.pop()
                for entry in filesystem.get_file_info(pafs.FileSelector(directory)):
                    if entry.type == pafs.FileType.Directory and deep:
                        if self._wanted_directory(entry.path):
                            pending.append((entry.path, True))
                    elif entry.type == pafs.FileType.File:
                        row = self._row(entry)
                        if self._wanted(row, partition.changed):
                            rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    def _wanted_directory(self, path: str) -> bool:
        relative = self._relative(path)
        if _excluded(relative, self.exclude):
            return False
        forms = {"path": self.prefix + path, "relative_path": relative}
        return all(c.may_hold_below(forms.get(c.column, "")) for c in self.conditions)

    def _wanted(self, row: tuple, changed: tuple[int, int] | None = None) -> bool:
        if _excluded(row[1], self.exclude) or not row[2].endswith(self.suffixes or ("",)):
            return False
        if changed and row[4] is not None and not changed[0] < row[4] <= changed[1]:
            return False
        return all(c.holds(row) for c in self.conditions)

    def _relative(self, path: str) -> str:
        return path[len(self.base) :] if path.startswith(self.base) else path

    def _row(self, info) -> tuple:
        return (
            self.prefix + info.path,
            self._relative(info.path),
            info.base_name,
            info.size,
            info.mtime_ns // 1000 if info.mtime_ns is not None else None,
        )

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(values, type=field.type) for values, field in zip(columns, ARROW_SCHEMA)],
            schema=ARROW_SCHEMA,
        )


class CatalogueReader(Listing, DataSourceReader):
    """A catalogue read once."""


class PushingReader(CatalogueReader):
    """One that judges Spark's filters while it lists, and does not open directories that cannot hold a wanted file.

    Only for sessions with ``spark.sql.python.filterPushdown.enabled``; without it Spark refuses such readers. Spark
    4.1 keeps the filters with the loaded table, so load it anew for each query; the options ``prefix``,
    ``minBytes`` and ``maxBytes`` have neither limit.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        taken, left = split_filters(filters)
        self.conditions = [*self.conditions, *taken]
        return left


class CatalogueStream(Listing, DataSourceStreamReader):
    """A catalogue as a stream of files that are new or have changed.

    An offset is a moment: a batch has the files that changed after the batch before and until then. Files can turn
    up late with an older time (copied, renamed, clocks apart), so each batch looks back by
    ``lateness``, and the first one of a run, and every ``full_every``-th, has no lower bound. So no
    file is lost, and a file may come again; who reads the stream has to know what is done, as the archive does.
    The bounds are part of the offset, so a batch that is replayed has the same.
    """

    lateness = 3_600_000_000
    full_every = 100
    settle = 0
    batches = 0

    def _now(self) -> int:
        return time.time_ns() // 1000 - self.settle

    def initialOffset(self) -> dict:
        return {"after": 0, "until": 0}

    def latestOffset(self) -> dict:
        now = self._now()
        full = self.batches % self.full_every == 0
        self.batches += 1
        after = -(2**62) if full else self._before - self.lateness
        self._before = now
        return {"after": after, "until": now}

    def partitions(self, start: dict | None = None, end: dict | None = None):
        parts = Listing.partitions(self)
        for part in parts:
            part.changed = (end["after"], end["until"])
        return parts

    def read(self, partition: Subtree) -> Iterator[tuple]:
        for batch in Listing.read(self, partition):
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    def commit(self, end: dict) -> None:
        """Nothing to do: there is no state but the offset."""


class FileCatalogue(DataSource):
    """``spark.read.format("file_catalogue").load(root)``, and ``readStream`` for new files (:class:`CatalogueStream`).

    Options: ``exclude``, newline-separated fragments of relative paths to skip; ``suffixes``, newline-separated
    endings of names to keep; ``prefix``, how relative paths have to begin (other directories are not opened);
    ``minBytes`` and ``maxBytes``, the sizes to keep; ``fanOut``, how many subtrees to aim for (default 64); ``pushdown``,
    true to judge Spark's filters while listing. For streams: ``lateness`` and ``settle``, seconds to look back, and
    to wait before a file counts; ``fullEvery``, batches from one without lower bound to the next.
    """

    @classmethod
    def name(cls) -> str:
        return "file_catalogue"

    def schema(self) -> str:
        return SCHEMA

    def _listing(self, kind: type[Listing]) -> Listing:
        parts = {k: tuple(f for f in self.options.get(k, "").split("\n") if f) for k in ("exclude", "suffixes")}
        asked = (
            ("prefix", "relative_path", "StringStartsWith", str),
            ("minBytes", "size_bytes", "GreaterThanOrEqual", int),
            ("maxBytes", "size_bytes", "LessThanOrEqual", int),
        )
        conditions = [Condition(c, judge, of(self.options[o])) for o, c, judge, of in asked if self.options.get(o)]
        return kind(self.options["path"], fan_out=int(self.options.get("fanOut", 64)), conditions=conditions, **parts)

    def reader(self, schema) -> DataSourceReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return self._listing(PushingReader if pushing else CatalogueReader)

    def streamReader(self, schema) -> DataSourceStreamReader:
        stream = self._listing(CatalogueStream)
        stream.lateness = int(float(self.options.get("lateness", 3600)) * 1e6)
        stream.settle = int(float(self.options.get("settle", 0)) * 1e6)
        stream.full_every = int(self.options.get("fullEvery", 100))
        return stream


cloudpickle.register_pickle_by_value(sys.modules[__name__])
