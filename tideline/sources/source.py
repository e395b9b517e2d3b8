"""The Parquet store as a Spark data source: ``format("tideline")``, for batches and streams, from SQL as well.

Options: path (the store's root), kind (samples, counters or sketches), part (ops, by default, or buckets) and version, of
batches (the newest by default). A batch reads one state. Conditions on series and t are pushed down: row groups whose
statistics rule them out are no partitions, and rows are filtered as they are read. A stream gives the operations of each
append once, in the order of commits; compactions between them change nothing, until vacuum() takes what they replaced.

Readers open files by pyarrow, so the root must be a path that pyarrow knows (a local one, hdfs://, s3:// and so on).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tideline.schema import KINDS
from tideline.sources.store import folders, part_of

_COLUMNS = ("series", "t")


def _opened(path: str) -> tuple[object, str]:
    """A file system and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(root: str, kind: str) -> dict[int, str]:
    """The manifests that there are, by version."""
    from pyarrow import fs

    files, folder = _opened(f"{root}/{kind}/manifest")
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {int(f.base_name): f.path for f in found if f.base_name.isdigit()}


def _manifest(root: str, kind: str, version: int) -> dict | None:
    """A manifest; none where its writer was lost."""
    files, path = _opened(f"{root}/{kind}/manifest/{version}")
    with files.open_input_stream(path) as f:
        try:
            return json.loads(f.read())
        except ValueError:
            return None


def _state(root: str, kind: str, version: int | None) -> dict:
    known = _manifests(root, kind)
    if version is not None and version and version not in known:
        raise ValueError(f"{kind} has no version {version}")
    for v in sorted((v for v in known if version is None or v <= version), reverse=True):
        if (found := _manifest(root, kind, v)) is not None:
            return found
    return {"log": [], "ops": [], "buckets": [], "parts": 1}


@dataclass
class Piece(InputPartition):
    """Row groups of one file, and the conditions that its rows must meet."""

    path: str
    groups: tuple[int, ...]
    wanted: tuple[tuple[str, str, object], ...] = ()


def _expression(wanted: Iterable[tuple[str, str, object]]) -> object:
    import pyarrow.compute as pc

    out = None
    for column, way, value in wanted:
        c = pc.field(column)
        one = {"=": lambda: c == value, "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value, "in": lambda: c.isin(list(value)), "not in": lambda: ~c.isin(list(value)), "null": lambda: c.is_null() if value else c.is_valid()}[way]()
        out = one if out is None else out & one
    return out


def _pieces(folders: list[str], wanted: tuple[tuple[str, str, object], ...]) -> list[Piece]:
    import pyarrow.dataset as ds

    out = []
    for folder in folders:
        files, path = _opened(folder)
        for fragment in ds.dataset(path, filesystem=files, format="parquet").get_fragments():
            for group in fragment.split_by_row_group(_expression(wanted)):
                out.append(Piece(f"{folder}/{fragment.path.rpartition('/')[2]}", tuple(g.id for g in group.row_groups), wanted))
    return out


def _rows(piece: Piece, schema: StructType) -> Iterator[object]:
    import pyarrow as pa
    import pyarrow.dataset as ds
    from pyspark.sql.pandas.types import to_arrow_schema

    files, path = _opened(piece.path)
    fragment = ds.ParquetFileFormat().make_fragment(path, filesystem=files, row_groups=list(piece.groups))
    kinds = to_arrow_schema(schema)
    for batch in fragment.scanner(columns=schema.names, filter=_expression(piece.wanted)).to_batches():
        if len(batch):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kinds, strict=True)], schema=kinds)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.root, self.kind, self.part, self.version = options["path"].rstrip("/"), options["kind"], options.get("part", "ops"), options.get("version")
        self.schema, self.wanted = schema, ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what series and t are held against, and gives the rest back."""
        ways = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in"}
        wanted = []
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _COLUMNS:
                yield f
            elif type(f) in ways:
                wanted.append((column, ways[type(f)], f.value))
            elif isinstance(f, IsNull | IsNotNull):
                wanted.append((column, "null", isinstance(f, IsNull)))
            elif isinstance(f, EqualNullSafe):
                wanted.append((column, "=", f.value) if f.value is not None else (column, "null", True))
            else:
                yield f
        self.wanted = tuple(wanted)

    def partitions(self) -> list[Piece]:
        state = _state(self.root, self.kind, None if self.version is None else int(self.version))
        out = _pieces([path for path, _ in folders(state[self.part], self._parts(state["parts"]))], self.wanted)
        for b in state["log"] if self.part == "ops" else ():
            # Parts of a batch that are in the snapshot by now are left to it.
            out += _pieces([b["path"]], (*self.wanted, ("part", "not in", tuple(b["gone"]))) if b["gone"] else self.wanted)
        return out or [Piece("", ())]

    def _parts(self, count: int) -> set[int] | None:
        """The parts of the snapshot that the wanted series are in."""
        for column, way, value in self.wanted:
            if column == "series" and (way in ("=", "in") or way == "null" and value):
                return {part_of(s, count) for s in ([None] if way == "null" else [value] if way == "=" else value)}
        return None

    def read(self, partition: Piece) -> Iterator[object]:
        if partition.path:
            yield from _rows(partition, self.schema)


class _StreamReader(DataSourceStreamReader):
    """Offsets are versions."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.root, self.kind, self.schema = options["path"].rstrip("/"), options["kind"], schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": max(_manifests(self.root, self.kind), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        known, folders = _manifests(self.root, self.kind), []
        # A snapshot empties the log; what was in it has been read from the manifests before.
        before = {b["path"] for b in (_manifest(self.root, self.kind, start["version"]) or {"log": []})["log"]} if start["version"] in known else set()
        for version in range(start["version"] + 1, end["version"] + 1):
            if version not in known:
                raise ValueError(f"version {version} of {self.kind} is gone before it was read")
            log = [b["path"] for b in (_manifest(self.root, self.kind, version) or {"log": []})["log"]]
            folders += [p for p in log if p not in before]
            before |= set(log)
        return _pieces(folders, ())

    def read(self, partition: Piece) -> Iterator[object]:
        yield from _rows(partition, self.schema)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class TidelineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tideline"

    def schema(self) -> str:
        kind, part = self.options.get("kind"), self.options.get("part", "ops")
        if kind not in KINDS or part not in ("ops", "buckets") or "path" not in self.options:
            raise ValueError(f"a path, a kind ({', '.join(KINDS)}) and a part (ops or buckets) are needed, not {dict(self.options)}")
        return KINDS[kind][part == "buckets"]

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> _StreamReader:  # noqa: N802
        if self.options.get("part", "ops") != "ops":
            raise ValueError("a stream is of operations")
        return _StreamReader(dict(self.options), schema)


def register_source(spark: SparkSession) -> None:
    """Makes format("tideline") known to the session, with conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TidelineSource)
