"""OSM PBF files as a Spark data source, `osmpbf`: nodes (node_id, lat, lng, tags) and ways (way_id, refs, tags).

A file is a row of blobs, each with a small header that says how long it is. The driver walks the headers, and every partition
reads some blobs on its own: a zlib stream with a table of strings and groups of nodes or ways, whose numbers are varints and mostly
differences. Paths are those of a mounted file system or of a store that pyarrow knows; a folder's files are one table.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMAS = {
    "nodes": "node_id long, lat long, lng long, tags map<string,string>",
    "ways": "way_id long, refs array<long>, tags map<string,string>",
}
#: Compressed bytes that one partition reads, about; elements that are written to a blob.
PART_BYTES, BLOCK = 8 << 20, 8_000
# What a reader of these tables must understand; longest header and blob by the format's definition.
FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
LONGEST_HEADER, LONGEST_BLOB = 64 << 10, 32 << 20
#: Degrees come in units of 1e-9; tables have micro-degrees, rounded half up.
NANO = 1000
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == VARINT:
            value, at = _varint(data, at)
        elif kind == BYTES:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (FIXED32, FIXED64):
            n = 4 if kind == FIXED32 else 8
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"a field of kind {kind} in a PBF message")
        yield key >> 3, value


def _packed(data: bytes) -> np.ndarray:
    """The varints of a packed field."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 0x80)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def _signed(x: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _one(message: list[tuple[int, int | bytes]], number: int, default: int | bytes) -> int | bytes:
    return next((v for k, v in reversed(message) if k == number), default)


def _signed64(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _inflated(blob: bytes) -> bytes:
    message = list(_fields(blob))
    if (raw := _one(message, 1, b"")) != b"":
        return raw
    if (data := _one(message, 3, b"")) != b"":
        return zlib.decompress(data)
    raise ValueError("a PBF blob that is neither plain nor zlib")


def _block(data: bytes, kind: str) -> Iterator[tuple]:
    """The rows of a block."""
    message = list(_fields(data))
    strings = [v.decode("utf-8", "replace") for k, v in _fields(_one(message, 1, b"")) if k == 1]
    unit, lat0, lng0 = _one(message, 17, 100), _signed64(_one(message, 19, 0)), _signed64(_one(message, 20, 0))
    micro = lambda x, off: (off + unit * x + NANO // 2) // NANO
    for number, group in message:
        if number != 2:
            continue
        for k, value in _fields(group):
            if k == 2 and kind == "nodes":
                dense = list(_fields(value))
                ids, lat, lng = (np.cumsum(_signed(_packed(_one(dense, n, b"")))).tolist() for n in (1, 8, 9))
                tags = _dense_tags(_packed(_one(dense, 10, b"")).tolist(), strings, len(ids))
                for i, y, x, t in zip(ids, lat, lng, tags, strict=True):
                    yield i, micro(y, lat0), micro(x, lng0), t
            elif k == 1 and kind == "nodes":
                node = list(_fields(value))
                signed = lambda n, node=node: int(_signed(np.array([_one(node, n, 0)], np.uint64))[0])
                yield signed(1), micro(signed(8), lat0), micro(signed(9), lng0), _tags(node, strings)
            elif k == 3 and kind == "ways":
                way = list(_fields(value))
                yield _signed64(_one(way, 1, 0)), np.cumsum(_signed(_packed(_one(way, 8, b"")))).tolist(), _tags(way, strings)


def _tags(message: list, strings: list[str]) -> dict[str, str]:
    keys, values = (_packed(_one(message, n, b"")).tolist() for n in (2, 3))
    return {strings[k]: strings[v] for k, v in zip(keys, values, strict=True)}


def _dense_tags(flat: list[int], strings: list[str], n: int) -> list[dict[str, str]]:
    """Keys and values of all nodes in a row, each node's with a 0 behind; no list at all if no node has a tag."""
    out, at = [], 0
    for _ in range(n):
        tags = {}
        while at < len(flat) and flat[at]:
            tags[strings[flat[at]]] = strings[flat[at + 1]]
            at += 2
        at += 1
        out.append(tags)
    return out


@dataclass
class Blobs(InputPartition):
    path: str
    first: int
    size: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [inner] if info.is_file else sorted(x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.is_file and x.base_name.endswith(".pbf"))
    return [path[: len(path) - len(inner)] + x if path.endswith(inner) else x for x in found]


def _header(f) -> tuple[str, int] | None:
    """Kind and size of the next blob, None at the end of the file."""
    head = f.read(4)
    if not head:
        return None
    n = struct.unpack(">I", head)[0] if len(head) == 4 else LONGEST_HEADER + 1
    if n > LONGEST_HEADER:
        raise ValueError("not a PBF file, or a broken one")
    if len(data := f.read(n)) < n:
        raise ValueError("a PBF file that ends within a header")
    message = list(_fields(data))
    size = _one(message, 3, 0)
    if size > LONGEST_BLOB:
        raise ValueError("a PBF blob that is too long")
    return _one(message, 1, b"").decode(), size


class PbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def partitions(self) -> list[Blobs]:
        return [part for path in _files(self.path) for part in self._parts(path)]

    def _parts(self, path: str) -> Iterator[Blobs]:
        system, inner = _opened(path)
        with system.open_input_file(inner) as f:
            first, end = 0, f.size()
            while (at := f.tell()) < end:
                kind, size = _header(f)
                if kind == "OSMHeader":
                    needs = {v.decode() for k, v in _fields(_inflated(f.read(size))) if k == 4}
                    if needs - FEATURES:
                        raise ValueError(f"{path} needs {', '.join(sorted(needs - FEATURES))}")
                else:
                    f.seek(f.tell() + size)
                if f.tell() > end:
                    raise ValueError(f"{path} ends within a blob")
                if f.tell() - first >= PART_BYTES or f.tell() == end:
                    yield Blobs(path, first, f.tell() - first)
                    first = f.tell()
                assert f.tell() > at

    def read(self, part: Blobs) -> Iterator[tuple]:
        system, inner = _opened(part.path)
        with system.open_input_file(inner) as f:
            f.seek(part.first)
            while f.tell() < part.first + part.size:
                kind, size = _header(f)
                blob = f.read(size)
                if kind == "OSMData":
                    yield from _block(_inflated(blob), self.kind)


def _number(x: int) -> bytes:
    out = bytearray()
    x &= (1 << 64) - 1
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def _bytes(number: int, data: bytes) -> bytes:
    return _number(number << 3 | BYTES) + _number(len(data)) + data


def _differences(values: list[int]) -> bytes:
    out, before = [], 0
    for v in values:
        d = v - before
        out.append(_number(d << 1 ^ d >> 63))
        before = v
    return b"".join(out)


def _blob(kind: str, data: bytes) -> bytes:
    blob = _number(2 << 3 | VARINT) + _number(len(data)) + _bytes(3, zlib.compress(data))
    header = _bytes(1, kind.encode()) + _number(3 << 3 | VARINT) + _number(len(blob))
    return struct.pack(">I", len(header)) + header + blob


def _written(rows: list[Row], kind: str) -> bytes:
    strings: dict[str, int] = {"": 0}
    place = lambda s: strings.setdefault(s, len(strings))
    tags = [[(place(k), place(v)) for k, v in (r["tags"] or {}).items()] for r in rows]
    if kind == "nodes":
        flat = b"".join(b"".join(_number(k) + _number(v) for k, v in t) + b"\0" for t in tags) if any(tags) else b""
        # Units of 1e-7 degrees.
        body = _bytes(1, _differences([r["node_id"] for r in rows])) + _bytes(8, _differences([10 * r["lat"] for r in rows])) + _bytes(9, _differences([10 * r["lng"] for r in rows]))
        group = _bytes(2, body + (_bytes(10, flat) if flat else b""))
    else:
        group = b"".join(
            _bytes(3, _number(1 << 3 | VARINT) + _number(r["way_id"]) + _bytes(2, b"".join(_number(k) for k, _ in t)) + _bytes(3, b"".join(_number(v) for _, v in t)) + _bytes(8, _differences(r["refs"] or [])))
            for r, t in zip(rows, tags, strict=True)
        )
    table = b"".join(_bytes(1, s.encode()) for s in strings)
    return _blob("OSMData", _bytes(1, table) + _bytes(2, group))


class PbfWriter(DataSourceWriter):
    """Each task writes a file of its own, with blobs of BLOCK elements."""

    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        system, inner = _opened(self.path)
        system.create_dir(inner)
        with system.open_output_stream(f"{inner}/{self.kind}-{uuid.uuid4().hex}.osm.pbf") as f:
            f.write(_blob("OSMHeader", b"".join(_bytes(4, x.encode()) for x in sorted(FEATURES))))
            block: list[Row] = []
            for r in rows:
                block.append(r)
                if len(block) == BLOCK:
                    f.write(_written(block, self.kind))
                    block = []
            if block:
                f.write(_written(block, self.kind))
        return WriterCommitMessage()


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def _kind(self) -> str:
        if (kind := self.options.get("kind", "ways")) not in SCHEMAS:
            raise ValueError(f"kind is one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], self._kind())

    def writer(self, schema, overwrite: bool) -> PbfWriter:
        return PbfWriter(self.options["path"], self._kind())


def read_pbf(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The nodes or the ways of a PBF file or of a folder of such files."""
    spark.dataSource.register(OsmPbf)
    return spark.read.format("osmpbf").option("kind", kind).load(path)


def write_pbf(rows: DataFrame, path: str, kind: str) -> None:
    """Adds PBF files with nodes or ways of the columns that reading gives to a folder."""
    rows.sparkSession.dataSource.register(OsmPbf)
    rows.write.format("osmpbf").option("kind", kind).mode("append").save(path)
