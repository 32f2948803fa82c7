"""Parts of large files as rows: members of archives, and runs of elements of JSON containers, so that one file is read by many tasks.

Files are listed by Spark. One task a file then looks for boundaries only (a zip's central directory, a tar's headers, the brackets and commas of JSON), which gives a
row for each part; parts are joined with what is wanted, dealt out, and read by range. Files are opened by pyarrow's file systems;
where a path is in a store that these don't know, the file is taken whole from Spark's reader.
"""

from __future__ import annotations

import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from folioscope.sources.scratch import stored

#: Bytes that are read at once when a file is scanned; of a part of JSON, about.
BLOCK = 8 << 20
CHUNK = 16 << 20
#: Bytes of members that a task gives at once.
BATCH = 8 << 20
_ZIP_STORED, _ZIP_DEFLATED, _LOCAL_HEADER = 0, 8, 30


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """ValueError where the path's store isn't known."""
    return pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def known(path: str) -> bool:
    """Whether the path's store can be opened here."""
    try:
        _store(path)
    except (ValueError, NotImplementedError, OSError):
        return False
    return True


def open_file(path: str) -> pa.NativeFile:
    """Random access to a file."""
    store, at = _store(path)
    return store.open_input_file(at)


def write_file(path: str, content: bytes) -> None:
    """A whole file; a task that is run again writes the same."""
    store, at = _store(path)
    store.create_dir(at.rsplit("/", 1)[0])
    with store.open_output_stream(at) as out:
        out.write(content)


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length; no content is read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def is_folder(path: str) -> bool:
    """Whether the path is a folder of a store that can be opened here."""
    if not known(path):
        return False
    store, at = _store(path.rstrip("/"))
    return store.get_file_info(at).type == pyarrow.fs.FileType.Directory


def _entries(recursive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = _store(path.rstrip("/"))
                before = "file:" if store.type_name == "local" else path.rstrip("/")[: -len(at)]
                hidden = lambda p: any(x[:1] in "._" for x in p[len(at) :].strip("/").split("/"))  # noqa: B023, E731  as Spark skips them
                found = [f for f in store.get_file_info(pyarrow.fs.FileSelector(at, recursive=recursive)) if not hidden(f.path)]
                folder = [f.type == pyarrow.fs.FileType.Directory for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([before + f.path for f in found], pa.string()), pa.array(folder, pa.bool_())], ["path", "folder"])

    return run


def below(spark: SparkSession, path: str) -> DataFrame:
    """path of all files below a folder: one task lists the folder itself, its sub-folders are dealt out and listed with all below them. Nothing is opened."""
    kind = "path string, folder boolean"
    own = stored(spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(_entries(False), kind), "entries")
    deeper = dealt(own.where("folder").select("path"), "path").mapInArrow(_entries(True), kind)
    return own.union(deeper).where("NOT folder").select("path")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


MEMBERS = "archive string, member string, content binary"
#: kind: range (bytes from start, by method), stream (the n-th member of a compressed tar), whole (of a store that isn't known here; no member).
_PLACES = "archive string, member string, kind string, start long, size long, method int"


def _places(path: str, suffix: str) -> Iterator[tuple]:
    if not known(path):
        yield path, None, "whole", 0, 0, 0
        return
    with open_file(path) as file:
        try:
            with zipfile.ZipFile(file) as z:
                for m in z.infolist():
                    if m.filename.endswith(suffix):
                        yield path, m.filename, "range", m.header_offset, m.compress_size, m.compress_type
                return
        except zipfile.BadZipFile:
            file.seek(0)
        try:
            with tarfile.open(fileobj=file, mode="r:") as t:
                for m in t:
                    if m.isfile() and m.name.endswith(suffix):
                        yield path, m.name, "range", m.offset_data, m.size, -1
                return
        except tarfile.TarError:
            file.seek(0)
        try:
            with tarfile.open(fileobj=file, mode="r|*") as t:
                for n, m in enumerate(t):
                    if m.isfile() and m.name.endswith(suffix):
                        yield path, m.name, "stream", n, m.size, 0
        except (tarfile.TarError, EOFError, OSError, zlib.error):
            return


def _listed_members(suffix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = list(_places(path, suffix))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()))],
                    ["archive", "member", "kind", "start", "size", "method"],
                )

    return run


def _member(file: BinaryIO, name: str, start: int, size: int, method: int) -> bytes:
    if method in (_ZIP_STORED, _ZIP_DEFLATED):
        file.seek(start)
        lengths = struct.unpack("<HH", file.read(_LOCAL_HEADER)[26:])
        start += _LOCAL_HEADER + sum(lengths)
    if method > _ZIP_DEFLATED:
        file.seek(0)
        return zipfile.ZipFile(file).read(name)
    file.seek(start)
    data = file.read(size)
    return zlib.decompress(data, -zlib.MAX_WBITS) if method == _ZIP_DEFLATED else data


def _streamed(file: BinaryIO, wanted: Iterator[int]) -> Iterator[bytes]:
    """Contents of the members with the wanted numbers (rising), in one pass."""
    with tarfile.open(fileobj=file, mode="r|*") as t:
        at = next(wanted, None)
        for n, m in enumerate(t):
            while n == at:
                yield t.extractfile(m).read()
                at = next(wanted, None)
            if at is None:
                return


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of rows sorted by archive, kind and start; a file is opened once a run of its rows."""

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["archive", "member", "content"])

    def contents(batch: pa.RecordBatch) -> Iterator[tuple]:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "kind", "start", "size", "method"))))
        first = 0
        while first < len(rows):
            last = next((k for k in range(first, len(rows)) if rows[k][:1] + rows[k][2:3] != rows[first][:1] + rows[first][2:3]), len(rows))
            own = rows[first:last]
            with open_file(own[0][0]) as file:
                if own[0][2] == "stream":
                    yield from zip((r[0] for r in own), (r[1] for r in own), _streamed(file, iter([r[3] for r in own])))
                else:
                    for path, name, _, start, size, method in own:
                        yield path, name, _member(file, name, start, size, method)
            first = last

    for batch in batches:
        held, size = [], 0
        for row in contents(batch):
            held.append(row)
            size += len(row[2])
            if size >= BATCH:
                yield given(held)
                held, size = [], 0
        yield given(held)


def archive_places(spark: SparkSession, paths: str | list[str], suffix: str) -> DataFrame:
    """Where the members with a suffix are in tar and zip archives; archives that don't open give no row, and no member is read."""
    return dealt(listed(spark, paths), "path").mapInArrow(_listed_members(suffix), _PLACES)


def read_places(places: DataFrame) -> DataFrame:
    """The members (archive, member, content) at places of kind range and stream: ranges are dealt out, streams go by archive."""
    order = ["archive", "kind", "start"]
    ranges = dealt(places.where("kind = 'range'"), "archive", "start").sortWithinPartitions(*order).mapInArrow(_read_members, MEMBERS)
    streams = dealt(places.where("kind = 'stream'"), "archive").sortWithinPartitions(*order).mapInArrow(_read_members, MEMBERS)
    return ranges.union(streams)


_OPEN, _CLOSE, _COMMA, _COLON = (np.frombuffer(s, np.uint8) for s in (b"{[", b"}]", b",", b":"))
_STRUCTURE = np.zeros(256, np.int8)
_QUOTE, _BACKSLASH = 4, 5
_STRUCTURE[_OPEN], _STRUCTURE[_CLOSE], _STRUCTURE[_COMMA], _STRUCTURE[_COLON] = 1, -1, 2, 3
_STRUCTURE[ord('"')], _STRUCTURE[ord("\\")] = _QUOTE, _BACKSLASH


class _Structure:
    """Brackets, commas and colons of JSON outside of strings, block by block, with the depth after each."""

    def __init__(self) -> None:
        self.quoted, self.escaped, self.depth = False, False, 0

    def of(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, kinds (1 opens, -1 closes, 2 comma, 3 colon), depths."""
        kinds = np.frombuffer(bytearray(block.tobytes().translate(_STRUCTURE.tobytes())), np.int8)
        if self.escaped and len(block) and kinds[0] > 3:
            kinds[0] = 0  # a quote or backslash that is escaped itself
        self.escaped = False
        at = np.flatnonzero(kinds != 0)  # all else goes over these alone
        kinds = kinds[at]
        slashes = at[kinds == _BACKSLASH]
        if len(slashes):
            starts = slashes[np.append(True, np.diff(slashes) > 1)]
            lengths = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(slashes) > 1)), len(slashes)))
            after = (starts + lengths)[lengths % 2 == 1]
            self.escaped = len(after) > 0 and after[-1] == len(block)
            after = after[after < len(block)]
            kinds[np.searchsorted(at, after[block[after] == 34])] = 0
        quotes = kinds == _QUOTE
        inside = np.bitwise_xor.accumulate(quotes) ^ self.quoted
        self.quoted = bool(inside[-1]) if len(at) else self.quoted
        own = np.flatnonzero(~inside & (kinds < _QUOTE) & (kinds != 0))
        at, kinds = at[own], kinds[own]
        depths = self.depth + np.cumsum(np.where(np.abs(kinds) == 1, kinds, 0), dtype=np.int64)
        self.depth = int(depths[-1]) if len(at) else self.depth
        return at, kinds, depths


def json_parts(read: Callable[[int, int], bytes], size: int, level: int, chunk: int, block: int) -> Iterator[tuple[str | None, bool, int, int]]:
    """field, is_array, start, end of runs of whole entries, about `chunk` bytes each.

    level 1: entries of the outermost container (field is null). level 2: entries of the containers in the fields of the outermost object; an
    outermost array is taken as in level 1. Text that isn't closed gives the runs that are whole.
    """
    scan, container, key_from = _Structure(), None, 0
    field: str | None = None
    for offset in range(0, size, block):
        data = read(offset, min(block, size - offset))
        places, kinds, depths = scan.of(np.frombuffer(data, np.uint8))
        if offset == 0 and len(kinds) and data[places[0]] == ord("["):
            level = 1
        commas = places[(kinds == 2) & (depths == level)] + offset
        marks = np.flatnonzero((kinds == 1) & (depths == level) | (kinds == -1) & (depths == level - 1) | (depths == 1) & (kinds != -1) & (level == 2))
        ends: list[tuple[int, str, int]] = []
        for k in marks.tolist():
            here, kind, depth = int(places[k]) + offset, int(kinds[k]), int(depths[k])
            if kind == 1 and depth == level:
                ends.append((here, "open", int(data[places[k]] == ord("["))))
            elif kind == -1 and depth == level - 1:
                ends.append((here, "close", 0))
            elif kind == 3:
                ends.append((here, "key", 0))
            else:
                ends.append((here, "next", 0))
        for here, what, is_array in [*ends, (offset + len(data), "block", 0)]:
            if container is not None and what in ("close", "block"):
                done = commas[(commas > container[1]) & (commas < here)]
                k = 0
                while (k := int(np.searchsorted(done, container[1] + chunk))) < len(done):
                    yield field, container[0], container[1], int(done[k])
                    container = container[0], int(done[k]) + 1
            if what == "close" and container is not None:
                yield field, container[0], container[1], here
                container = None
            elif what == "open":
                container = bool(is_array), here + 1
            elif what == "key":
                field = read(key_from, here - key_from).decode().strip().strip('"')
            elif what == "next":
                key_from = here + 1


_PARTS = "path string, field string, is_array boolean, start long, end long"
_PART = pa.schema([("path", pa.string()), ("field", pa.string()), ("is_array", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])


def _scanned(level: int, chunk: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist()):
                if not known(path):
                    yield pa.RecordBatch.from_pylist([{"path": path, "start": -1, "end": -1}], _PART)
                    continue
                with open_file(path) as file:

                    def read(start: int, size: int) -> bytes:
                        file.seek(start)  # noqa: B023  used before the next file
                        return file.read(size)  # noqa: B023

                    rows = [(path, *part) for part in json_parts(read, length, level, chunk, block)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PART)], schema=_PART)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, field, is_array, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "field", "is_array", "start", "end"))):
            with open_file(path) as file:
                file.seek(start)
                own = file.read(end - start)
            text = b"[" + own + b"]" if is_array else b"{" + own + b"}"
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (path, field, text.decode("utf-8", "replace"))], ["path", "field", "value"])


def json_places(files: DataFrame, level: int, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Parts of JSON files (path, length): path, field, is_array, start, end (-1 of a store that isn't known). Only brackets, commas and quotes are looked at."""
    return dealt(files, "path").mapInArrow(_scanned(level, chunk, block), _PARTS)


def json_texts(places: DataFrame) -> DataFrame:
    """path, field, value: the JSON text of each part, in brackets of its own."""
    return dealt(places, "path", "start").mapInArrow(_texts, "path string, field string, value string")
