"""Stacks of any size as a data source of Spark, split within files: spark.read.format("stack").load(path).

Files are read in place by seeking, so none has to fit a row or a task. Files over `splitBytes` (64 MB unless given) are
split into partitions of consecutive pictures of about that size; smaller ones are whole, and several share a partition. To
split a file, the places of its pictures are read when the query is planned: an ND2's chunk map, or the links between a
TIFF's pages, some bytes each. Pixels and tags are read by the partitions.

Comparisons of frame with numbers are pushed to the source, where pictures beyond them are not read; equality of video
chooses files. Spark asks a source for this if spark.sql.python.filterPushdown.enabled is on; without it, use the format
"stack_all", with the options firstFrame and lastFrame for a range. Paths may be a file or a folder of any store that
pyarrow reads (file, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from spotloom.sources import nd2, stacks
from spotloom.sources.stacks import FRAMES, UnsupportedImage

SPLIT, BLOCK = 64 << 20, 1 << 16
_ENDINGS = {"tif": "tiff", "tiff": "tiff", "nd2": "nd2"}
_BROKEN = (UnsupportedImage, struct.error, KeyError, IndexError, zlib.error, ValueError)


class Seeking:
    """A file as if it were bytes: slices are read where they lie, short ones through the block around them."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()
        self.start, self.block = 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        if b <= a:
            return b""
        if b - a >= BLOCK:
            return self.file.read_at(b - a, a)
        if not self.start <= a or b > self.start + len(self.block):
            self.start, self.block = a, self.file.read_at(min(BLOCK, self.size - a), a)
        return self.block[a - self.start : b - self.start]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _kind(path: str) -> str | None:
    return _ENDINGS.get(path.rsplit(".", 1)[-1].lower())


@dataclass
class Pictures(InputPartition):
    """Whole files, or pictures of one by number and place."""

    root: str
    files: list[str]
    places: list[tuple[int, int]] | None = None


class StackReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.root = options["path"]
        self.split = int(options.get("splitbytes", SPLIT))
        self.first, self.last = int(options.get("firstframe", 0)), int(options.get("lastframe", 1 << 62))
        self.videos: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        store, root = _opened(self.root)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
        out, small, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if not f.is_file or _kind(f.path) is None or (self.videos is not None and f.base_name.rpartition(".")[0] not in self.videos):
                continue
            if f.size > self.split and (parts := self._parts(store, f)):
                out += parts
                continue
            small, size = [*small, f.path], size + f.size
            if size >= self.split:
                out.append(Pictures(self.root, small))
                small, size = [], 0
        return out + ([Pictures(self.root, small)] if small else [])

    def _parts(self, store: fs.FileSystem, f: fs.FileInfo) -> list[InputPartition]:
        """A large file in parts of consecutive pictures; none if its pictures can't be found, so that it is read, and fails, whole."""
        with store.open_input_file(f.path) as opened:
            data = Seeking(opened)
            try:
                places = list(stacks.tiff_places(data)) if _kind(f.path) == "tiff" else nd2.places(nd2.chunk_map(data))
            except _BROKEN:
                return []
        if not places:
            return []
        each = max(1, self.split * len(places) // f.size)
        wanted = [(n, at) for n, at in enumerate(places, 1) if self.first <= n <= self.last]
        return [Pictures(self.root, [f.path], wanted[i : i + each]) for i in range(0, len(wanted), each)]

    def read(self, partition: Pictures) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(partition.root)
        for path in partition.files:
            video = path.rsplit("/", 1)[-1].rpartition(".")[0]
            with store.open_input_file(path) as opened:
                data, n = Seeking(opened), 0
                try:
                    for n, a, said in self._pictures(data, path, partition.places):
                        if a is not None:
                            yield _row(video, n, a, said, None)
                    if not n and partition.places is None:
                        raise UnsupportedImage("no pictures")
                except _BROKEN as e:
                    if self.first <= 0 <= self.last:
                        yield _row(video, 0, np.zeros((0, 0), np.float32), None, str(e) or type(e).__name__)

    def _pictures(self, data: Seeking, path: str, places: list[tuple[int, int]] | None) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
        """Number, picture and description of each; those beyond the bounds are counted, not read."""
        if _kind(path) == "tiff":
            order, wide, _ = stacks.tiff_start(data)
            for n, at in places if places is not None else enumerate(stacks.tiff_places(data), 1):
                tags = stacks.tiff_tags(data, order, wide, at) if self.first <= n <= self.last else None
                yield (n, None, None) if tags is None else (n, stacks.tiff_array(data, tags), tags.get(270, [None])[0])
        else:
            where = nd2.chunk_map(data)
            of = nd2.layout(data, where)
            for n, at in places if places is not None else enumerate(nd2.places(where), 1):
                yield n, nd2.picture(data, of, at) if self.first <= n <= self.last else None, None


def _row(video: str, n: int, a: np.ndarray, said: str | None, error: str | None) -> pa.RecordBatch:
    i32 = lambda v: pa.array([v], pa.int32())
    pixels = pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), pa.array(np.ascontiguousarray(a, np.float32).ravel()))
    height, width = a.shape
    return pa.RecordBatch.from_arrays([pa.array([video]), i32(n), i32(height), i32(width), pixels, pa.array([said], pa.string()), pa.array([error], pa.string())], ["video", "frame", "height", "width", "pixels", "description", "error"])


class PushingReader(StackReader):
    """Takes bounds of frame, and equality of video, from the query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self._takes(f):
                yield f

    def _takes(self, f: Filter) -> bool:
        if getattr(f, "attribute", None) == ("video",) and isinstance(f, EqualTo | In):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.videos = names if self.videos is None else self.videos & names
            return True
        if getattr(f, "attribute", None) == ("frame",) and isinstance(getattr(f, "value", None), int):
            v = f.value
            low = {GreaterThan: v + 1, GreaterThanOrEqual: v, EqualTo: v}.get(type(f))
            high = {LessThan: v - 1, LessThanOrEqual: v, EqualTo: v}.get(type(f))
            if low is not None or high is not None:
                self.first, self.last = max(self.first, low if low is not None else self.first), min(self.last, high if high is not None else self.last)
                return True
        return False


class AllStacks(DataSource):
    """Takes a range of frames from options alone."""

    @classmethod
    def name(cls) -> str:
        return "stack_all"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return StackReader(dict(self.options))


class Stacks(AllStacks):
    """Takes bounds of frames from the query too."""

    @classmethod
    def name(cls) -> str:
        return "stack"

    def reader(self, schema) -> DataSourceReader:
        return PushingReader(dict(self.options))


def read_large(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """stacks.read_images for files of any size, split within files; only frames from first to last are read, if given.

    Without bounds, files that can't be read have a row of frame 0 whose error says why, as there.
    """
    spark.dataSource.register(AllStacks)
    reader = spark.read.format("stack_all").option("splitBytes", split_bytes)
    if first is not None:
        reader = reader.option("firstFrame", first)
    if last is not None:
        reader = reader.option("lastFrame", last)
    return reader.load(path)
