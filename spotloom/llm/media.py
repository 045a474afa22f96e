"""Media columns: ISO base media files read box by box, without decoding any sample.

`index_media` walks the nested boxes of each file, decodes the sample tables of each track and returns codec,
duration and the byte ranges of key frames. `wrap_samples` makes such a file from plain bytes: a track of 8-bit grey
pictures 64 pixels wide. `sample_bytes` reads the samples of a track back by way of its tables.

Samples of movie fragments (moof, traf, trun, with the defaults of trex) follow those of the sample tables.

Defined cases: a null file has no tracks and error "empty"; a damaged file has error set and no tracks; boxes of unknown
type are skipped; a box longer than what holds it is an error, and so are tables that name more bytes, samples or chunks
than the file can hold, before anything is allocated for them. Files of any length are read in place, and nothing but
the tables is copied. Equal files give equal rows, in any number; an empty table has none. A null text is stored like an
empty one. Other columns of the input, also ones that differ from the wanted only in case, do no harm.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spotloom.llm import frames

WIDTH, HEIGHT = 64, 64
#: Pictures between key frames, and in a chunk.
GROUP = 8
TIMESCALE, TICKS = 25_000, 1_000

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}


class Damaged(ValueError):
    """The bytes are no well-formed media file."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, first and last place of the body of each box between start and end."""
    at = start
    while at < end:
        if end - at < 8:
            raise Damaged(f"{end - at} bytes left over at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise Damaged(f"box at {at} is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if at + size > end or body > at + size:
            raise Damaged(f"box {kind!r} at {at} says it has {size} bytes")
        yield kind, body, at + size
        at += size


@dataclass
class Track:
    track_id: int = 0
    kind: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    chunk_map: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    chunk_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray | None = None
    #: Runs of samples in fragments: places, sizes, whether each decodes by itself.
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _in_tables(self) -> np.ndarray:
        """The place of each sample of the tables, from chunk places, samples a chunk and sizes."""
        n, chunks = len(self.sizes), len(self.chunk_at)
        if not n:
            return np.zeros(0, np.int64)
        first = self.chunk_map[:, 0] - 1
        if not len(first) or first[0] != 0 or np.any(np.diff(first) <= 0) or first[-1] >= max(chunks, 1):
            raise Damaged("the sample-to-chunk table is out of order")
        ends = np.cumsum(np.repeat(self.chunk_map[:, 1], np.diff(np.append(first, max(chunks, 1))))[:chunks])
        if not len(ends) or ends[-1] != n:
            raise Damaged("chunks do not hold as many samples as there are sizes")
        chunk = np.searchsorted(ends, np.arange(n), "right")
        run = np.cumsum(self.sizes) - self.sizes
        starts = np.concatenate([[0], ends[:-1]])[chunk]
        return self.chunk_at[chunk] + run - run[starts]

    def samples(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of all samples in a file of a length, those of tables first."""
        places = np.concatenate([self._in_tables(), *(p for p, _, _ in self.runs)])
        sizes = np.concatenate([self.sizes, *(n for _, n, _ in self.runs)])
        if len(places) and (places.min() < 0 or (places + sizes).max() > length):
            raise Damaged("a sample lies outside the file")
        return places, sizes

    def keyframes(self) -> np.ndarray:
        """The numbers, from 0, of the samples that decode by themselves; all, where no table says otherwise."""
        n, out = len(self.sizes), []
        keys = np.arange(n) if self.sync is None else self.sync - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise Damaged("a key frame is no sample")
        for _, sizes, by_itself in self.runs:
            out.append(n + np.flatnonzero(by_itself))
            n += len(sizes)
        return np.concatenate([keys, *out]).astype(np.int64)


def _table(data: memoryview, at: int, end: int, n: int, kind: str, columns: int) -> np.ndarray:
    width = np.dtype(kind).itemsize * columns
    if n * width > end - at:
        raise Damaged(f"a table of {n} rows does not fit in {end - at} bytes")
    return np.frombuffer(data[at : at + n * width], kind).astype(np.int64).reshape(n, columns)


def _leaf(kind: bytes, data: memoryview, at: int, end: int, track: Track) -> None:
    if end - at < 8:
        raise Damaged(f"box {kind!r} is too short")
    version = data[at]
    if kind == b"tkhd":
        (track.track_id,) = struct.unpack_from(">I", data, at + (20 if version else 12))
    elif kind == b"mdhd":
        track.timescale, track.duration = struct.unpack_from(">IQ" if version else ">II", data, at + (20 if version else 12))
    elif kind == b"hdlr":
        track.kind = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd":
        (n,) = struct.unpack_from(">I", data, at + 4)
        if n:
            entry = next(boxes(data, at + 8, end))
            track.codec = entry[0].decode("latin-1")
            if track.kind == "vide" and entry[2] - entry[1] >= 28:
                track.width, track.height = struct.unpack_from(">HH", data, entry[1] + 24)
    elif kind == b"stts":
        track.times = _table(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4", 2)
    elif kind == b"stsz":
        one, n = struct.unpack_from(">II", data, at + 4)
        if one * n > len(data):
            raise Damaged(f"{n} samples of {one} bytes are more than the file")
        track.sizes = np.full(n, one, np.int64) if one else _table(data, at + 12, end, n, ">u4", 1)[:, 0]
    elif kind == b"stz2":
        field_bits, n = struct.unpack_from(">II", data, at + 4)
        if field_bits & 255 == 4:
            pairs = _table(data, at + 12, end, (n + 1) // 2, ">u1", 1)[:, 0]
            track.sizes = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
        else:
            track.sizes = _table(data, at + 12, end, n, ">u2" if field_bits & 255 == 16 else ">u1", 1)[:, 0]
    elif kind == b"stsc":
        track.chunk_map = _table(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4", 3)
    elif kind in (b"stco", b"co64"):
        track.chunk_at = _table(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
    elif kind == b"stss":
        track.sync = _table(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], ">u4", 1)[:, 0]


LEAVES = {b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stsz", b"stz2", b"stsc", b"stco", b"co64", b"stss"}

#: The bit of a sample's flags that says it does not decode by itself.
_NEEDS_OTHERS = 0x10000


@dataclass
class _Fragment:
    """A track's part of a movie fragment: defaults for samples, and where the next run begins."""

    track: Track
    at: int
    duration: int
    size: int
    flags: int


def _traf(data: memoryview, at: int, end: int, moof: int, last: int | None, tracks: dict[int, Track], defaults: dict[int, tuple]) -> int:
    """Adds a traf box's runs to its track; returns where its data end."""
    part = None
    for kind, a, b in boxes(data, at, end):
        if kind == b"tfhd":
            flags, number = struct.unpack_from(">II", data, a)
            if number not in tracks:
                raise Damaged(f"a fragment of track {number}, which is not there")
            duration, size, sample = defaults.get(number, (0, 0, 0))
            begin, a = moof if flags & 0x20000 or last is None else last, a + 8
            if flags & 1:
                (begin,) = struct.unpack_from(">Q", data, a)
                a += 8
            given = {}
            for bit in (0x2, 0x8, 0x10, 0x20):
                if flags & bit:
                    (given[bit],) = struct.unpack_from(">I", data, a)
                    a += 4
            part = _Fragment(tracks[number], begin, given.get(0x8, duration), given.get(0x10, size), given.get(0x20, sample))
            base = begin
        elif kind == b"trun":
            if part is None:
                raise Damaged("a run of samples without a track")
            part.at = _run(data, a, b, part, base)
    return part.at if part else (last or moof)


def _run(data: memoryview, a: int, b: int, part: _Fragment, base: int) -> int:
    """Adds a trun box's samples; returns where they end."""
    flags, n = struct.unpack_from(">II", data, a)
    a += 8
    begin, first = part.at, None
    if flags & 0x1:
        begin, a = base + struct.unpack_from(">i", data, a)[0], a + 4
    if flags & 0x4:
        (first,) = struct.unpack_from(">I", data, a)
        a += 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if n > len(data) or not flags & 0x200 and n * part.size > len(data):
        raise Damaged(f"a run of {n} samples is more than the file")
    rows = _table(data, a, b, n, ">u4", len(fields)) if fields else np.zeros((n, 0), np.int64)
    column = lambda bit, default: rows[:, fields.index(bit)] if bit in fields else np.full(n, default, np.int64)
    sizes, kinds = column(0x200, part.size), column(0x400, part.flags).copy()
    if n and first is not None:
        kinds[0] = first
    ends = begin + np.cumsum(sizes)
    part.track.runs.append((ends - sizes, sizes, kinds & _NEEDS_OTHERS == 0))
    part.track.duration += int(column(0x100, part.duration).sum())
    return int(ends[-1]) if n else begin


def read_tracks(content: bytes | memoryview) -> tuple[str, list[Track]]:
    """The brand and the tracks of a file. Raises Damaged."""
    data, brand, tracks, defaults = memoryview(content), "", [], {}

    def walk(start: int, end: int, track: Track | None, depth: int) -> None:
        nonlocal brand
        if depth > 16:
            raise Damaged("boxes nest too deep")
        begin, last = start, None
        for kind, at, stop in boxes(data, start, end):
            if kind == b"ftyp" and stop - at >= 4:
                brand = bytes(data[at : at + 4]).decode("latin-1")
            elif kind == b"trak":
                tracks.append(Track())
                walk(at, stop, tracks[-1], depth + 1)
            elif kind == b"trex":
                _, number, _, *given = struct.unpack_from(">6I", data, at)
                defaults[number] = tuple(given)
            elif kind == b"moof":
                last = None
                for inner, a, b in boxes(data, at, stop):
                    if inner == b"traf":
                        last = _traf(data, a, b, begin, last, {t.track_id: t for t in tracks}, defaults)
            elif kind in CONTAINERS:
                walk(at, stop, track, depth + 1)
            elif kind in LEAVES and track is not None:
                _leaf(kind, data, at, stop, track)
            begin = stop

    try:
        walk(0, len(data), None, 0)
    except struct.error as e:
        raise Damaged(str(e)) from e
    return brand, tracks


def sample_bytes(content: bytes | memoryview, track: Track) -> bytes:
    """All samples of a track, in order."""
    data = memoryview(content)
    places, sizes = track.samples(len(data))
    # Samples that follow one another are copied as one run.
    ends = places + sizes
    new = np.flatnonzero(np.append(True, places[1:] != ends[:-1])) if len(places) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(places)) - 1
    return b"".join(bytes(data[a:b]) for a, b in zip(places[new].tolist(), ends[last].tolist(), strict=True))


def wrap_samples(payload: bytes) -> bytes:
    """A file with one track of 8-bit grey pictures, 64 pixels wide, whose rows are the payload (a multiple of 64)."""
    picture = WIDTH * HEIGHT
    n = -(-len(payload) // picture)
    sizes = [picture] * (n - 1) + [len(payload) - picture * (n - 1)]
    chunks = -(-n // GROUP)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    time = n * TICKS
    runs = [(1, GROUP, 1)] if n % GROUP == 0 or chunks == 1 else [(1, GROUP, 1), (chunks, n % GROUP, 1)]
    if chunks == 1:
        runs = [(1, n, 1)]

    def moov(start: int) -> bytes:
        places = [start + i * GROUP * picture for i in range(chunks)]
        stbl = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, n, TICKS)),
            full(b"stss", 0, 0, struct.pack(f">I{chunks}I", chunks, *range(1, n + 1, GROUP))),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", 0, 0, struct.pack(f">II{n}I", 0, n, *sizes)),
            full(b"co64", 0, 0, struct.pack(f">I{chunks}Q", chunks, *places)),
        )
        minf = box(b"minf", full(b"vmhd", 0, 1, bytes(8)), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, time, 0x55C4, 0)), full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(13)), minf)
        trak = box(b"trak", full(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, time), bytes(16), matrix, struct.pack(">II", WIDTH << 16, HEIGHT << 16)), mdia)
        return box(b"moov", full(b"mvhd", 1, 0, struct.pack(">QQIQIH", 0, 0, TIMESCALE, time, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), trak)

    head = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return ftyp + moov(head) + box(b"mdat", payload)


def describe(content: bytes | None) -> tuple[str | None, list[dict]]:
    """An error or None, and a row for each track."""
    if not content:
        return "empty", []
    try:
        brand, tracks = read_tracks(content)
        out = []
        for t in tracks:
            (places, sizes), keys = t.samples(len(content)), t.keyframes()
            out.append(
                {
                    "track": t.track_id, "kind": t.kind, "codec": t.codec.strip(), "brand": brand, "width": t.width, "height": t.height,
                    "samples": len(sizes), "duration_s": t.duration / t.timescale if t.timescale else 0.0,
                    "keyframes": [{"start": int(places[k]), "end": int(places[k] + sizes[k])} for k in keys],
                }
            )
    except Damaged as e:
        return str(e), []
    return None, out


_KEYS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TRACKS = pa.list_(
    pa.struct(
        [("track", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("brand", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int64()), ("duration_s", pa.float64()), ("keyframes", _KEYS)]
    )
)
_TRACKS_SQL = "array<struct<track bigint, kind string, codec string, brand string, width int, height int, samples bigint, duration_s double, keyframes array<struct<start: bigint, end: bigint>>>>"


def index_media(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """A row for each file: id, error (null if none) and its tracks, each with its key frames' byte ranges."""
    df = frames.pick(files, id=id_col, content=content_col)
    kind = df.schema["id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [describe(x.as_buffer() if x.is_valid else None) for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], _TRACKS)], ["id", "error", "tracks"])

    return frames.map_batches(df, one, f"id {kind}, error string, tracks {_TRACKS_SQL}").withColumnRenamed("id", id_col)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a media file: id, n_bytes (of its UTF-8) and media. A null text counts as empty."""
    df = frames.pick(docs, id=id_col, text=text_col)
    kind = df.schema["id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x.as_py().encode() if x.is_valid else b"" for x in batch.column(1)]
        media = [wrap_samples(x + bytes(-len(x) % 64 or (0 if x else 64))) for x in raw]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return frames.map_batches(df, one, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def features(content: bytes) -> tuple[bytes, str]:
    """The samples of the first track of a file, and what its tables say, as text."""
    _, tracks = read_tracks(content)
    t = tracks[0]
    (places, sizes), keys = t.samples(len(content)), t.keyframes()
    ends = places[keys] + sizes[keys]
    said = ",".join(f"{a}-{b}" for a, b in zip(places[keys].tolist(), ends.tolist(), strict=True))
    return sample_bytes(content, t), f"codec={t.codec.strip()};size={t.width}x{t.height};samples={len(sizes)};duration={t.duration / t.timescale:.3f};keyframes={said}"
