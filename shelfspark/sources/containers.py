"""MP4 containers: tags, duration, cover and header faults.

Boxes nest by byte counts that only a walk can follow, so this is the one reader in
Python; it takes Arrow batches of paths, seeks from box to box and reads the movie box alone,
never the audio. ``read_containers`` takes whole small files as ``binaryFile`` rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, tags map<string,string>, duration_ms long, cover binary, header_ms long, sample_ms long, problem string"
# Tag boxes and the names of their values.
TAG_NAMES = {b"\xa9nam": "title", b"\xa9alb": "album", b"\xa9ART": "artist", b"aART": "album_artist", b"\xa9wrt": "composer", b"\xa9day": "date", b"\xa9gen": "genre", b"\xa9cmt": "comment", b"desc": "description", b"ldes": "synopsis", b"cprt": "copyright", b"\xa9nrt": "narrator", b"\xa9mvn": "movement_name", b"\xa9mvi": "movement"}
_PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"ilst"}
DEPTH = 12
MOST_HEADER = 256 << 20
WRAP = 1 << 32


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first and last byte of the body) of the boxes in a range; stops at a size that can't be."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _walk(data: bytes, start: int, end: int, path: tuple[bytes, ...], found: list) -> None:
    for kind, a, b in boxes(data, start, end):
        found.append(((*path, kind), a, b))
        if len(path) >= DEPTH:
            continue
        if kind in _PARENTS or path and path[-1] == b"ilst":
            _walk(data, a, b, (*path, kind), found)
        elif kind == b"meta":
            _walk(data, a + 4, b, (*path, kind), found)


def _time(data: bytes, a: int, b: int) -> tuple[int, int]:
    """(duration in ticks, ticks a second) of a movie or media header."""
    if b - a >= 32 and data[a] == 1:
        scale, ticks = struct.unpack_from(">IQ", data, a + 20)
    elif b - a >= 20:
        scale, ticks = struct.unpack_from(">II", data, a + 12)
    else:
        return 0, 0
    return ticks, scale


def read(data: bytes) -> dict:
    """Tags by name, durations of the header and of the sample table, cover, and what is wrong."""
    found: list = []
    _walk(data, 0, len(data), (), found)
    tags: dict[str, str] = {}
    cover, header, sample, scale, media, problem = None, 0, 0, 0, 0, None
    names = {p[:-1]: data[a + 4 : b] for p, a, b in found if p[-1] == b"name"}
    for path, a, b in found:
        if path[-1] == b"mvhd":
            ticks, per = _time(data, a, b)
            header = ticks * 1000 // per if per else 0
        elif path[-1] == b"mdhd":
            media, scale = _time(data, a, b)
        elif path[-1] == b"stts" and b - a >= 8:
            (n,) = struct.unpack_from(">I", data, a + 4)
            n = min(n, (b - a - 8) // 8)
            ticks = sum(c * d for c, d in struct.iter_unpack(">II", data[a + 8 : a + 8 + 8 * n]))
            sample = max(sample, ticks * 1000 // scale if scale else 0)
            if scale and WRAP <= ticks != media and ticks % WRAP == media:
                problem = "header duration is wrong"  # it kept the low 32 bits; any other difference is an edit list's
        elif path[-1] == b"data" and len(path) > 1 and b - a >= 8:
            owner, body = path[-2], data[a + 8 : b]
            if owner == b"covr":
                cover = cover or body
            else:
                name = names.get(path[:-1], b"").decode("utf-8", "replace") if owner == b"----" else TAG_NAMES.get(owner)
                if name and body:
                    tags.setdefault(name, body.decode("utf-8", "replace"))
    if not any(p == (b"moov",) for p, _, _ in found):
        problem = "no movie box"
    return {"tags": tags, "duration_ms": sample if problem == "header duration is wrong" else header or sample, "cover": cover, "header_ms": header, "sample_ms": sample, "problem": problem}


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _with_duration(body: bytes, between: int, ticks: int) -> bytes:
    """A header box's body with a 64-bit duration; ``between`` bytes stand between the times and the duration."""
    if body[0] == 1:
        at = 20 + between
        return body[:at] + struct.pack(">Q", ticks) + body[at + 8 :]
    made, changed = struct.unpack_from(">II", body, 4)
    return b"\1" + body[1:4] + struct.pack(">QQ", made, changed) + body[12 : 12 + between] + struct.pack(">Q", ticks) + body[16 + between :]


def repaired(movie: bytes, start: int = 0) -> bytes | None:
    """A movie box whose wrapped durations are written out in 64 bits; null where none wrapped.

    ``start`` is where the box stands in its file: chunks behind it move by as much as it grows. An error where a moved chunk's place
    no longer fits in its 32 bits.
    """
    nested = _PARENTS - {b"udta", b"ilst"}
    header = {}
    for kind, a, b in boxes(movie, 8, len(movie)):
        if kind == b"mvhd":
            header["scale"], header["ticks"] = _time(movie, a, b)[::-1]

    def track(a: int, b: int) -> tuple[int, int]:
        """The true length of a wrapped track in its own ticks and scale, (0, 0) for another."""
        found: list = []
        _walk(movie, a, b, (), found)
        media = scale = ticks = 0
        for path, x, y in found:
            if path[-1] == b"mdhd":
                media, scale = _time(movie, x, y)
            elif path[-1] == b"stts" and y - x >= 8:
                n = min(struct.unpack_from(">I", movie, x + 4)[0], (y - x - 8) // 8)
                ticks += sum(c * d for c, d in struct.iter_unpack(">II", movie[x + 8 : x + 8 + 8 * n]))
        return (ticks, scale) if scale and WRAP <= ticks != media and ticks % WRAP == media else (0, 0)

    tracks = [track(a, b) for kind, a, b in boxes(movie, 8, len(movie)) if kind == b"trak"]
    if not any(t for t, _ in tracks):
        return None
    per = header.get("scale", 0)
    longest = max([header.get("ticks", 0), *[t * per // s for t, s in tracks if t]])

    def built(a: int, b: int, fix: tuple[int, int], shift: int) -> bytes:
        out, n = [], 0
        for kind, x, y in boxes(movie, a, b):
            body = movie[x:y]
            if kind == b"trak":
                body, n = built(x, y, tracks[n], shift), n + 1
            elif kind in nested:
                body = built(x, y, fix, shift)
            elif kind == b"mvhd" and longest != header["ticks"]:
                body = _with_duration(body, 4, longest)
            elif kind == b"mdhd" and fix[0]:
                body = _with_duration(body, 4, fix[0])
            elif kind == b"tkhd" and fix[0]:
                body = _with_duration(body, 8, fix[0] * per // fix[1])
            elif kind in (b"stco", b"co64") and shift:
                code = ">I" if kind == b"stco" else ">Q"
                offsets = [o[0] + shift * (o[0] >= start + len(movie)) for o in struct.iter_unpack(code, body[8:])]
                if code == ">I" and max(offsets, default=0) >= WRAP:
                    raise ValueError("a chunk offset no longer fits in 32 bits")
                body = body[:8] + b"".join(struct.pack(code, o) for o in offsets)
            out.append(_box(kind, body))
        return b"".join(out)

    grown = len(built(8, len(movie), (0, 0), 0)) + 8 - len(movie)
    return _box(b"moov", built(8, len(movie), (0, 0), grown))


def movie_box(f) -> bytes:
    """The movie box of a seekable file, with its header; other boxes are passed over."""
    f.seek(0, 2)
    end, at = f.tell(), 0
    while at + 8 <= end:
        f.seek(at)
        head = f.read(16)
        size, kind = struct.unpack_from(">I4s", head)
        if size == 1 and len(head) == 16:
            (size,) = struct.unpack_from(">Q", head, 8)
        elif size == 0:
            size = end - at
        if size < 8 or at + size > end:
            return b""
        if kind == b"moov":
            if size > MOST_HEADER:
                return b""
            f.seek(at)
            return f.read(size)
        at += size
    return b""


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(name)


_KINDS = [pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]


def _rows(paths: list, found: list[dict]) -> pa.RecordBatch:
    columns = [paths, [list(r["tags"].items()) for r in found], *[[r[k] for r in found] for k in ("duration_ms", "cover", "header_ms", "sample_ms", "problem")]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], ["path", "tags", "duration_ms", "cover", "header_ms", "sample_ms", "problem"])


def read_paths(files: DataFrame, opener=_open) -> DataFrame:
    """The same for a table of paths: each file's movie box is read by seeks. ``opener`` gives a seekable file for a path; one that cannot be opened has a problem."""

    def one(path: str) -> dict:
        try:
            with opener(path) as f:
                return read(movie_box(f))
        except (OSError, ValueError, pa.ArrowException) as e:
            return {"tags": {}, "duration_ms": 0, "cover": None, "header_ms": 0, "sample_ms": 0, "problem": f"cannot be read: {type(e).__name__}"}

    def run(batches):
        for batch in batches:
            names = batch.column("path").to_pylist()
            for a in range(0, len(names), 64):
                yield _rows(names[a : a + 64], [one(p) for p in names[a : a + 64]])

    return files.select("path").mapInArrow(run, SCHEMA)


def read_containers(files: DataFrame) -> DataFrame:
    """A row for each ``binaryFile`` row (path, content), for files of a few megabytes."""

    def run(batches):
        for batch in batches:
            yield _rows(batch.column("path").to_pylist(), [read(x.as_py() or b"") for x in batch.column("content")])

    return files.select("path", "content").mapInArrow(run, SCHEMA)

