"""The feed as a Spark data source: ``spark.read.format("tidefeed")``, batch and streaming, and its sink.

Options: ``path`` (files, comma-separated, globs allowed); ``framing`` raw, mold, soup, pcap or auto;
``mode`` permissive (errors are rows), dropmalformed (errors are left out) or failfast; ``unknown``
keep or error; ``stop_at_end`` (leave a file after the system event C); ``dst_port`` for captures;
``venue_table`` (the registry of another venue, see ``layout``); ``splitBytes``, the bytes of a raw file a
task reads (128 MB, or less so that all ``cores`` have some, as Spark splits its own files); ``session_date`` (yyyy-MM-dd) of all files, or ``date_format`` (as ``%m%d%Y``) of the
date in each file's name. ``emit`` says what rows are:

* ``frames``: FRAMES, or those of its columns that ``columns`` names;
* ``messages``: decoded in the task that reads them: ``columns`` (seq by default), message_type, and
  ``fields`` (comma-separated, all by default), null where a type lacks one;
* ``packets``: PACKETS of a transport;
* ``ranges``: per task of a raw file where its first frame begins and where what follows its last does.

``seq`` is where a frame begins in its file; for frames of a packet it is where the packet begins plus
the frame's number in it. Files of the same session date follow each other by name: each
starts at FILE_ROOM times its number. So ``session_date`` and ``seq`` order a feed of any number of files
and days, and a file's rows are the same whether one task reads it or many.

A raw stream has no marks to split at: a task starting inside a file goes BACK bytes, finds the first
offset from which SYNC frames follow that are exactly as long as their types say, and walks to its range;
where there is none before the range, it goes back twice as far, at last to the start of the file.
Files are read in pieces of CHUNK bytes, so a task holds a piece and not a file. ``stop_at_end`` and
``packets`` need what came before and read a file in one task.
"""

from __future__ import annotations

import glob
import io
import os
import re
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

from tidebook.functions.layout import DEFAULT, Field, Venue
from tidebook.sources.decode import Chunk, field_places, field_type, needs, walk
from tidebook.sources.framing import Walk, capture_kind, frames

FRAMES = "file string, session_date date, seq bigint, message_type string, body binary, error string, packet bigint, session string, packet_first bigint"
PACKETS = "file string, packet bigint, session string, first_seq bigint, msg_count int, kind string, n_frames int"
RANGES = "file string, start bigint, first bigint, after bigint"
#: Frames in a row that must fit for a task to trust its start.
SYNC = 16
#: So far before its range a task sets out at first.
BACK = 65_536
#: Bytes of a file held at once.
CHUNK = 2 << 20
#: Bytes of a raw file a task reads at most unless told otherwise, and at least where there are more cores.
SPLIT, LEAST_SPLIT = 128 << 20, 4 << 20
#: Seqs between the files of a session.
FILE_ROOM = 1 << 44
#: Rows a batch of what comes in packets.
BATCH = 20_000

_ARROW = {"string": pa.string(), "date": pa.date32(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _files(options: dict) -> list[str]:
    out: list[str] = []
    for p in options["path"].split(","):
        p = p.strip().removeprefix("file://").removeprefix("file:")
        if "://" in p:
            out.append(p)
        elif os.path.isdir(p):
            out += sorted(x for x in glob.glob(os.path.join(p, "*")) if not os.path.basename(x).startswith(("_", ".")))
        else:
            out += sorted(glob.glob(p)) or [p]
    return out


def _open(path: str):
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def _size(path: str) -> int:
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.get_file_info(inner).size
    return os.path.getsize(path)


def _exists(path: str) -> bool:
    return "://" in path or os.path.exists(path)


def _flag(options: dict, name: str) -> bool:
    return options.get(name, "false").lower() == "true"


def _venue(options: dict) -> Venue:
    table = options.get("venue_table")
    return Venue("given", table) if table else DEFAULT


@dataclass
class Range(InputPartition):
    """Bytes of a file; ``base`` is added to offsets, ``day`` counts from 1970."""

    path: str
    start: int
    end: int
    split: bool = False
    base: int = 0
    day: int | None = None


def session_day(path: str, options: dict) -> int | None:
    """The day of a file by ``session_date`` or ``date_format``; None without either or a match."""
    if options.get("session_date"):
        return (date.fromisoformat(options["session_date"]) - date(1970, 1, 1)).days
    form = options.get("date_format")
    if not form:
        return None
    digits = re.sub(r"%(.)", lambda m: r"\d{4}" if m[1] == "Y" else r"\d{3}" if m[1] == "j" else r"\d{2}", re.sub(r"([.+*?^$()\[\]{}|\\])", r"\\\1", form))
    for m in re.finditer(f"(?=({digits}))", os.path.basename(path)):
        try:
            return (datetime.strptime(m[1], form).date() - date(1970, 1, 1)).days
        except ValueError:
            continue
    return None


def placed(paths: Sequence[str], options: dict) -> list[tuple[str, int | None, int]]:
    """(path, day, base) of each file."""
    count: dict[int | None, int] = {}
    out = []
    for p in paths:
        day = session_day(p, options)
        out.append((p, day, count.get(day, 0) * FILE_ROOM))
        count[day] = count.get(day, 0) + 1
    return out


def synced(data: bytes, at: int, last: int | None = None, venue: Venue = DEFAULT) -> int | None:
    """The first offset from ``at`` on, up to ``last``, where SYNC frames of known types and exact
    sizes follow; None if there is none. Empty frames between them do not count."""
    need = needs(venue).tolist()
    for begin in range(at, len(data) if last is None else min(len(data), last + 1)):
        pos, n = begin, 0
        while n < SYNC and pos + 3 <= len(data):
            size = data[pos] << 8 | data[pos + 1]
            if n and not size:
                pos += 2
                continue
            if not size or need[data[pos + 2]] != size or pos + 2 + size > len(data):
                break
            pos += 2 + size
            n += 1
        if n == SYNC:
            return begin
    return None


def frame_at(f, start: int, end: int, venue: Venue) -> int:
    """A frame's start at or before ``start``, from which walking leads into the range."""
    back = BACK
    while start:
        begin = max(0, start - back)
        if begin == 0:
            break
        f.seek(begin)
        at = synced(f.read(min(start + BACK, end) - begin), 0, start - begin, venue)
        if at is not None:
            return begin + at
        back *= 2
    return 0


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.emit = options.get("emit", "frames")
        self.venue = _venue(options)
        self.types: set[str] | None = None
        self.columns, self.fields = _columns(options, self.venue)
        self.schema = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in _ddl(options).split(", "))])
        self.mode = options.get("mode", "permissive").lower()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("message_type",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("message_type",):
                self._only(set(f.value))
            yield f  # Spark filters again, so rows with null types are its affair

    def _only(self, values: set) -> None:
        self.types = values if self.types is None else self.types & values

    def partitions(self) -> Sequence[InputPartition]:
        files = placed(_files(self.options), self.options)
        share = sum(_size(p) for p, _, _ in files) // int(self.options.get("cores", 1))
        step = int(self.options.get("splitbytes", min(SPLIT, max(LEAST_SPLIT, share))))
        whole = _flag(self.options, "stop_at_end") or self.emit == "packets" or self.options.get("framing", "auto") not in ("raw", "auto")
        out: list[InputPartition] = []
        for p, day, base in files:
            size = _size(p)
            if whole or self._is_capture(p):
                out.append(Range(p, 0, size, False, base, day))
            else:
                out += [Range(p, s, min(s + step, size), True, base, day) for s in range(0, max(size, 1), step)]
        return out

    def _is_capture(self, path: str) -> bool:
        if self.options.get("framing", "auto") != "auto":
            return False
        with _open(path) as f:
            return capture_kind(f.read(4)) is not None

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with _open(part.path) as f:
            if self.emit == "ranges":
                yield from self._range(f, part)
            elif part.split or self.options.get("framing", "auto") == "raw" and self.emit != "packets":
                yield from self._raw(f, part)
            else:
                yield from self._packets(f, part)

    # raw streams -------------------------------------------------------------------------------

    def _chunks(self, f, start: int, limit: int | None = None) -> Iterator[tuple[Chunk, int]]:
        """Pieces of the file from a frame's start on, and where in the file each ends; the last one
        without frames if the file ends inside a frame. ``limit``: the file ends there."""
        f.seek(start)
        rest, base, need = b"", start, needs(self.venue)
        while True:
            room = CHUNK if limit is None else min(CHUNK, limit - base - len(rest))
            piece = f.read(room) if room > 0 else b""
            data = rest + piece
            starts, at = walk(data)
            if starts or at:
                yield Chunk(data, starts, base, need), base + at
            rest, base = data[at:], base + at
            if not piece:
                if rest:
                    yield Chunk(rest, [], base, need), base + len(rest)
                return

    def _raw(self, f, part: Range, by_end: bool = False) -> Iterator[pa.RecordBatch]:
        """Frames that begin in the range; with ``by_end`` those that end in it, in a file that ends there."""
        begin = frame_at(f, part.start, part.end if by_end else _size(part.path), self.venue) if part.start else 0
        stop = _flag(self.options, "stop_at_end")
        for chunk, after in self._chunks(f, begin, part.end if by_end else None):
            if not len(chunk):
                if len(chunk.data) and not by_end and after - len(chunk.data) >= part.start and self._wanted_error("truncated", after):
                    yield self._single(part, after - len(chunk.data), None, chunk.data.tobytes(), "truncated")
                continue
            at = chunk.starts + chunk.base
            if by_end:
                ends = at + 2 + chunk.sizes
                chunk.keep((ends > part.start) & (ends <= part.end))
            else:
                chunk.keep((at >= part.start) & (at < part.end))
            over = False
            if stop:
                closing = np.flatnonzero((chunk.codes == ord("S")) & (chunk.sizes >= 12) & (chunk.data[np.minimum(chunk.starts + 13, len(chunk.data) - 1)] == ord("C")))
                if len(closing):
                    over = True
                    chunk.keep(np.arange(len(chunk)) <= closing[0])
            yield from self._batches(chunk, part)
            if over or not by_end and after >= part.end:
                return

    def _wanted_error(self, error: str, at: int) -> bool:
        if self.mode == "failfast":
            raise ValueError(f"{error} at {at}")
        return self.mode != "dropmalformed" and self.types is None

    def _batches(self, chunk: Chunk, part: Range) -> Iterator[pa.RecordBatch]:
        bad = chunk.error > 0
        if bad.any():
            if self.mode == "failfast" or self.options.get("unknown", "keep") == "error" and (chunk.error == 1).any():
                first = int(np.flatnonzero(bad)[0])
                raise ValueError(f"{part.path}: {('unknown_type', 'size_mismatch')[chunk.error[first] - 1]} at {chunk.starts[first] + chunk.base}")
            if self.mode == "dropmalformed":
                chunk.keep(~bad)
        if self.types is not None:
            chosen = np.zeros(256, bool)
            chosen[[ord(t) for t in self.types if t and len(t) == 1 and ord(t) < 256]] = True
            chunk.keep(chosen[chunk.codes])
        n = len(chunk)
        if not n:
            return
        made = []
        for f in self.schema:
            if f.name in self.fields:
                made.append(chunk.field(self.fields[f.name]))
            elif f.name == "file":
                made.append(pa.repeat(pa.scalar(part.path), n))
            elif f.name == "session_date":
                made.append(pa.repeat(pa.scalar(part.day, pa.int32()), n).cast(pa.date32()))
            elif f.name == "seq":
                made.append(pa.array(chunk.starts + (chunk.base + part.base)))
            elif f.name in ("packet", "session", "packet_first"):
                made.append(pa.nulls(n, f.type))
            else:
                made.append(chunk.column(f.name))
        yield pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(made, self.schema)], schema=self.schema)

    def _single(self, part: Range, at: int, code: str | None, body: bytes, error: str | None) -> pa.RecordBatch:
        return self._of_rows([self._row(part, at + part.base, (code, body, error), None, None, None)])

    def _range(self, f, part: Range) -> Iterator[pa.RecordBatch]:
        first = after = None
        begin = frame_at(f, part.start, _size(part.path), self.venue) if part.start else 0
        for chunk, end in self._chunks(f, begin):
            at = np.append(chunk.starts + chunk.base, end)
            inside = at[at >= part.start]
            if first is None and len(inside):
                first = int(inside[0])
            beyond = at[at >= part.end]
            after = int(beyond[0]) if len(beyond) else end
            if len(beyond):
                break
        yield pa.RecordBatch.from_pylist([{"file": part.path, "start": part.start, "first": first, "after": after}], schema=self.schema)

    # packets -----------------------------------------------------------------------------------

    def _row(self, part: Range, seq: int, frame: tuple, packet: int | None, session: str | None, first: int | None) -> dict:
        code, body, error = frame
        row = {"file": part.path, "session_date": part.day, "seq": seq, "message_type": code, "body": body, "error": error, "packet": packet, "session": session, "packet_first": first}
        for name, places in self.fields.items():
            row[name] = None
            for c, f in places:
                if (not c or c == code) and len(body) >= f.offset + f.size:
                    raw = body[f.offset : f.offset + f.size]
                    row[name] = (raw.decode("latin-1") if f.size == 1 else raw.decode("latin-1").rstrip(" \0")) if f.kind == "a" else int.from_bytes(raw, "big", signed=f.size == 8)
        return row

    def _of_rows(self, rows: list[dict]) -> pa.RecordBatch:
        cols = [pa.array([r[f.name] for r in rows], pa.int32() if f.name == "session_date" else f.type) for f in self.schema]
        return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, self.schema)], schema=self.schema)

    def _packets(self, f, part: Range) -> Iterator[pa.RecordBatch]:
        ports = self.options.get("dst_port")
        form = self.options.get("framing", "auto")
        if form == "auto" and not self._is_capture(part.path):
            form = "raw"
        if form == "raw" and self.emit == "packets":
            n = sum(len(c) for c, _ in self._chunks(f, 0))
            yield pa.RecordBatch.from_pylist([{"file": part.path, "packet": 0, "msg_count": 0, "kind": "raw", "n_frames": n}], schema=self.schema)
            return
        if form == "raw":
            yield from self._raw(f, part)
            return
        out: list[dict] = []
        stop = _flag(self.options, "stop_at_end")
        buffered = f if isinstance(f, io.BufferedIOBase) else io.BufferedReader(f, CHUNK)
        for n, p in enumerate(Walk(form, frozenset(map(int, ports.split(","))) if ports else None, self.venue).packets(buffered)):
            if self.emit == "packets":
                out.append({"file": part.path, "packet": n, "session": p.session, "first_seq": _signed(p.first), "msg_count": p.count, "kind": p.kind, "n_frames": len(p.frames)})
            else:
                for i, frame in enumerate(p.frames):
                    if self._takes(frame, part, p.at + i):
                        out.append(self._row(part, part.base + p.at + i, frame, n, p.session, _signed(p.first)))
                    if stop and frame[0] == "S" and frame[1][11:12] == b"C":
                        yield self._of_rows(out)
                        return
            if len(out) >= BATCH:
                yield self._of_rows(out)
                out = []
        if out:
            yield self._of_rows(out)

    def _takes(self, frame: tuple, part: Range, at: int) -> bool:
        code, _, error = frame
        if error and (self.mode == "failfast" or error == "unknown_type" and self.options.get("unknown", "keep") == "error"):
            raise ValueError(f"{part.path}: {error} at {at}")
        return not (error and self.mode == "dropmalformed") and (self.types is None or code in self.types)


def _signed(x: int | None) -> int | None:
    return None if x is None else x - (1 << 64) if x >= 1 << 63 else x


def _columns(options: dict, venue: Venue) -> tuple[list[str], dict[str, list[tuple[str, Field]]]]:
    """Columns of a frame that are wanted, and the fields to decode."""
    known = [x.split()[0] for x in FRAMES.split(", ")]
    emit, named = options.get("emit", "frames"), options.get("columns")
    chosen = [c.strip() for c in named.split(",") if c.strip()] if named is not None else known if emit == "frames" else ["seq"]
    if set(chosen) - set(known):
        raise ValueError(f"unknown columns {sorted(set(chosen) - set(known))}")
    if emit != "messages":
        return chosen, {}
    every = field_places(venue)
    wanted = [x.strip() for x in options["fields"].split(",") if x.strip()] if options.get("fields") is not None else list(every)
    if set(wanted) - set(every):
        raise ValueError(f"unknown fields {sorted(set(wanted) - set(every))}")
    return [*(c for c in chosen if c != "message_type"), "message_type"], {n: every[n] for n in wanted}


def _ddl(options: dict) -> str:
    emit = options.get("emit", "frames")
    if emit in ("packets", "ranges"):
        return PACKETS if emit == "packets" else RANGES
    columns, fields = _columns(options, _venue(options))
    types = dict(x.split() for x in FRAMES.split(", "))
    decoded = [f"{n} {field_type(p)}" for n, p in fields.items()]
    return ", ".join([*(f"{c} {types[c]}" for c in columns), *decoded])


class GrowingReader(DataSourceStreamReader):
    """Raw files that grow: an offset is, per file, its size in bytes. A batch has the frames that end
    in what was added, wherever they began; a task finds the first by itself."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: _size(p) for p in _files(self.options) if _exists(p)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        step = int(self.options.get("splitbytes", SPLIT))
        where = {p: (day, base) for p, day, base in placed(_files(self.options), self.options)}
        return [Range(p, s, min(s + step, e), True, where.get(p, (None, 0))[1], where.get(p, (None, 0))[0]) for p, e in end.items() for s in range(start.get(p, 0), e, step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with _open(part.path) as f:
            yield from FeedReader(self.options)._raw(f, part, by_end=True)


class ReplayReader(SimpleDataSourceStreamReader):
    """One raw file at the pace of its own clock, ``speed`` times as fast; at or below 0 at once. The
    first message is due immediately, one whose time steps back is not held. An offset is a place in the
    file with the clock there, so nothing is held between batches, of which each has LIMIT rows at most."""

    LIMIT = 50_000

    def __init__(self, options: dict):
        self.path, self.speed = _files(options)[0], float(options.get("speed", 1))
        self.began: float | None = None

    def initialOffset(self) -> dict:
        return {"at": 0, "first": None, "due": 0.0}

    def _walk(self, at: int, until: int | None) -> Iterator[tuple[int, int, tuple]]:
        """(start, end, frame) of the whole frames from ``at`` on."""
        with _open(self.path) as f:
            f.seek(at)
            rest = b""
            while piece := f.read(CHUNK if until is None else min(CHUNK, until - at - len(rest))):
                data = rest + piece
                starts, end = walk(data)
                for s in starts:
                    n = data[s] << 8 | data[s + 1]
                    yield at + s, at + s + 2 + n, next(frames(memoryview(data)[s : s + 2 + n]))
                rest, at = data[end:], at + end

    def _row(self, at: int, frame: tuple) -> tuple:
        return (self.path, None, at, *frame, None, None, None)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = time.time()
        if self.began is None:
            self.began = now - start["due"]
        at, first, due, rows = start["at"], start["first"], start["due"], []
        for begin, end, frame in self._walk(at, None):
            if not frame[2]:
                clock = int.from_bytes(frame[1][5:11], "big")
                first = clock if first is None else first
                next_due = max(due, (clock - first) / 1e9 / self.speed) if self.speed > 0 else 0.0
                if next_due > now - self.began or len(rows) >= self.LIMIT:
                    break
                due = next_due
                rows.append(self._row(begin, frame))
            at = end
        return iter(rows), {"at": at, "first": first, "due": due}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return (self._row(begin, frame) for begin, _, frame in self._walk(start["at"], end["at"]) if not frame[2])


@dataclass
class Part(WriterCommitMessage):
    aside: str
    path: str


class FeedWriter(DataSourceArrowWriter):
    """Bodies as raw files, one a task, named in the order of the tasks; they appear when all are whole."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex[:12]
        self.bare = options.get("framing", "raw") == "none"

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = self._system()
        system.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}.bin"
        aside = f"{root}/.{self.job}-{task.taskAttemptId()}-{name}"
        with system.open_output_stream(aside) as out:
            for b in iterator:
                for body in b.column("body").to_pylist():
                    if body is not None:
                        out.write(body if self.bare else len(body).to_bytes(2, "big") + body)
        return Part(aside, f"{root}/{name}")

    def commit(self, messages: list[Part | None]) -> None:
        system, root = self._system()
        from pyarrow import fs

        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    system.delete_file(old.path)
        for m in messages:
            if m:
                system.move(m.aside, m.path)

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = self._system()
        for m in messages:
            if m:
                system.delete_file(m.aside)


def _lower(options: dict) -> dict:
    return {k.lower(): v for k, v in options.items()}


class TideFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidefeed"

    def schema(self) -> str:
        return _ddl(_lower(self.options))

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(_lower(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingReader(_lower(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FeedWriter(_lower(self.options), overwrite)


class TideReplay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidereplay"

    def schema(self) -> str:
        return FRAMES

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return ReplayReader(_lower(self.options))


def register(spark) -> None:
    """Make both sources known to a session."""
    spark.dataSource.register(TideFeed)
    spark.dataSource.register(TideReplay)


def read_frames(spark, path: str, venue: Venue | None = None, **options):
    """Frames of ``path``, or what ``emit`` says; see the options above."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("tidefeed").option("path", path).option("cores", spark.sparkContext.defaultParallelism)
    if venue:
        r = r.option("venue_table", venue.table)
    for k, v in options.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else v)
    return r.load()


def read_messages(spark, path: str, fields: Sequence[str] | None = None, columns: Sequence[str] = ("session_date", "seq"), **options):
    """Messages decoded where they are read: ``columns``, message_type and ``fields`` (default all)."""
    more = {} if fields is None else {"fields": ",".join(fields)}
    return read_frames(spark, path, emit="messages", columns=",".join(columns), **more, **options)


def split_faults(spark, path: str, **options):
    """Where neighbouring tasks of a split read do not meet: none, unless a task mistook its start."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = read_frames(spark, path, emit="ranges", **options)
    following = F.lead("first").over(Window.partitionBy("file").orderBy("start"))
    return rows.withColumn("next_first", following).where("next_first <> after")


def diagnostics(frames_df):
    """Frames per error; messages without one count under ``ok``."""
    from pyspark.sql import functions as F

    return frames_df.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def write_stream(frames_df, path: str, order: Sequence[str] = ("seq",), mode: str = "append", parts: int | None = None, framed: bool = True) -> None:
    """Frames back to raw files in the folder ``path``: rows are ranged by ``order``, every task writes
    one file, ``parts`` of them or as many as Spark sees fit, and the files follow each other by name.
    Rows without a body are left out. Without ``framed`` bodies have no length before them."""
    register(frames_df.sparkSession)
    ranged = frames_df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).select("body")
    ranged.write.format("tidefeed").option("path", path).option("framing", "raw" if framed else "none").mode(mode).save()
