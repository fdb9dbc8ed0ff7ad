"""Frames of a chunk of bytes as Arrow columns, by NumPy; nothing here runs once a frame but ``walk``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidebook.functions.layout import Field, Venue

ERRORS = ("unknown_type", "size_mismatch")


def field_places(venue: Venue) -> dict[str, list[tuple[str, Field]]]:
    """Every field by name with the types that have it; "" stands for all types, in the header."""
    out: dict[str, list[tuple[str, Field]]] = {f.name: [("", f)] for f in next(iter(venue.types.values())).fields[1:4]}
    for t in venue.types.values():
        for f in t.body:
            out.setdefault(f.name, []).append((t.code, f))
    return out


def field_type(places: list[tuple[str, Field]]) -> str:
    f = places[0][1]
    return "string" if f.kind == "a" else "int" if f.size == 2 else "bigint"


def walk(data: bytes, at: int = 0) -> tuple[list[int], int]:
    """Where the whole frames of ``data`` start, empty ones left out, and where what is left begins."""
    starts, end = [], len(data)
    add = starts.append
    while at + 2 <= end:
        size = data[at] << 8 | data[at + 1]
        after = at + 2 + size
        if after > end:
            break
        if size:
            add(at)
        at = after
    return starts, at


def needs(venue: Venue) -> np.ndarray:
    """The size of each type's body by its code, 0 for a code without a type."""
    out = np.zeros(256, np.int64)
    for code, t in venue.types.items():
        out[ord(code)] = t.wire_size
    return out


def _strings(data: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Latin-1 texts of ``sizes`` bytes end to end in ``data``."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    if len(data) and data.max() >= 128:
        raw = data.tobytes()
        texts = [raw[a:b].decode("latin-1") for a, b in zip(offsets, offsets[1:])]
        return pa.array(texts, pa.string(), mask=None if valid is None else ~valid)
    mask = None if valid is None else pa.array(valid).buffers()[1]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)), mask)


def _bodies(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts + 2] += 1
    edge[starts + 2 + sizes] -= 1
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    kept = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


class Chunk:
    """The frames of one piece of a file. ``keep`` narrows them; columns are made on demand."""

    def __init__(self, data: bytes, starts: list[int], base: int, need: np.ndarray):
        self.data, self.base = np.frombuffer(data, np.uint8), base
        self.starts = np.array(starts, np.int64)
        self.need = need
        self._measure()

    def _measure(self) -> None:
        s = self.starts
        self.sizes = self.data[s].astype(np.int64) << 8 | self.data[s + 1]
        self.codes = self.data[s + 2]
        need = self.need[self.codes]
        self.error = np.where(need == 0, 1, np.where(self.sizes < need, 2, 0)).astype(np.int8)

    def keep(self, which: np.ndarray) -> None:
        if not which.all():
            self.starts = self.starts[which]
            self._measure()

    def __len__(self) -> int:
        return len(self.starts)

    def column(self, name: str) -> pa.Array:
        n = len(self)
        if name == "seq":
            return pa.array(self.starts + self.base)
        if name == "message_type":
            return _strings(self.codes, np.ones(n, np.int32))
        if name == "body":
            return _bodies(self.data, self.starts, self.sizes)
        if name == "error":
            return pa.array([None, *ERRORS], pa.string()).take(pa.array(self.error)) if self.error.any() else pa.nulls(n, pa.string())
        raise KeyError(name)

    @classmethod
    def of_bodies(cls, bodies: pa.Array, types: pa.Array) -> Chunk:
        """The same over a column of bodies; a null one is empty and has no field."""
        self = cls.__new__(cls)
        bodies = bodies.cast(pa.binary()) if bodies.type != pa.binary() else bodies
        offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1] if len(bodies) else np.zeros(1, np.int32)
        values = bodies.buffers()[2] if len(bodies) else None
        self.data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
        self.starts, self.sizes = offsets[:-1].astype(np.int64) - 2, np.diff(offsets).astype(np.int64)
        known = types.dictionary_encode(null_encoding="encode")
        code = np.array([ord(t) if t is not None and len(t) == 1 and ord(t) < 256 else 0 for t in known.dictionary.to_pylist()], np.int64)
        self.codes = code[known.indices.to_numpy(zero_copy_only=False)] if len(types) else np.empty(0, np.int64)
        return self

    def field(self, places: list[tuple[str, Field]]) -> pa.Array:
        """A field by the types that have it; null for other types and where a body is too short."""
        n, size, kind = len(self), places[0][1].size, places[0][1].kind
        size = max(f.size for _, f in places)
        valid = np.zeros(n, bool)
        if kind == "a":
            data = np.full((n, size), 32, np.uint8)
        else:
            data = np.zeros(n, np.uint64)
        for code, f in places:
            # "" stands for every type: a field of the header
            rows = np.flatnonzero((self.codes == ord(code) if code else True) & (self.sizes >= f.offset + f.size))
            if not len(rows):
                continue
            valid[rows] = True
            at = self.starts[rows] + 2 + f.offset
            if kind == "a":
                data[rows[:, None], np.arange(f.size)] = self.data[at[:, None] + np.arange(f.size)]
                continue
            value = np.zeros(len(rows), np.uint64)
            for i in range(f.size):
                value = value << np.uint64(8) | self.data[at + i]
            data[rows] = value
        if kind != "a":
            out = pa.array(data.view(np.int64), mask=~valid)
            return out.cast(pa.int32()) if size == 2 else out
        if size == 1:
            return _strings(data[valid].ravel(), valid.astype(np.int32), valid)
        inked = (data != 32) & (data != 0)
        length = np.where(inked.any(1) & valid, size - inked[:, ::-1].argmax(1), 0).astype(np.int32)
        return _strings(data[np.arange(size) < length[:, None]], length, valid)
