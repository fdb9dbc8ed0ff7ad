"""Walkers over the bytes of one file or packet. Plain Python, called inside the data sources.

A walker yields (message_type, body, error): error is null for a message, else ``unknown_type``,
``size_mismatch`` or ``truncated``, with what bytes there are.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import BinaryIO

from tidebook.functions.layout import DEFAULT, Venue

Frame = tuple[str | None, bytes, str | None]


def frames(data: bytes | memoryview, venue: Venue = DEFAULT) -> Iterator[Frame]:
    """Length-prefixed frames. Empty ones are skipped; a longer body than its type's is kept whole;
    the walk ends at a truncated tail."""
    at, end = 0, len(data)
    view = memoryview(data)
    while at < end:
        if at + 2 > end:
            yield None, bytes(view[at:]), "truncated"
            return
        size = view[at] << 8 | view[at + 1]
        at += 2
        if not size:
            continue
        if at + size > end:
            yield None, bytes(view[at:]), "truncated"
            return
        body = bytes(view[at : at + size])
        at += size
        code = chr(body[0])
        need = venue.size_of(code)
        yield code, body, "unknown_type" if need is None else "size_mismatch" if size < need else None


def iterator_frames(data: bytes, venue: Venue = DEFAULT) -> Iterator[Frame]:
    """As a file iterator reads: raises on an unknown type, leaves out an incomplete tail and stops
    after the system event C. Empty frames are skipped."""
    for code, body, error in frames(data, venue):
        if error == "truncated":
            return
        if error:
            raise ValueError(f"{error}: {code!r}")
        yield code, body, None
        if code == "S" and body[11:12] == b"C":
            return


@dataclass(frozen=True)
class Packet:
    """One transport packet: what it said of its session, and its frames."""

    session: str | None
    first: int | None
    count: int
    kind: str
    frames: tuple[Frame, ...] = ()
    at: int = 0  # where it begins in its file


MOLD_HEADER = 20
END_OF_SESSION = 0xFFFF


def mold_packet(data: bytes, venue: Venue = DEFAULT) -> Packet | None:
    """A downstream packet; None for one shorter than its header. The count does not bound the
    blocks, and a truncated last block is left out."""
    if len(data) < MOLD_HEADER:
        return None
    first, count = struct.unpack_from(">QH", data, 10)
    kind = "end" if count == END_OF_SESSION else "heartbeat" if not count else "data"
    blocks = tuple(f for f in frames(memoryview(data)[MOLD_HEADER:], venue) if f[2] != "truncated")
    return Packet(data[:10].decode("latin-1").rstrip(" \x00"), first, count, kind, blocks)


@dataclass
class SoupStream:
    """A session stream fed in pieces of any size; what is incomplete waits for the next piece."""

    venue: Venue = DEFAULT
    session: str = ""
    next_sequence: int = 1
    rest: bytes = b""

    def feed(self, data: bytes) -> list[Packet]:
        buf, at, out = self.rest + data, 0, []
        while at + 2 <= len(buf):
            size = buf[at] << 8 | buf[at + 1]
            if at + 2 + size > len(buf):
                break
            if size:
                out.append(self._packet(buf[at + 2 : at + 2 + size]))
            at += 2 + size
        self.rest = buf[at:]
        return out

    def _packet(self, p: bytes) -> Packet:
        kind, payload = chr(p[0]), p[1:]
        if kind == "A" and len(payload) >= 30:
            self.session = payload[:10].decode("latin-1").strip(" ")
            digits = ""
            for c in payload[10:30].decode("latin-1").lstrip(" "):
                if not c.isdigit():
                    break
                digits += c
            self.next_sequence = int(digits or 0) or 1
            return Packet(self.session, self.next_sequence, 0, kind)
        if kind in "SU":
            body = tuple(f for f in frames(len(payload).to_bytes(2, "big") + payload, self.venue) if f[2] != "truncated") if payload else ()
            first = self.next_sequence if kind == "S" else None
            if kind == "S":
                self.next_sequence += 1
            return Packet(self.session, first, int(kind == "S"), kind, body)
        return Packet(self.session, None, 0, kind)


# Fixed values of the capture formats.
PCAP_MAGICS = {0xA1B2C3D4: "<", 0xA1B23C4D: "<", 0xD4C3B2A1: ">", 0x4D3CB2A1: ">"}
PCAPNG = 0x0A0D0D0A
ETHERNET, RAW_IP, LINUX_SLL = 1, 101, 113
VLAN, IPV4, IPV6, UDP = 0x8100, 0x0800, 0x86DD, 17


def capture_kind(data: bytes) -> str | None:
    """pcap, pcapng or None, by the first four bytes."""
    if len(data) < 4:
        return None
    magic = int.from_bytes(data[:4], "little")
    return "pcap" if magic in PCAP_MAGICS else "pcapng" if magic == PCAPNG else None


def captured(f: BinaryIO) -> Iterator[tuple[int, bytes, int]]:
    """(link type, frame, its offset) of each record of a capture, read one after the other; a truncated
    last record is left out."""
    head = f.read(24)
    kind = capture_kind(head)
    if kind == "pcap" and len(head) == 24:
        order = PCAP_MAGICS[int.from_bytes(head[:4], "little")]
        (link,) = struct.unpack_from(order + "I", head, 20)
        at = 24
        while len(record := f.read(16)) == 16:
            (size,) = struct.unpack_from(order + "I", record, 8)
            frame = f.read(size)
            if len(frame) < size:
                return
            yield link, frame, at + 16
            at += 16 + size
    elif kind == "pcapng":
        yield from _captured_ng(f, head)


def _captured_ng(f: BinaryIO, head: bytes) -> Iterator[tuple[int, bytes, int]]:
    order, links, at, ahead = "<", [], 0, head

    def take(n: int) -> bytes:
        nonlocal ahead
        if len(ahead) < n:
            ahead += f.read(n - len(ahead))
        out, ahead = ahead[:n], ahead[n:]
        return out

    while len(start := take(12)) == 12:
        if start[:4] == b"\n\r\r\n":  # a section header tells its own byte order
            order = "<" if start[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            links = []
        block, size = struct.unpack_from(order + "II", start)
        if size < 12:
            return
        data = start[8:] + take(size - 12)
        if len(data) < size - 8:
            return
        if block == 1:
            links.append(struct.unpack_from(order + "H", data)[0])
        elif block == 6 and size >= 32:
            face, _, _, length = struct.unpack_from(order + "IIII", data)
            if face < len(links) and 28 + length <= size:
                yield links[face], data[20 : 20 + length], at + 28
        elif block == 3 and size >= 16 and links:
            length = min(struct.unpack_from(order + "I", data)[0], size - 16)
            yield links[0], data[4 : 4 + length], at + 12
        at += size


# What stands before an internet packet in the link types read here, as (bytes, place of
# the protocol number or None); and of each version of the packet where its protocol stands.
LINKS = {ETHERNET: (14, 12), LINUX_SLL: (16, None), RAW_IP: (0, None)}
PROTOCOL = {4: 9, 6: 6}


def datagram(link: int, frame: bytes) -> tuple[int, bytes] | None:
    """(destination port, payload) of a UDP packet over IPv4 or IPv6 without extensions, else None."""
    if link not in LINKS:
        return None
    at, place = LINKS[link]
    if place is not None:
        while frame[place : place + 2] == VLAN.to_bytes(2, "big") and len(frame) >= at + 4:
            at, place = at + 4, place + 4
        if frame[place : place + 2] not in (IPV4.to_bytes(2, "big"), IPV6.to_bytes(2, "big")):
            return None
    packet = frame[at:]
    version = packet[0] >> 4 if packet else 0
    head = {4: (packet[0] & 15) * 4, 6: 40}.get(version, 0) if packet else 0
    if head < 20 or len(packet) < head + 8 or packet[PROTOCOL[version]] != UDP:
        return None
    port, size = struct.unpack_from(">HH", packet, head + 2)
    # a length that does not even cover its own header says nothing
    return port, packet[head + 8 : head + size if size >= 8 else None]


#: Bytes of a stream taken at once.
PIECE = 1 << 20


@dataclass
class Walk:
    """One file of any format as rows (packet, session, first, count, kind, frame...)."""

    fmt: str
    ports: frozenset[int] | None = None
    venue: Venue = field(default_factory=lambda: DEFAULT)

    def packets(self, source: bytes | BinaryIO) -> Iterator[Packet]:
        """The packets of bytes or of an open file, which is read in pieces; a raw file is one packet."""
        f = io.BytesIO(source) if isinstance(source, bytes) else source
        fmt = self.fmt
        if fmt == "auto":
            fmt = "pcap" if capture_kind(f.read(4)) else "raw"
            f.seek(0)
        if fmt == "raw":
            yield Packet(None, None, 0, "raw", tuple(frames(f.read(), self.venue)))
        elif fmt == "soup":
            yield from self._soup(f)
        elif fmt == "mold":  # two-byte lengths before each packet
            at = 0
            while len(size := f.read(2)) == 2:
                n = int.from_bytes(size, "big")
                p = mold_packet(f.read(n), self.venue)
                if p:
                    yield replace(p, at=at)
                at += 2 + n
        else:
            for link, frame, at in captured(f):
                d = datagram(link, frame)
                if d and (self.ports is None or d[0] in self.ports):
                    p = mold_packet(d[1], self.venue)
                    if p:
                        yield replace(p, at=at)

    def _soup(self, f: BinaryIO) -> Iterator[Packet]:
        soup, at = SoupStream(self.venue), 0
        while piece := f.read(PIECE):
            for p in soup.feed(piece):
                yield replace(p, at=at)
                at += 1  # a packet is three bytes at least: places grow, as offsets would
