"""ZIP packages with stored members: written with or without ZIP64 records, and read by ranges.

The reader asks for byte ranges only: the end of the package, its central directory, the local
header of a member, and then whatever range of the member the caller wants.
"""

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR = b"PK\x06\x06", b"PK\x06\x07"
_STORED, _DATE = 0, 0x21  # 1980-01-01
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

ReadRange = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    crc: int
    header: int  # offset of the local header


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A package of stored members; ZIP64 records are used if asked for or if a number needs them."""
    out, central = [], []
    at = 0
    for name, data in members:
        label, crc = name.encode(), zlib.crc32(data)
        long = zip64 or len(data) >= _FULL32 or at >= _FULL32
        version, small = (45, _FULL32) if long else (20, len(data))
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if long else b""
        common = struct.pack("<HHHHHIIIHH", version, 0x800, _STORED, 0, _DATE, crc, small, small, len(label), len(extra))
        out += [_LOCAL, common, label, extra, data]
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if long else b""
        common = struct.pack("<HHHHHIIIHH", version, 0x800, _STORED, 0, _DATE, crc, small, small, len(label), len(extra))
        central.append(b"".join([
            _CENTRAL, struct.pack("<H", version), common, struct.pack("<HHHII", 0, 0, 0, 0, _FULL32 if long else at), label, extra,
        ]))
        at = sum(map(len, out[-5:])) + at
    directory = b"".join(central)
    n, size = len(central), len(directory)
    tail = b""
    if zip64 or n >= _FULL16 or at >= _FULL32 or size >= _FULL32:
        tail = _END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at)
        tail += _LOCATOR + struct.pack("<IQI", 0, at + size, 1)
        end = struct.pack("<HHHHIIH", 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0)
    else:
        end = struct.pack("<HHHHIIH", 0, 0, n, n, size, at, 0)
    return b"".join([*out, directory, tail, _END, end])


def read_directory(read: ReadRange, length: int) -> list[Member]:
    """The members by the central directory; ``read`` gives the bytes from one offset to another."""
    start = max(0, length - 22 - _FULL16)
    tail = read(start, length)
    at = tail.rfind(_END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP central directory")
    n, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if n == _FULL16 or size == _FULL32 or offset == _FULL32:
        locator = read(max(0, start + at - 20), start + at)
        if locator[:4] == _LOCATOR:
            (where,) = struct.unpack_from("<Q", locator, 8)
            record = read(where, where + 56)
            if record[:4] != _END64:
                raise ValueError("no ZIP64 end of central directory where the locator says")
            n, size, offset = struct.unpack_from("<QQQ", record, 32)
    directory, members, at = read(offset, offset + size), [], 0
    for _ in range(n):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("damaged ZIP central directory")
        method, crc, packed, plain = struct.unpack_from("<H4xIII", directory, at + 10)
        label, extra, comment = struct.unpack_from("<HHH", directory, at + 28)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + label].decode()
        wide = _zip64_fields(directory[at + 46 + label : at + 46 + label + extra])
        # The extra field holds, in this order, only the numbers that didn't fit.
        plain = wide.pop(0) if plain == _FULL32 and wide else plain
        packed = wide.pop(0) if packed == _FULL32 and wide else packed
        header = wide.pop(0) if header == _FULL32 and wide else header
        members.append(Member(name, method, packed, crc, header))
        at += 46 + label + extra + comment
    return members


def _zip64_fields(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return [int.from_bytes(extra[at + 4 + i : at + 12 + i], "little") for i in range(0, size - 7, 8)]
        at += 4 + size
    return []


def member_start(read: ReadRange, member: Member) -> int:
    """Offset of a stored member's first byte."""
    if member.method != _STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    header = read(member.header, member.header + 30)
    if header[:4] != _LOCAL:
        raise ValueError(f"no local header of {member.name}")
    label, extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + label + extra
