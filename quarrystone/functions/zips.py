"""Zip directories and entries, from anything that can be read at a place.

Only what is asked for is read: the end of the file, the directory, an entry's head and payload.  Split archives, the
64-bit format, directories that are too long and entry counts that do not fit are refused, as None.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from struct import Struct, error
from typing import NamedTuple

from quarrystone.limits import LIMITS, Limits

#: The records of the format: end of the directory, an entry in the directory, an entry's head.
END, ENTRY, HEAD = Struct("<4s4H2IH"), Struct("<4s6H3I5H2I"), Struct("<4s5H3I2H")
END_SIGN, ENTRY_SIGN, HEAD_SIGN = b"PK\5\6", b"PK\1\2", b"PK\3\4"
FULL_16, FULL_32 = 0xFFFF, 0xFFFFFFFF
#: Read at most so many bytes from a place on.
ReadAt = Callable[[int, int], bytes]


class Entry(NamedTuple):
    number: int
    name: str
    flags: int
    method: int
    crc: int
    compressed: int
    size: int
    offset: int
    mode: int

    @property
    def is_regular(self) -> bool:
        return not self.name.endswith("/") and self.mode & 0o170000 in (0, 0o100000)


def decoded_name(raw: bytes, flags: int) -> str:
    """UTF-8 if flagged and valid, GB18030 if that fits, else code page 437."""
    for encoding in ("utf-8", "gb18030") if flags & 0x800 else ("gb18030",):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("cp437")


def _end(read: ReadAt, size: int) -> tuple | None:
    """The end record whose comment reaches to the file's end."""
    tail = read(max(0, size - END.size - FULL_16), END.size + FULL_16)
    at = tail.rfind(END_SIGN)
    while at >= 0:
        if at + END.size <= len(tail):
            record = END.unpack_from(tail, at)
            if at + END.size + record[7] == len(tail):
                return record
        at = tail.rfind(END_SIGN, 0, at + len(END_SIGN) - 1)
    return None


def directory(read: ReadAt, size: int, limits: Limits = LIMITS) -> list[Entry] | None:
    if size > limits.archive_bytes or size < END.size or (record := _end(read, size)) is None:
        return None
    _, disk, first_disk, _, count, length, begin, _ = record
    if disk or first_disk or count == FULL_16 or FULL_32 in (length, begin):
        return None
    if count > limits.archive_entries or length > limits.zip_directory_bytes or begin + length > size:
        return None
    data, at, found = read(begin, length), 0, []
    while at < length:
        try:
            sign, made, _, flags, method, _, _, crc, compressed, own, n_name, n_extra, n_comment, _, _, outside, offset = ENTRY.unpack_from(data, at)
        except error:
            return None
        name = data[at + ENTRY.size : at + ENTRY.size + n_name]
        at += ENTRY.size + n_name + n_extra + n_comment
        if sign != ENTRY_SIGN or at > length or len(found) == count or FULL_32 in (compressed, own, offset) or offset >= size:
            return None
        found.append(Entry(len(found), decoded_name(name, flags), flags, method, crc, compressed, own, offset, outside >> 16 if made >> 8 == 3 else 0))
    return found if len(found) == count else None


def payload(read: ReadAt, size: int, offset: int, method: int, flags: int, crc: int, compressed: int, most: int = LIMITS.file_bytes) -> tuple[bytes | None, str | None]:
    """(content, error code) of an entry, inflated to at most ``most`` bytes."""
    head = read(offset, HEAD.size)
    if len(head) < HEAD.size or head[:4] != HEAD_SIGN or flags & 1 or method not in (0, 8):
        return None, "CORRUPT_FILE"
    *_, n_name, n_extra = HEAD.unpack(head)
    begin = offset + HEAD.size + n_name + n_extra
    if begin + compressed > size:
        return None, "CORRUPT_FILE"
    if method == 0 and compressed > most:
        return None, "FILE_TOO_LARGE"
    data = read(begin, compressed)
    if method == 8:
        inflate = zlib.decompressobj(-15)
        try:
            data = inflate.decompress(data, most + 1)
        except zlib.error:
            return None, "CORRUPT_FILE"
        if len(data) <= most and not inflate.eof:
            return None, "CORRUPT_FILE"
    if len(data) > most:
        return None, "FILE_TOO_LARGE"
    return (data, None) if zlib.crc32(data) == crc else (None, "CORRUPT_FILE")


def of_bytes(data: bytes) -> ReadAt:
    return lambda at, n: data[at : at + n]
