"""What can be told of an image file without decoding it: turns of JPEG files, soundness of WebP files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Image data is no part of what is looked at in a JPEG file, so this much of its head is enough.
HEAD = 1 << 17
_ORIENTATION = 0x0112


def jpeg_turn(content: bytes) -> int:
    """The orientation (1 to 8) that the file's Exif segment asks for; 1 where there is none."""
    if content[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack_from(">H", content, at + 2)[0]
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return _tag(content[at + 10 : at + 2 + size])
        at += 2 + size
    return 1


def _tag(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        first = struct.unpack_from(f"{order}I", tiff, 4)[0]
        for k in range(struct.unpack_from(f"{order}H", tiff, first)[0]):
            tag, kind, n = struct.unpack_from(f"{order}HHI", tiff, first + 2 + 12 * k)
            if tag == _ORIENTATION and kind == 3 and n == 1:
                value = struct.unpack_from(f"{order}H", tiff, first + 10 + 12 * k)[0]
                return value if 1 <= value <= 8 else 1
    except struct.error:  # a broken segment asks for nothing
        pass
    return 1


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(content):
        size = struct.unpack_from("<I", content, at + 4)[0]
        if at + 8 + size > len(content):
            raise ValueError("a chunk is cut off")
        yield content[at : at + 4], content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def webp_size(content: bytes) -> tuple[int, int] | None:
    """Width and height of a WebP file whose container and first frame header are sound; None for others."""
    if content[:4] != b"RIFF" or content[8:12] != b"WEBP" or struct.unpack_from("<I", content, 4)[0] + 8 > len(content) + 1:
        return None
    try:
        for kind, body in _chunks(content):
            if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
                width, height = struct.unpack_from("<HH", body, 6)
                return width & 0x3FFF, height & 0x3FFF
            if kind == b"VP8L" and body[:1] == b"\x2f":
                bits = struct.unpack_from("<I", body, 1)[0]
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            if kind == b"ANMF" and len(body) >= 16:
                return tuple(int.from_bytes(body[k : k + 3], "little") + 1 for k in (6, 9))
    except (ValueError, struct.error):
        pass
    return None
