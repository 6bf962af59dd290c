"""EXIF of a JPEG preview, and the light source in it."""

from __future__ import annotations

import struct


def exif(jpeg: bytes) -> bytes | None:
    """The payload of the first EXIF segment before the scan; None without one, ValueError if the markers are broken."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while True:
        if at >= len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("expected a marker")
        while at < len(jpeg) and jpeg[at] == 0xFF:
            at += 1
        if at >= len(jpeg):
            raise ValueError("truncated")
        mark, at = jpeg[at], at + 1
        if mark == 0x01:
            continue
        if mark in (0xDA, 0xD9):
            return None
        if mark == 0 or 0xD0 <= mark <= 0xD8:
            raise ValueError("unexpected marker")
        size = int.from_bytes(jpeg[at : at + 2], "big")
        if size < 2 or at + size > len(jpeg):
            raise ValueError("truncated segment")
        body, at = jpeg[at + 2 : at + size], at + size
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            return body[6:]


def light_source(jpeg: bytes) -> int | None:
    """The LightSource value of the EXIF directory; None where any step is missing."""
    try:
        data = exif(jpeg)
        if data is None:
            return None
        order = {b"II": "<", b"MM": ">"}[data[:2]]

        def entry(offset: int, tag: int, kind: int) -> int | None:
            (count,) = struct.unpack_from(order + "H", data, offset)
            if count > 1024:
                raise ValueError("too many entries")
            for i in range(count):
                t, k, n = struct.unpack_from(order + "HHI", data, offset + 2 + 12 * i)
                if t == tag:
                    if k != kind or n != 1:
                        raise ValueError("unexpected tag type")
                    return struct.unpack_from(order + ("H" if kind == 3 else "I"), data, offset + 10 + 12 * i)[0]
            return None

        magic, first = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            return None
        directory = entry(first, 0x8769, 4)
        return None if directory is None else entry(directory, 0x9208, 3)
    except (ValueError, KeyError, struct.error):
        return None
