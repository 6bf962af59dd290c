"""Decoding limits and errors. An error is a value of a row, never a failed task."""

from __future__ import annotations

import struct
from dataclasses import dataclass

# The display text of each error.
TEXT = {
    "NotRecognized": "not recognized",
    "InvalidContainer": "invalid container",
    "UnsupportedFormat": "unsupported format",
    "UnsupportedFeature": "unsupported feature",
    "ResourceLimit": "resource limit exceeded",
    "Truncated": "truncated input",
    "InvalidOffset": "invalid offset",
    "InvalidTag": "invalid tag",
    "InvalidGeometry": "invalid geometry",
    "Allocation": "allocation failed",
}


class DecodeError(Exception):
    """kind is one of TEXT's names."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(detail or TEXT[kind])
        self.kind = kind


@dataclass(frozen=True)
class Limits:
    max_input_bytes: int = 512 << 20
    max_ifds: int = 64
    max_ifd_entries: int = 4096
    max_value_bytes: int = 256 << 10
    max_profile_gain_table_bytes: int = 16 << 20
    max_width: int = 65536
    max_height: int = 65536
    max_pixels: int = 50 << 20
    max_frame_samples: int = 160 << 20
    max_decoded_samples: int = 160 << 20
    max_metadata_bytes: int = 64 << 20
    max_codec_bytes: int = 1 << 30


def guarded(call, *args):
    """(result, None), or (None, name of the error) whatever the bytes hold."""
    try:
        return call(*args), None
    except DecodeError as e:
        return None, e.kind
    except (IndexError, KeyError, TypeError, ValueError, OverflowError, MemoryError, struct.error):
        return None, "InvalidContainer"
