"""Huffman differences of the X3F format: bit-serial, so decoded by a state loop over bytes rather than a plan."""

from __future__ import annotations

from photonlake.sources.errors import DecodeError


class Codebook:
    """(length, left-aligned code) byte pairs up to a zero length; the place of a pair is the category of its differences."""

    def __init__(self, data: bytes, offset: int = 0):
        self.lookup: list[tuple[int, int] | None] = [None] * 256
        self.least, category = 99, 0
        while True:
            if offset + 2 > len(data):
                raise DecodeError("Truncated", "codebook ends early")
            length, code = data[offset], data[offset + 1]
            offset += 2
            if not length:
                break
            if category > 16 or length > 8 or code & ((1 << (8 - length)) - 1):
                raise DecodeError("InvalidContainer", "invalid Huffman code")
            span = range(code, code + (1 << (8 - length)))
            if any(self.lookup[i] is not None for i in span):
                raise DecodeError("InvalidContainer", "overlapping Huffman codes")
            for i in span:
                self.lookup[i] = (length, category)
            self.least = min(self.least, length + category)
            category += 1
        if not category:
            raise DecodeError("InvalidContainer", "empty Huffman table")
        self.end = offset

    def check_capacity(self, n_bytes: int, count: int) -> None:
        """Rejects a stream that is too short for `count` differences before anything is decoded."""
        if count * self.least > 8 * n_bytes:
            raise DecodeError("Truncated", "Huffman stream too short")

    def differences(self, stream: bytes, count: int) -> list[int]:
        """`count` differences, most significant bit first; a short last prefix is filled up with zeros."""
        total, at, out = 8 * len(stream), 0, []
        window, base, size = 0, 0, 4096  # bits; a slice of the stream as one integer keeps shifts short
        for _ in range(count):
            if at + 32 > base + size or not out:
                base = at & ~7
                part = stream[base // 8 : base // 8 + size // 8]
                window = int.from_bytes(part, "big") << (size + 64 - 8 * len(part))
            prefix = (window >> (size + 64 - 8 - (at - base))) & 255
            found = self.lookup[prefix]
            if found is None:
                raise DecodeError("InvalidContainer", "unknown Huffman code")
            length, category = found
            if at + length + category > total:
                raise DecodeError("Truncated", "Huffman stream ended")
            value = (window >> (size + 64 - length - category - (at - base))) & ((1 << category) - 1)
            at += length + category
            out.append(value - (1 << category) + 1 if category and value < 1 << (category - 1) else value)
        return out
