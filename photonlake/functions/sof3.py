"""Lossless JPEG (SOF3) tiles: markers, Huffman tables and all seven predictors."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from photonlake.sources.errors import DecodeError, Limits


@dataclass
class Frame:
    precision: int
    height: int
    width: int
    components: list[int]


@dataclass
class _State:
    data: bytes
    at: int = 2
    frame: Frame | None = None
    tables: dict[int, dict[tuple[int, int], int]] = field(default_factory=dict)
    restart: int = 0


def _need(ok: bool, kind: str = "InvalidContainer") -> None:
    if not ok:
        raise DecodeError(kind)


def _segment(s: _State) -> bytes:
    _need(s.at + 2 <= len(s.data), "Truncated")
    size = int.from_bytes(s.data[s.at : s.at + 2], "big")
    _need(size >= 2 and s.at + size <= len(s.data), "Truncated")
    body = s.data[s.at + 2 : s.at + size]
    s.at += size
    return body


def _frame(body: bytes, limits: Limits) -> Frame:
    _need(len(body) >= 6)
    precision, height, width, n = body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
    _need(2 <= precision <= 16 and 1 <= n <= 4 and height > 0 and width > 0, "UnsupportedFeature")
    _need(len(body) == 6 + 3 * n)
    _need(width * height * n <= limits.max_frame_samples, "ResourceLimit")
    parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
    _need(all(p[1] == 0x11 for p in parts), "UnsupportedFeature")
    ids = [p[0] for p in parts]
    _need(len(set(ids)) == n)
    return Frame(precision, height, width, ids)


def _huffman(body: bytes, tables: dict) -> None:
    i = 0
    while i < len(body):
        _need(i + 17 <= len(body))
        kind, ident, counts = body[i] >> 4, body[i] & 15, body[i + 1 : i + 17]
        _need(kind == 0 and ident < 4, "UnsupportedFeature")
        symbols = body[i + 17 : i + 17 + sum(counts)]
        _need(len(symbols) == sum(counts) > 0 and max(symbols) <= 16)
        code, k, table = 0, 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                _need(code < (1 << length) - 1)  # all ones is no code
                table[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        tables[ident] = table
        i += 17 + len(symbols)


def _scan_bytes(s: _State) -> list[bytes]:
    """The entropy-coded bytes up to the end marker, unstuffed, one piece for each restart interval."""
    pieces, piece, data, i = [], bytearray(), s.data, s.at
    while True:
        j = data.find(b"\xff", i)
        _need(j >= 0 and j + 1 < len(data), "Truncated")
        piece += data[i:j]
        mark = data[j + 1]
        if mark == 0:
            piece.append(255)
        elif 0xD0 <= mark <= 0xD7:
            _need(s.restart > 0 and mark - 0xD0 == len(pieces) % 8)
            pieces.append(bytes(piece))
            piece = bytearray()
        else:
            _need(mark == 0xD9 and j + 2 == len(data))
            return [*pieces, bytes(piece)]
        i = j + 2


def _lookup(table: dict[tuple[int, int], int]) -> list[tuple[int, int] | None]:
    """(code length, category) for each 16 bits that may come next."""
    found: list[tuple[int, int] | None] = [None] * 65536
    for (length, code), category in table.items():
        first = code << (16 - length)
        found[first : first + (1 << (16 - length))] = [(length, category)] * (1 << (16 - length))
    return found


def _differences(stream: bytes, tables: list[dict], count: int) -> list[int]:
    """count differences of each component in turn; what is left of the last byte must be ones."""
    lookups = {id(t): _lookup(t) for t in tables}
    each = [lookups[id(t)] for t in tables]
    total, at, out = 8 * len(stream), 0, []
    window, base, size = 0, 0, 4096  # bits; a slice of the stream as one integer keeps shifts short
    for _ in range(count):
        for lookup in each:
            if at + 48 > base + size or not out:
                base = at & ~7
                part = stream[base // 8 : base // 8 + size // 8]
                window = int.from_bytes(part, "big") << (size + 64 - 8 * len(part))
            found = lookup[(window >> (size + 48 - (at - base))) & 65535]
            _need(found is not None, "InvalidContainer" if at + 16 <= total else "Truncated")
            length, category = found
            extra = 0 if category == 16 else category
            _need(at + length + extra <= total, "Truncated")
            at += length + extra
            if category == 16:
                out.append(-32768)
                continue
            value = (window >> (size + 64 - (at - base))) & ((1 << category) - 1)
            out.append(value - (1 << category) + 1 if category and not value >> (category - 1) else value)
    rest = total - at
    _need(rest < 8 and (not rest or stream[-1] & ((1 << rest) - 1) == (1 << rest) - 1))
    return out


def reconstruct(diffs: np.ndarray, kind: int, start: int) -> np.ndarray:
    """Samples modulo 65,536 of one restart interval (rows, columns, components) under predictor 1 to 7.

    Where a predictor looks at one neighbour of its own row or column only, that is a running sum; only 7 goes sample by sample.
    """
    d = diffs.astype(np.int64)
    rows, columns, _ = d.shape
    if kind == 1:
        d[:, 0] = np.cumsum(d[:, 0], axis=0)
        return (np.cumsum(d, axis=1) + start) % 65536
    if kind == 2:
        d[0] = np.cumsum(d[0], axis=0)
        return (np.cumsum(d, axis=0) + start) % 65536
    if kind == 4:
        return (np.cumsum(np.cumsum(d, axis=0), axis=1) + start) % 65536
    v = np.zeros_like(d)
    v[0], v[:, 0] = (np.cumsum(d[0], axis=0) + start) % 65536, (np.cumsum(d[:, 0], axis=0) + start) % 65536
    if kind == 3:
        for y in range(1, rows):
            v[y, 1:] = (v[y - 1, :-1] + d[y, 1:]) % 65536
    elif kind == 5:
        for y in range(1, rows):
            half = (v[y - 1, 1:] - v[y - 1, :-1]) >> 1
            v[y, 1:] = (v[y, :1] + np.cumsum(half + d[y, 1:], axis=0)) % 65536
    elif kind == 6:
        for x in range(1, columns):
            half = (v[1:, x - 1] - v[:-1, x - 1]) >> 1
            v[1:, x] = (v[:1, x] + np.cumsum(half + d[1:, x], axis=0)) % 65536
    else:
        for y in range(1, rows):
            above, more, line = v[y - 1].tolist(), d[y].tolist(), v[y].tolist()
            for x in range(1, columns):
                line[x] = [((a + b >> 1) + e) & 65535 for a, b, e in zip(line[x - 1], above[x], more[x], strict=True)]
            v[y] = line
    return v


def decode(data: bytes, limits: Limits | None = None) -> tuple[Frame, np.ndarray]:
    """(frame, samples of shape (height, width, components)) of one lossless JPEG."""
    limits, s = limits or Limits(), _State(bytes(data))
    _need(s.data[:2] == b"\xff\xd8")
    while True:
        _need(s.at + 2 <= len(s.data), "Truncated")
        _need(s.data[s.at] == 0xFF)
        while s.at < len(s.data) and s.data[s.at] == 0xFF:
            s.at += 1
        _need(s.at < len(s.data), "Truncated")
        mark = s.data[s.at]
        s.at += 1
        if mark == 0xC3:
            _need(s.frame is None)
            s.frame = _frame(_segment(s), limits)
        elif mark == 0xC4:
            _huffman(_segment(s), s.tables)
        elif mark == 0xDD:
            body = _segment(s)
            _need(len(body) == 2 and not s.restart)
            s.restart = int.from_bytes(body, "big")
        elif 0xE0 <= mark <= 0xEF or mark == 0xFE:
            _segment(s)
        elif mark == 0xDA:
            break
        else:
            raise DecodeError("UnsupportedFeature")
    frame, body = s.frame, _segment(s)
    _need(frame is not None)
    n = len(frame.components)
    _need(len(body) == 1 + 2 * n + 3 and body[0] == n)
    ids, chosen = [body[1 + 2 * i] for i in range(n)], [body[2 + 2 * i] >> 4 for i in range(n)]
    kind, end, approx = body[-3:]
    point = approx & 15
    _need(sorted(ids) == sorted(frame.components))
    _need(1 <= kind <= 7 and end == 0 and approx >> 4 == 0 and point < frame.precision, "UnsupportedFeature")
    _need(all(t in s.tables for t in chosen))
    _need(s.restart % frame.width == 0, "UnsupportedFeature")
    rows = s.restart // frame.width or frame.height
    pieces = _scan_bytes(s)
    _need(len(pieces) == -(-frame.height // rows))
    out = np.empty((frame.height, frame.width, n), np.int64)
    for i, piece in enumerate(pieces):
        top = i * rows
        count = min(rows, frame.height - top)
        d = np.array(_differences(piece, [s.tables[t] for t in chosen], count * frame.width)).reshape(count, frame.width, n)
        out[top : top + count] = reconstruct(d, kind, 1 << (frame.precision - point - 1))
    _need(int(out.max()) < 1 << (frame.precision - point))
    order = [ids.index(c) for c in frame.components]
    return frame, (out[..., order] << point).astype(np.uint16)
