"""Raw files built out of rows, so that queries can run through the real decoders and be checked against the rows."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

from photonlake.functions import cipher

# Bytes of a component by TIFF field type, as far as they are written here.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 7: "B", 11: "f", 12: "d"}
SCALE = 1024  # denominator of written rationals


def u32s(*values: int) -> bytes:
    return struct.pack(f"<{len(values)}I", *values)


def u16s(*values: int) -> bytes:
    return struct.pack(f"<{len(values)}H", *values)


def pack_bits(values: np.ndarray, widths: np.ndarray, fill: int = 0) -> bytes:
    """Numbers one behind the other, each in its own number of bits (32 at most), most significant first; the last byte filled up."""
    values, widths = np.asarray(values, np.int64), np.asarray(widths, np.int64)
    places = np.arange(32)
    bits = (values[:, None] >> np.maximum(widths[:, None] - 1 - places, 0)) & 1
    flat = bits[places < widths[:, None]].astype(np.uint8)
    return np.packbits(np.concatenate([flat, np.full(-len(flat) % 8, fill, np.uint8)])).tobytes()


def _difference_bits(diffs: np.ndarray, prefix: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and widths of differences behind fixed-length codes: the category, then the difference in as many bits."""
    size = np.abs(diffs)
    category = np.where(size > 0, np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1, 0)
    rest = np.where(diffs < 0, diffs + (1 << category) - 1, diffs)
    return ((category + prefix) << category) | rest, category + length


# -- X3F


def codebook(categories: int) -> bytes:
    """Four-bit codes in order, then the end."""
    return b"".join(bytes([4, k << 4]) for k in range(categories)) + b"\0\0"


def parity_differences(v: np.ndarray, seed: int) -> np.ndarray:
    """Differences to the sample of the same parity two to the left, or two above in the first two columns, or the seed."""
    v = v.astype(np.int64)
    d = v.copy()
    d[:, 2:] -= v[:, :-2]
    d[2:, :2] -= v[:-2, :2]
    d[:2, :2] -= seed
    return d


def parity_stream(v: np.ndarray, seed: int) -> bytes:
    return pack_bits(*_difference_bits(parity_differences(v, seed).ravel(), 0, 4))


def raw_section(planes: Sequence[np.ndarray], form: int, seeds: Sequence[int], merrill: bool) -> bytes:
    """Bottom, middle and top as an entropy-coded image section."""
    height, width = planes[2].shape
    head = b"SECi" + u32s(0x20000, 1, form, width, height, 0)
    if merrill:
        head += u16s(*seeds) + b"\0\0" + codebook(15)
    else:
        head += u16s(*[n for p in planes for n in (p.shape[1], p.shape[0])]) + u16s(*seeds) + b"\0\0" + codebook(15) + b"\0" * 4
    streams = [parity_stream(p, s) for p, s in zip(planes, seeds, strict=True)]
    return head + u32s(*map(len, streams)) + b"".join(s + b"\0" * (-len(s) % 16) for s in streams)


def container(sections: Sequence[tuple[bytes, bytes]], version: int) -> bytes:
    """An X3F file of (kind, bytes) sections."""
    body, rows = b"", []
    for kind, data in sections:
        rows.append((40 + len(body), len(data), kind))
        body += data
    directory = b"SECd" + u32s(0x20000, len(rows)) + b"".join(u32s(a, n) + k for a, n, k in rows)
    return b"FOVb" + u32s(version) + b"\0" * 32 + body + directory + u32s(40 + len(body))


def _entry(kind: bytes, name: str, value: bytes) -> bytes:
    label = name.encode() + b"\0"
    at = 20 + len(label)
    return kind + u32s(0, at + len(value), 20, at) + label + value


def text_entry(name: str, text: str) -> bytes:
    data = text.encode()
    return _entry(b"CMbT", name, u32s(len(data)) + data)


def property_entry(name: str, props: dict[str, str]) -> bytes:
    strings, places = b"", []
    for k, v in props.items():
        for s in (k, v):
            places.append(len(strings))
            strings += s.encode() + b"\0"
    start = 20 + len(name.encode()) + 1 + 8 + 4 * len(places)
    return _entry(b"CMbP", name, u32s(len(props), start, *places) + strings)


def matrix_entry(name: str, kind: int, dims: Sequence[int], values: Sequence[float]) -> bytes:
    """A matrix of element kind 0 to 3, 5 or 6."""
    types = {0: "<i2", 1: "<u4", 2: "<u4", 3: "<f4", 5: "u1", 6: "<u2"}
    start = 20 + len(name.encode()) + 1 + 12 + 12 * len(dims)
    head = u32s(kind, len(dims), start, *[n for d in dims for n in (d, 0, 0)])
    return _entry(b"CMbM", name, head + np.asarray(values).astype(types[kind]).tobytes())


def calibration_section(data: bytes, kind: int, seed: int) -> bytes:
    """Calibration bytes under the cipher (2), as 12-bit parity differences (4) or as byte differences (5)."""
    if kind == 2:
        return b"SECc" + u32s(0x20000, 2, 0, 0, 0, seed) + cipher.decrypt(data, seed)
    if kind == 5:
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        stream = pack_bits(*_difference_bits(np.diff(raw, prepend=seed), 0, 4))
        return b"SECc" + u32s(0x20000, 5, len(data), seed, 0, 0) + codebook(9).ljust(28, b"\0") + u32s(len(stream)) + stream
    padded = np.frombuffer(data + b"\0" * (-len(data) % 3), np.uint8).astype(np.int64).reshape(-1, 3)
    values = np.stack([padded[:, 0] << 4 | padded[:, 1] >> 4, (padded[:, 1] & 15) << 8 | padded[:, 2]], axis=1).ravel()[: (2 * len(data) + 2) // 3]
    columns = 8
    grid = np.full((-(-len(values) // columns), columns), 0, np.int64)
    grid.ravel()[: len(values)] = values
    diffs = parity_differences(grid, seed).ravel()[: len(values)]
    stream = pack_bits(*_difference_bits(diffs, 0, 4))
    return b"SECc" + u32s(0x20000, 4, len(data), seed, columns, len(grid)) + codebook(13).ljust(28, b"\0") + u32s(len(stream)) + stream


def preview(light: int | None, order: str = "<") -> bytes:
    """A JPEG that holds an EXIF segment with a light source, and no picture."""
    mark = b"II" if order == "<" else b"MM"
    entries = [(0x9208, 3, light)] if light is not None else []
    second = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHIHH", t, k, 1, v, 0) for t, k, v in entries) + struct.pack(order + "I", 0)
    first = struct.pack(order + "HHHIII", 1, 0x8769, 4, 1, 26, 0)
    body = b"Exif\0\0" + mark + struct.pack(order + "HI", 42, 8) + first + second
    return b"\xff\xd8\xff\xfe\x00\x06note\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def preview_section(jpeg: bytes) -> bytes:
    return b"SECi" + u32s(0x20000, 2, 0x12, 0, 0, 0) + jpeg


# -- TIFF


def value(kind: int, values, order: str = "<") -> tuple[int, bytes]:
    """(field type, bytes) of a tag; rationals are written over SCALE."""
    if kind == 2:
        return kind, values.encode() + b"\0"
    if kind in (5, 10):
        return kind, b"".join(struct.pack(order + ("II" if kind == 5 else "ii"), round(v * SCALE), SCALE) for v in values)
    if isinstance(values, bytes):
        return kind, values
    return kind, struct.pack(f"{order}{len(values)}{CODES[kind]}", *values)


def raw_tags(width: int, height: int, bits: int, compression: int = 1, planar: int = 1, order: str = "<", **more) -> dict[int, tuple[int, bytes]]:
    """The tags of a linear raw image of three samples."""
    v = lambda kind, *values: value(kind, values, order)
    tags = {254: v(4, 0), 256: v(4, width), 257: v(4, height), 258: v(3, bits, bits, bits), 259: v(3, compression), 262: v(3, 34892), 271: value(2, "Apple"), 272: value(2, "Virtual"), 277: v(3, 3), 284: v(3, planar)}
    return tags | {50706: (1, bytes([1, 7, 1, 0])), 50707: (1, bytes([1, 4, 0, 0]))} | more.get("tags", {})


def tiff(images: Sequence[dict], order: str = "<", children: dict[int, list[int]] | None = None) -> bytes:
    """A classic TIFF of images {tags, blocks}: tag 278 makes their blocks strips, else tiles. children: the images that hang under others."""
    children = children or {}
    under = {c for cs in children.values() for c in cs}
    images = [{"tags": dict(i["tags"]), "blocks": i.get("blocks", [])} for i in images]
    for n, i in enumerate(images):
        strips = 278 in i["tags"]
        i["offsets"], i["sizes"] = (273, 279) if strips else (324, 325)
        if i["blocks"]:
            i["tags"][i["offsets"]] = value(4, [0] * len(i["blocks"]), order)
            i["tags"][i["sizes"]] = value(4, [len(b) for b in i["blocks"]], order)
        if n in children:
            i["tags"][330] = value(4, [0] * len(children[n]), order)
    starts, at = [], 8
    for i in images:
        starts.append(at)
        at += 6 + 12 * len(i["tags"])
    heap = bytearray()

    def put(data: bytes) -> int:
        place = at + len(heap)
        heap.extend(data + b"\0" * (len(data) % 2))
        return place

    for n, i in enumerate(images):
        if i["blocks"]:
            i["tags"][i["offsets"]] = value(4, [put(b) for b in i["blocks"]], order)
        if n in children:
            i["tags"][330] = value(4, [starts[c] for c in children[n]], order)
    chain = [n for n in range(len(images)) if n not in under]
    out = b""
    for n, i in enumerate(images):
        rows = struct.pack(order + "H", len(i["tags"]))
        for tag, (kind, data) in sorted(i["tags"].items()):
            field = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", put(data))
            rows += struct.pack(order + "HHI", tag, kind, len(data) // SIZES[kind]) + field
        after = chain[chain.index(n) + 1 :] if n in chain else []
        out += rows + struct.pack(order + "I", starts[after[0]] if after else 0)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    return head + out + bytes(heap)


def plain_rows(samples: np.ndarray, bits: int, order: str = "<") -> bytes:
    """Uncompressed rows (rows, samples): bit strings that start anew in each row; 16 bits in the file's order, 8 bits plain."""
    if bits == 16:
        return samples.astype(order + "u2").tobytes()
    if bits == 8:
        return samples.astype(np.uint8).tobytes()
    return b"".join(pack_bits(r, np.full(len(r), bits)) for r in samples)


def sof3_differences(v: np.ndarray, kind: int, start: int) -> np.ndarray:
    """Differences (rows, columns, components) of one restart interval under predictor 1 to 7, as signed 16-bit numbers."""
    v = v.astype(np.int64)
    a, b, c = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    a[:, 1:], b[1:], c[1:, 1:] = v[:, :-1], v[:-1], v[:-1, :-1]
    guess = {1: a, 2: b, 3: c, 4: a + b - c, 5: a + ((b - c) >> 1), 6: b + ((a - c) >> 1), 7: (a + b) >> 1}[kind]
    guess[0], guess[:, 0] = a[0], b[:, 0]
    guess[0, 0] = start
    return (v - guess + 32768) % 65536 - 32768


def sof3(samples: np.ndarray, precision: int, kind: int = 1, restart_rows: int = 0, point: int = 0) -> bytes:
    """A lossless JPEG of samples (rows, columns, components), five-bit codes for the 17 categories."""
    rows, columns, n = samples.shape
    segment = lambda mark, body: bytes([255, mark]) + struct.pack(">H", len(body) + 2) + body
    table = segment(0xC4, bytes([0, 0, 0, 0, 0, 17] + [0] * 11 + list(range(17))))
    frame = segment(0xC3, struct.pack(">BHHB", precision, rows, columns, n) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(n)))
    restart = segment(0xDD, struct.pack(">H", restart_rows * columns)) if restart_rows else b""
    scan = segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([kind, 0, point]))
    step, pieces = restart_rows or rows, []
    for top in range(0, rows, step):
        d = sof3_differences(samples[top : top + step] >> point, kind, 1 << (precision - point - 1)).ravel()
        values, widths = _difference_bits(np.where(d == -32768, 0, d), 0, 5)
        values, widths = np.where(d == -32768, 16, values), np.where(d == -32768, 5, widths)
        pieces.append(pack_bits(values, widths, 1).replace(b"\xff", b"\xff\0"))
    body = pieces[0] + b"".join(bytes([255, 0xD0 + k % 8]) + p for k, p in enumerate(pieces[1:]))
    return b"\xff\xd8" + table + frame + restart + scan + body + b"\xff\xd9"


def area(bounds=(0, 0, 0, 0), plane: int = 0, planes: int = 3, pitch=(1, 1)) -> bytes:
    return struct.pack(">8I", *bounds, plane, planes, *pitch)


def opcode_list(*ops: tuple) -> bytes:
    """(id, payload[, flags[, version]]) in order."""
    out = struct.pack(">I", len(ops))
    for ident, payload, *more in ops:
        flags, version = (more + [0, 0x01030000][len(more) :])[:2]
        out += struct.pack(">4I", ident, version, flags, len(payload)) + payload
    return out


def profile_table(points: tuple[int, int, int], spacing, origin, weights, gains, kind: int = 3, gamma: float = 1.0, low: float = 0.0, high: float = 1.0, order: str = "<", wide: bool = True) -> bytes:
    """A profile gain table with (tag 52544) or without (52525) its element kind, gamma and range."""
    rows, columns, n = points
    head = struct.pack(order + "2I4dI5f", rows, columns, *spacing, *origin, n, *weights)
    types = {0: "u1", 1: "u2", 2: "f2", 3: "f4"}
    return head + (struct.pack(order + "I3f", kind, gamma, low, high) if wide else b"") + np.asarray(gains).astype(order + types[kind]).tobytes()
