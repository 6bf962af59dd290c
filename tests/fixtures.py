"""Synthetic raw files for tests."""

import struct


def codebook(pairs):
    return bytes(b for pair in pairs for b in pair)


K1 = codebook([(1, 0), (2, 128), (2, 192), (0, 0)])
K2 = codebook([(2, 0), (2, 64), (2, 128), (2, 192), (0, 0)])


def shorts(v):
    return struct.pack(f"<{len(v)}H", *v)


def longs(v):
    return struct.pack(f"<{len(v)}I", *v)


def rationals(v):
    return b"".join(struct.pack("<II", *p) for p in v)


def srationals(v):
    return b"".join(struct.pack("<ii", *p) for p in v)


def rgb(width, height, codes, **more):
    """Tags and blocks of a 16-bit linear raw image in one tile."""
    tags = {
        254: (4, longs([0])), 256: (4, longs([width])), 257: (4, longs([height])), 258: (3, shorts([16] * 3)), 259: (3, shorts([1])), 262: (3, shorts([34892])),
        271: (2, b"Apple\0"), 277: (3, shorts([3])), 284: (3, shorts([1])), 322: (4, longs([width])), 323: (4, longs([height])), 50706: (1, bytes([1, 7, 1, 0])), 50707: (1, bytes([1, 7, 1, 0])),
    }
    return {"tags": tags | more.pop("tags", {}), "blocks": more.pop("blocks", [shorts(codes)])}


def dng(*images):
    """A little-endian TIFF with a chain of directories; images that set tag 278 store strips."""
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 10: 8, 11: 4, 12: 8}
    images = [{"tags": dict(i["tags"]), "blocks": i["blocks"]} for i in images]
    for i in images:
        strips = 278 in i["tags"]
        i["at"] = 273 if strips else 324
        if strips:
            i["tags"].pop(322, None), i["tags"].pop(323, None)
        i["tags"][i["at"]] = (4, longs([0] * len(i["blocks"])))
        i["tags"][279 if strips else 325] = (4, longs([len(b) for b in i["blocks"]]))
    starts, at = [], 8
    for i in images:
        starts.append(at)
        at += 6 + 12 * len(i["tags"])
    heap, directories = b"", []
    for i in images:
        offsets = []
        for b in i["blocks"]:
            offsets.append(at + len(heap))
            heap += b + b"\0" * (len(b) % 2)
        i["tags"][i["at"]] = (4, longs(offsets))
    for n, i in enumerate(images):
        out = struct.pack("<H", len(i["tags"]))
        for tag, (kind, data) in sorted(i["tags"].items()):
            value = data.ljust(4, b"\0")
            if len(data) > 4:
                value = longs([at + len(heap)])
                heap += data + b"\0" * (len(data) % 2)
            out += struct.pack("<HHI", tag, kind, len(data) // sizes[kind]) + value
        directories.append(out + longs([starts[n + 1] if n + 1 < len(images) else 0]))
    return b"II*\0" + longs([8]) + b"".join(directories) + heap


def opcodes(*ops):
    """An opcode list of (id, payload, flags)."""
    return struct.pack(">I", len(ops)) + b"".join(struct.pack(">4I", i, 0x01030000, flags, len(p)) + p for i, p, flags in ops)


def area(bounds=(0, 0, 0, 0), plane=0, planes=3, pitch=(1, 1)):
    return struct.pack(">8I", *bounds, plane, planes, *pitch)


def camf2(text=b"hello world"):
    """A type-2 calibration section with one text entry named Tag."""
    from photonlake.functions import cipher

    entry = b"CMbT" + longs([0, 24 + 4 + len(text), 20, 24]) + b"Tag\0" + longs([len(text)]) + text
    return b"SECc" + longs([0x20000, 2, 0, 0, 0, 7]) + cipher.decrypt(entry, 7)


def x3f(sections, version=0x40002):
    """A container of (kind, bytes) sections."""
    body, rows = b"", []
    for kind, data in sections:
        rows.append((40 + len(body), len(data), kind))
        body += data
    directory = b"SECd" + longs([0x20000, len(rows)]) + b"".join(longs([a, n]) + k for a, n, k in rows)
    return b"FOVb" + longs([version]) + b"\0" * 32 + body + directory + longs([40 + len(body)])


def sof3(width, height, precision, kind, diffs, point=0, restart=0):
    """A one-component lossless JPEG; differences of category 0 to 2 have codes 00, 01, 10."""
    seg = lambda mark, body: bytes([255, mark]) + struct.pack(">H", len(body) + 2) + body
    table = bytes([0, 0, 3] + [0] * 14 + [0, 1, 2])
    frame = struct.pack(">BHHB3B", precision, height, width, 1, 1, 0x11, 0)
    pieces, step = [], restart or len(diffs)
    for i in range(0, len(diffs), step):
        bits = ""
        for d in diffs[i : i + step]:
            n = abs(d).bit_length()
            bits += f"{n:02b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")
        bits += "1" * (-len(bits) % 8)
        pieces.append(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0"))
    scan = pieces[0] + b"".join(bytes([255, 0xD0 + k % 8]) + p for k, p in enumerate(pieces[1:]))
    dri = seg(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + seg(0xC4, table) + seg(0xC3, frame) + dri + seg(0xDA, bytes([1, 1, 0, kind, 0, point])) + scan + b"\xff\xd9"
