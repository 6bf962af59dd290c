import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.functions import cipher, opcode_list, sof3
from photonlake.functions.entropy import Codebook
from photonlake.operators import layout, opcodes, predict, stats, stencil
from photonlake.sources import camf, dng, tiff, x3f
from photonlake.sources.errors import DecodeError, guarded
from tests import fixtures as fx


def test_huffman_vectors():
    assert Codebook(fx.K1).differences(bytes([0b01011001, 0b11111000]), 5) == [0, 1, -1, 3, -3]
    stream = bytes.fromhex("1aa8e61a")
    assert Codebook(fx.K2).differences(stream, 9) == [0, 1, -1, 2, -3, 4, -7, 1, -1]
    with pytest.raises(DecodeError):
        Codebook(fx.K2).differences(stream, 10)


@pytest.mark.parametrize("pairs", [[(0, 0)], [(9, 0), (0, 0)], [(1, 1), (0, 0)], [(1, 0), (2, 0), (0, 0)]])
def test_huffman_rejects_broken_tables(pairs):
    with pytest.raises(DecodeError):
        Codebook(fx.codebook(pairs))


def test_long_huffman_stream_crosses_windows():
    rnd = random.Random(3)
    values, bits = [], ""
    for _ in range(5000):
        k = rnd.randrange(4)
        v = rnd.randrange(1 << k)
        bits += f"{k:02b}" + (f"{v:0{k}b}" if k else "")
        values.append(v - (1 << k) + 1 if k and v < 1 << (k - 1) else v)
    bits += "0" * (-len(bits) % 8)
    assert Codebook(fx.K2).differences(int(bits, 2).to_bytes(len(bits) // 8, "big"), 5000) == values


PLANE = [[101, 102, 104, 101], [104, 98, 101, 99], [103, 103, 102, 103], [100, 101, 101, 99]]


def test_parity_predictor_in_numpy_and_in_windows(spark):
    diffs = np.array(Codebook(fx.K2).differences(bytes.fromhex("756b930e9a376e40"), 16)).reshape(4, 4)
    assert camf.parity_planes(diffs, 100).tolist() == PLANE
    df = spark.createDataFrame([(0, 0, y, x, int(diffs[y, x])) for y in range(4) for x in range(4)], "image_id int, plane int, y long, x int, d long")
    got = {(r.y, r.x): r.code for r in predict.parity_decode(df, 100).collect()}
    assert [[got[y, x] for x in range(4)] for y in range(4)] == PLANE


def test_keystream_vectors():
    assert cipher.keystream(12, 0).tolist() == [54, 155, 50, 31, 104, 232, 45, 222, 91, 69, 141, 196]
    assert cipher.keystream(12, 0xFFFFFFFF).tolist() == [52, 49, 228, 110, 28, 67, 167, 24, 0, 109, 96, 255]


def test_calibration_type_5():
    section = b"SECc" + fx.longs([0x20000, 5, 8, 0xFFFFFFFF, 0, 0]) + fx.codebook([(1, 0), (1, 128), (0, 0)]).ljust(28, b"\0") + fx.longs([2]) + bytes([0xFA, 0xBC])
    assert list(camf.decode(section)) == [0, 1, 0, 255, 254, 255, 0, 0]


def test_calibration_type_4():
    section = b"SECc" + fx.longs([0x20000, 4, 24, 0x100, 4, 4]) + fx.K2.ljust(28, b"\0") + fx.longs([8]) + bytes.fromhex("756b930e9a376e40")
    out = camf.decode(section)
    assert len(out) == 24 and out[:6] == bytes([0x10, 0x11, 0x02, 0x10, 0x41, 0x01])


SOF3 = {1: [0, 1, -1, 1], 2: [0, 1, -1, -1], 3: [0, 1, -1, 0], 4: [0, 1, -1, 0], 5: [0, 1, -1, 1], 6: [0, 1, -1, 0], 7: [0, 1, -1, 0]}


@pytest.mark.parametrize("kind", SOF3)
def test_lossless_jpeg_predictors(kind):
    assert sof3.decode(fx.sof3(2, 2, 8, kind, SOF3[kind]))[1].ravel().tolist() == [128, 129, 127, 128]


def test_lossless_jpeg_point_transform_and_restart():
    assert sof3.decode(fx.sof3(3, 1, 8, 1, [0, 2, -2], point=2))[1].ravel().tolist() == [128, 136, 128]
    assert sof3.decode(fx.sof3(2, 2, 8, 7, [1, 2, 0, 0], restart=2))[1].ravel().tolist() == [129, 131, 128, 128]


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
@pytest.mark.parametrize("rows", [None, 2])
def test_window_predictors_match_the_sequential_decoder(spark, kind, rows):
    d = np.random.default_rng(kind).integers(0, 65536, (5, 7))
    step = rows or 5
    want = np.concatenate([sof3.reconstruct(d[i : i + step, :, None], kind, 2048)[..., 0] for i in range(0, 5, step)])
    df = spark.createDataFrame([(0, 0, y, x, int(d[y, x])) for y in range(5) for x in range(7)], "image_id int, plane int, y long, x int, d long")
    got = {(r.y, r.x): r.code for r in predict.sof3_decode(df, kind, 12, restart_rows=rows).collect()}
    assert all(got[y, x] == want[y, x] for y in range(5) for x in range(7))


def decoded(image):
    return dng.decode(dng.parse(fx.dng(image)))


def test_normalization_with_repeats_and_deltas():
    tags = {
        50713: (3, fx.shorts([2, 1])), 50714: (3, fx.shorts([10, 20, 30, 20, 30, 40])), 50715: (10, fx.srationals([(-2, 1), (-4, 1)])),
        50716: (10, fx.srationals([(-1, 1), (-3, 1)])), 50717: (3, fx.shorts([100] * 3)),
    }
    out = decoded(fx.rgb(2, 2, [50] * 12, tags=tags))
    want = np.array([43, 33, 23, 45, 35, 25, 35, 25, 15, 37, 27, 17]) / np.tile([85, 75, 65], 4)
    assert out["linear"].ravel().tolist() == want.astype(np.float32).tolist()


def test_active_area_clamps_and_flags():
    tags = {50829: (4, fx.longs([1, 1, 2, 3])), 50715: (10, fx.srationals([(10, 1), (20, 1)])), 50717: (3, fx.shorts([200] * 3))}
    out = decoded(fx.rgb(3, 2, [100] * 18, tags=tags))
    assert out["linear"][1].tolist() == [[0.5] * 3, [0.5] * 3, [np.float32(80 / 180)] * 3]
    assert out["flags"].ravel().tolist() == [4] * 12 + [0] * 6


def test_short_table_repeats_its_last_entry():
    out = decoded(fx.rgb(1, 1, [0, 1, 100], tags={50712: (3, fx.shorts([100, 500]))}))
    assert out["linear"].ravel().tolist() == (np.array([100, 500, 500]) / 65535).astype(np.float32).tolist()


def test_packed_ten_bit_rows(spark):
    data = bytes.fromhex("00001ffcffc01008")
    assert dng.unpack(data, 2, 1, 3, 10, "<").ravel().tolist() == [0, 1, 1023, 1023, 1, 2]
    rows = spark.createDataFrame([(0, list(data[:4])), (1, list(data[4:]))], "y int, bytes array<int>")
    assert [r.code for r in layout.unpack_bits(rows, 10, 3).orderBy("y", "i").collect()] == [0, 1, 1023, 1023, 1, 2]


def test_strips_planes_and_partial_tiles():
    strips = fx.rgb(2, 3, [], tags={278: (4, fx.longs([2])), 284: (3, fx.shorts([2]))}, blocks=[fx.shorts(b) for p in (0, 10, 20) for b in ([1 + p, 2 + p, 3 + p, 4 + p], [5 + p, 6 + p])])
    assert decoded(strips)["codes"].ravel().tolist() == [k + p for k in range(1, 7) for p in (0, 10, 20)]
    cells = {0: [1, 2, 4, 5], 1: [3, 999, 6, 999], 2: [7, 8, 999, 999], 3: [9, 999, 999, 999]}
    tiles = fx.rgb(3, 3, [], tags={322: (4, fx.longs([2])), 323: (4, fx.longs([2]))}, blocks=[fx.shorts([c + p for c in cells[k] for p in (0, 100, 200)]) for k in range(4)])
    assert decoded(tiles)["codes"][..., 0].ravel().tolist() == list(range(1, 10))


def test_interleaving_is_undone(spark):
    rows, columns = dng.interleaved_order(3, 2), dng.interleaved_order(5, 2)
    assert rows.tolist() == [0, 2, 1] and columns.tolist() == [0, 2, 4, 1, 3]
    stored = [(0, 0, y, x, int(rows[y] * 5 + columns[x])) for y in range(3) for x in range(5)]
    df = spark.createDataFrame(stored, "image_id int, plane int, y long, x int, code long")
    assert [r.code for r in layout.uninterleave(df, 3, 5, 2, 2).orderBy("y", "x").collect()] == list(range(15))


def test_opcode_stages_and_states():
    import struct

    table = fx.area() + struct.pack(">I3H", 3, 2, 1, 0)
    out = decoded(fx.rgb(1, 1, [0, 1, 2], tags={51008: (7, fx.opcodes((7, table, 0))), 50712: (3, fx.shorts([0, 10, 100])), 50717: (3, fx.shorts([100] * 3))}))
    assert out["linear"].ravel().tolist() == [1.0, np.float32(0.1), 0.0] and out["flags"].ravel().tolist() == [8, 8, 10]
    assert out["states"]["opcode_list_1"] == "Applied"
    unknown = decoded(fx.rgb(1, 1, [0, 1, 2], tags={51009: (7, fx.opcodes((99, b"", 1)))}))
    assert unknown["states"]["opcode_list_2"] == "SkippedOptional"
    mixed = decoded(fx.rgb(1, 1, [0, 1, 2], tags={51009: (7, fx.opcodes((99, b"", 1), (7, table, 0)))}))
    assert mixed["states"]["opcode_list_2"] == "PartiallyApplied"
    assert guarded(dng.parse, fx.dng(fx.rgb(1, 1, [0, 1, 2], tags={51009: (7, fx.opcodes((99, b"", 0)))})))[1] == "UnsupportedFeature"


GAIN = {"rows": 2, "columns": 2, "planes": 1, "spacing": (0.5, 0.5), "origin": (0.25, 0.25), "gains": [1.0, 2.0, 3.0, 4.0]}


def test_gain_map_and_polynomial(spark):
    image = np.full((2, 2, 1), 0.1, np.float32)
    opcode_list.apply_image(image, [opcodes.Opcode("gain_map", opcodes.Area(planes=1), grid=GAIN)], (0, 0, 2, 2), 2)
    assert image.ravel().tolist() == pytest.approx([0.1, 0.2, 0.3, 0.4], abs=1e-7)
    px = spark.createDataFrame([(0, x, 0, v) for x, v in enumerate([0.0, 0.5, 1.0])], "y long, x int, channel int, v double")
    poly, _ = opcodes.apply_list(px, [opcodes.Opcode("polynomial", params=[0.0, 0.5])], (0, 0, 1, 3))
    assert [r.v for r in poly.orderBy("x").collect()] == [0.0, 0.25, 0.5]


def test_opcodes_in_plans_match_numpy(spark):
    rnd = np.random.default_rng(5)
    image = rnd.random((6, 5, 3)).astype(np.float32)
    ops = [
        opcodes.Opcode("trim", opcodes.Area((1, 0, 6, 5))),
        opcodes.Opcode("gain_map", grid=GAIN),
        opcodes.Opcode("row_scale", opcodes.Area((2, 1, 6, 4), 1, 2, (2, 1)), params=[0.5, 1.5]),
        opcodes.Opcode("column_delta", params=[0.1, -0.2, 0.3, 0.0, 0.25]),
        opcodes.Opcode("table", params=[(k * 7919) % 65536 for k in range(60000)]),
    ]
    px = spark.createDataFrame([(y, x, c, float(image[y, x, c])) for y in range(6) for x in range(5) for c in range(3)], "y long, x int, channel int, v double")
    out, bounds = opcodes.apply_list(px, ops[:-1], (0, 0, 6, 5))
    mine = image.copy()
    assert opcode_list.apply_image(mine, ops[:-1], (0, 0, 6, 5), 2) == bounds == (1, 0, 6, 5)
    assert all(abs(r.v - mine[r.y, r.x, r.channel]) < 1e-6 for r in out.collect())


def test_profile_gain_tables(spark):
    import struct

    head = lambda n: struct.pack("<2I4dI5f", 1, 1, 1.0, 1.0, 0.0, 0.0, n, 0, 0, 0, 0, 1)
    plain = opcode_list.profile_table(52525, head(2) + struct.pack("<2f", 1, 3), "<")
    ranged = opcode_list.profile_table(52544, head(2) + struct.pack("<I3f", 0, 2, 1, 3) + bytes([0, 255]), "<")
    df = spark.createDataFrame([(0.25, 1.0), (0.25, 2.0), (1.0, 1.0)], "v double, e double")
    gain = lambda t, v, e: opcodes.profile_gain(v, v, v, e, t, F.lit(0.5), F.lit(0.5))
    assert [df.filter(f"v = {v} and e = {e}").select(gain(plain, F.col("v"), e)).first()[0] for v, e in ((0.25, 1.0), (0.25, 2.0), (1.0, 1.0))] == [2.0, 3.0, 3.0]
    assert spark.range(1).select(gain(ranged, F.lit(0.5), 1.0)).first()[0] == 2.0


def test_mask_and_preview():
    mask = {254: (4, fx.longs([65540])), 256: (4, fx.longs([2])), 257: (4, fx.longs([1])), 258: (3, fx.shorts([8])), 259: (3, fx.shorts([1])), 262: (3, fx.shorts([52527])), 277: (3, fx.shorts([1])),
            322: (4, fx.longs([2])), 323: (4, fx.longs([1])), 52526: (2, b"sky\0"), 52536: (4, fx.longs([2, 3, 10, 8]))}
    small = {254: (4, fx.longs([1])), 259: (3, fx.shorts([7])), 262: (3, fx.shorts([6])), 278: (4, fx.longs([1]))}
    data = fx.dng(fx.rgb(1, 1, [1, 2, 3]), {"tags": mask, "blocks": [bytes([0, 255])]}, {"tags": small, "blocks": [b"\xff\xd8xx\xff\xd9"]})
    (found,) = dng.masks(dng.parse(data))
    assert (found["samples"], found["name"], found["sub_area"]) == (bytes([0, 255]), "sky", [2, 3, 10, 8])
    assert dng.preview(tiff.walk(data), data) == b"\xff\xd8xx\xff\xd9"


def test_defect_lists_and_grids(spark):
    assert [y * 4 + x for y, x in stencil.run_list_defects([1, 1, 99, 3, 98, 0, 2, 2, 97, 0], 3, 4)] == [5, 7, 10]
    low = spark.range(1888).withColumnRenamed("id", "y").crossJoin(spark.range(2944).selectExpr("cast(id as int) as x"))
    assert low.filter(stencil.grid_sites(108, 2820, 8, 232, 1656, 16)).count() == 30600


def test_repair_takes_the_nearest_ring(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 0.25, 0, 1), (0, 0, 0, 1, 9.0, 1, 0), (0, 0, 0, 2, 0.75, 0, 0)], "image_id int, plane int, y long, x int, v double, causes int, clip int")
    out = stencil.repair(px).orderBy("x").collect()
    assert [r.v for r in out] == [0.25, 0.5, 0.75] and [r.influence for r in out] == [1, 1, 0]


def test_local_regression_recovers_an_affine_map(spark):
    rows = [(0, 0, y, x, float(y * 10 + x * x), 0.5 * (y * 10 + x * x) - 0.1, 0) for y in range(6) for x in range(6)]
    px = spark.createDataFrame(rows, "image_id int, plane int, y long, x int, g double, s double, influence int").withColumnRenamed("g", "guide").withColumnRenamed("s", "source")
    out = stencil.local_regression(px, "guide", "source", 0.0).collect()
    assert all(abs(r.slope - 0.5) < 1e-6 and abs(r.intercept + 0.1) < 1e-6 for r in out)
    assert {r.n for r in out} == {9, 12, 15, 16, 20, 25}


def test_residual_summary(spark):
    r = spark.createDataFrame([(1, 2.0), (1, -4.0), (1, 6.0), (1, -8.0)], "k int, r double")
    out = stats.residual_summary(r, ["k"]).first()
    assert (out.n, out.bias, out.p95) == (4, -1.0, 8.0) and abs(out.rms - 30**0.5) < 1e-12


def test_upper_median(spark):
    h = spark.createDataFrame([(0, 0, 10, 2), (0, 0, 12, 2)], "image_id int, plane int, code long, n long")
    assert stats.black_level(h).first().black == 12


def _mutations(data):
    for n in range(len(data)):
        yield data[:n]
    state = 0xA5376B19
    for i in range(len(data)):
        for b in (0, 1, 127, 255):
            yield data[:i] + bytes([b]) + data[i + 1 :]
    for _ in range(500):
        out = bytearray(data)
        for _ in range(4):
            state ^= state << 13 & 0xFFFFFFFF
            state ^= state >> 17
            state ^= state << 5 & 0xFFFFFFFF
            out[state % len(out)] = state >> 8 & 255
        yield bytes(out)


def test_no_byte_string_breaks_a_parser():
    calls = [
        (fx.dng(fx.rgb(2, 1, range(6))), lambda b: dng.decode(dng.parse(b))),
        (fx.dng(fx.rgb(2, 1, range(6))), tiff.probe),
        (fx.x3f([(b"IMA2", b"SECi" + fx.longs([0x20000, 1, 0x25, 4, 4])), (b"CAMF", fx.camf2())]), lambda b: x3f.planes(x3f.sections(b)["raw"], 0x40002)),
        (fx.camf2(), lambda b: camf.entries(camf.decode(b))),
        (fx.sof3(2, 2, 8, 7, [1, 0, -1, 2]), sof3.decode),
    ]
    for data, call in calls:
        for changed in _mutations(data):
            guarded(call, changed)  # an error is a value
