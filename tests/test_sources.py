import numpy as np
import pytest

from photonlake.sources import camf, dng, files, tiff, x3f
from photonlake.streaming.files import stream_files
from tests import fixtures as fx


def table(spark, **content):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")


def test_probe_tags_and_errors_are_rows(spark):
    good = fx.dng(fx.rgb(2, 1, range(6)))
    found = {r.path: r for r in tiff.probe_table(table(spark, good=good, cut=good[:60], x=b"FOVb\x02\0\x04\0", other=b"hello")).collect()}
    assert (found["good"].container, found["good"].width, found["good"].bits_per_sample) == ("Dng", 2, [16, 16, 16])
    assert found["x"].container == "X3f" and found["x"].version == 0x40002 and found["other"].container == "Unknown"
    assert tiff.classification(found["good"].container, found["good"].error) == "supported"
    tags = tiff.tag_table(table(spark, good=good, cut=good[:60]))
    assert tags.filter("path = 'good' and tag_id = 256").count() == 1
    assert [r.error for r in tags.filter("path = 'cut'").collect()] == ["Truncated"]


def test_a_directory_cycle_is_an_error():
    data = bytearray(fx.dng(fx.rgb(1, 1, [1, 2, 3])))
    n = int.from_bytes(data[8:10], "little")
    data[10 + 12 * n : 14 + 12 * n] = fx.longs([8])
    assert tiff.guarded(tiff.walk, bytes(data))[1] == "InvalidOffset"


def test_linear_images(spark):
    files_df = table(spark, a=fx.dng(fx.rgb(2, 1, [0, 65535, 13107, 0, 0, 65535])), bad=b"II*\0")
    (line,) = dng.linear_table(files_df).collect()
    assert line.samples == [0.0, 1.0, float(np.float32(0.2)), 0.0, 0.0, 1.0] and line.flags == [0, 3, 0, 0, 0, 3]
    rows = {r.path: r for r in dng.image_table(files_df).collect()}
    assert rows["bad"].error is not None and rows["a"].valid_area == [0, 0, 1, 2] and rows["a"].states["linearization"] == "NotPresent"


def test_x3f_sections_calibration_and_planes(spark):
    raw = b"SECi" + fx.longs([0x20000, 1, 0x25, 4, 4, 0]) + fx.shorts([2, 2, 2, 2, 4, 4]) + fx.shorts([100, 100, 100]) + b"\0\0"
    stream = bytes.fromhex("756b930e9a376e40")
    raw = raw[:48] + fx.K2 + b"\0" * 4 + fx.longs([8, 8, 8]) + (stream + b"\0" * 8) * 3
    data = fx.x3f([(b"IMA2", raw), (b"CAMF", fx.camf2()), (b"IMA2", b"SECi" + fx.longs([0x20000, 2, 0x12, 0, 0, 0]) + b"\xff\xd8\xff\xd9")])
    sections = x3f.section_table(table(spark, a=data, cut=data[:-1]))
    rows = {r.path: r for r in sections.collect()}
    assert rows["a"].sensor == "SdQuattro" and bytes(rows["a"].jpeg) == b"\xff\xd8\xff\xd9" and rows["cut"].error
    assert [(r.name, r.kind, r.text) for r in camf.entry_table(sections.filter("error is null")).collect()] == [("Tag", "Text", "hello world")]
    assert [r.error for r in x3f.scanline_table(sections).collect()] == ["InvalidGeometry"]
    tiny = {0x25: ([(2, 2), (2, 2), (4, 4)], (4, 4))}
    lines = x3f.scanline_table(sections, tiny).filter("plane = 2").orderBy("y").collect()
    assert [r.samples for r in lines][:2] == [[101, 102, 104, 101], [104, 98, 101, 99]]


def test_calibration_matrices_and_properties():
    matrix = b"CMbM" + fx.longs([0, 20 + 4 + 24 + 8, 20, 24]) + b"Mat\0" + fx.longs([6, 1, 24 + 24, 4, 0, 0]) + fx.shorts([1, 2, 3, 65535])
    props = b"CMbP" + fx.longs([0, 0, 20, 24]) + b"Pro\0" + fx.longs([1, 24 + 16, 0, 2]) + b"k\0value\0"
    props = props[:8] + fx.longs([len(props)]) + props[12:]
    found = camf.entries(matrix + props)
    assert found[0]["vals"] == [1, 2, 3, 65535] and found[0]["dims"] == [4] and found[1]["props"] == {"k": "value"}


def test_files_and_outputs(spark, tmp_path):
    (tmp_path / "a.dng").write_bytes(fx.dng(fx.rgb(1, 1, [1, 2, 3])))
    (tmp_path / "b.txt").write_bytes(b"text")
    got = {r.path.rsplit("/", 1)[1]: r.container for r in files.with_container(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.dng": "Tiff", "b.txt": "Unknown"}
    px = spark.createDataFrame([(0, 0, y, x, 256 * y + x) for y in range(2) for x in range(3)], "image_id int, plane int, y long, x int, code int")
    lines = {r.y: bytes(r.bytes) for r in files.plane_bytes(px).collect()}
    assert lines == {0: fx.shorts([0, 1, 2]), 1: fx.shorts([256, 257, 258])}
    colour = px.selectExpr("image_id", "y", "x", "x * 1.0D as r", "y * 1.0D as g", "0.5D as b")
    content = bytes(files.pfm(colour, 2, 3).first().content)
    assert content.startswith(b"PF\n3 2\n-1.0\n") and np.frombuffer(content[12:], "<f4")[:6].tolist() == [0, 1, 0.5, 1, 1, 0.5]


def test_files_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dng").write_bytes(b"FOVbxxxx")
    query = files.with_container(stream_files(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    query.stop()
    assert [r.container for r in spark.table("arrived").collect()] == ["X3f"]


def test_files_are_written_new_and_in_parts(spark, tmp_path):
    px = spark.createDataFrame([(0, p, y, x, 256 * y + x + p) for p in range(2) for y in range(5) for x in range(3)], "image_id int, plane int, y long, x int, code int")
    assert files.write_new(files.plane_parts(px), str(tmp_path)) == ["image-0-layer-0.u16le", "image-0-layer-1.u16le"]
    assert (tmp_path / "image-0-layer-1.u16le").read_bytes() == fx.shorts([256 * y + x + 1 for y in range(5) for x in range(3)])
    with pytest.raises(Exception, match="exist"):
        files.write_new(files.plane_parts(px), str(tmp_path))
    colour = px.filter("plane = 0").selectExpr("image_id", "y", "x", "x * 1.0D as r", "y * 1.0D as g", "0.5D as b")
    parts = files.pfm_parts(colour, 5, 3)
    files.write_new(parts.selectExpr("'a.pfm' as name", "ord", "bytes"), str(tmp_path))
    data = (tmp_path / "a.pfm").read_bytes()
    assert data == bytes(files.pfm(colour, 5, 3).first().content) and np.frombuffer(data[12:], "<f4")[:4].tolist() == [0, 4, 0.5, 1]


def test_calibration_of_another_type_is_an_error(spark):
    good = [(b"IMA2", b"SECi" + fx.longs([0x20000, 1, 0x25, 4, 4, 0])), (b"CAMF", fx.camf2())]
    old = [(b"IMA2", b"SECi" + fx.longs([0x20000, 3, 6, 4, 4, 0])), (b"CAMF", fx.camf2())]
    sections = x3f.section_table(table(spark, new=fx.x3f(good), old=fx.x3f(old, 0x20002)))
    found = {r.path: r for r in x3f.calibration_table(sections).collect()}
    assert found["new"].error == "InvalidContainer" and found["new"].decoded is None
    assert found["old"].error is None and b"hello world" in bytes(found["old"].decoded)


def test_sof3_predictors_against_plain_loops():
    from photonlake.functions import sof3
    from photonlake.plans import encode

    rng = np.random.default_rng(2)
    for kind in range(1, 8):
        for shape, restart, point in (((9, 7, 1), 0, 0), ((8, 5, 3), 4, 2), ((1, 6, 2), 0, 0), ((6, 1, 1), 2, 0)):
            samples = rng.integers(0, 1 << 16, shape)
            frame, got = sof3.decode(encode.sof3(samples, 16, kind, restart, point))
            assert (frame.height, frame.width, len(frame.components)) == shape and (got == samples >> point << point).all()


def test_masks_of_lossy_jpeg_are_sent_to_their_codec():
    assert dng.frame_marker(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0") == 0xC0
    for broken, kind in ((b"xx", "InvalidContainer"), (b"\xff\xd8\xff", "Truncated"), (b"\xff\xd8\xff\xe0\x00\x01", "InvalidContainer"), (b"\xff\xd8", "Truncated")):
        assert tiff.guarded(dng.frame_marker, broken)[1] == kind


def test_defect_lists_are_checked():
    from photonlake.operators import stencil

    assert stencil.checked_run_list([1, 1, 99, 3, 98, 0, 2, 2, 97, 0], 3, 4) == [(1, 1), (1, 3), (2, 2)]
    for bad in ([-1, 0], [3, 0], [0.5, 0], [1], [1, -1], [1, 4, 0, 0], [1, 1.5, 0, 0], [1, 1], [1, 1, 99]):
        with pytest.raises(ValueError, match="bad-pixel"):
            stencil.checked_run_list(bad, 3, 4)
    with pytest.raises(ValueError, match="narrow"):
        stencil.native_interior(0, 11)
    assert stencil.native_interior(5, 40) == (6, 17)


def test_a_defect_without_a_donor_and_a_wild_colour_are_errors(spark):
    from photonlake.operators import render, stencil

    px = spark.createDataFrame([(0, 2, y, x, 0.5, 1, 0) for y in range(3) for x in range(3)] + [(1, 2, 0, 0, 0.5, 1, 0), (1, 2, 0, 1, 0.25, 0, 0)], "image_id int, plane int, y long, x int, v double, causes int, clip int")
    assert [(r.image_id, r.n) for r in stencil.unresolved(stencil.repair(px)).collect()] == [(0, 9)]
    colours = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, float("inf"), 0.0, 0.0), (2, 0.0, float("nan"), 0.0)], "image_id int, r double, g double, b double")
    assert sorted(r.image_id for r in render.not_finite(colours).collect()) == [1, 2]


def test_files_are_inspected_and_dumped(spark, tmp_path):
    from photonlake import inspect
    from photonlake.plans import encode

    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(1)
    small = {k: rng.integers(0, 4096, s) for k, s in ((0, (2, 2)), (1, (2, 2)), (2, (4, 4)))}
    entries = encode.text_entry("Tag", "hello") + encode.matrix_entry("Long", 6, [14], range(14))
    good = encode.container([(b"IMA2", encode.raw_section([small[0], small[1], small[2]], 0x25, (1, 2, 3), False)), (b"CAMF", encode.calibration_section(entries, 5, 9))], 0x40002)
    (tmp_path / "in" / "a.x3f").write_bytes(good)
    content = files.read_files(spark, str(tmp_path / "in"))
    text = inspect.report(content)
    assert any(line.endswith("Tag\thello") for line in text) and any("[14] [0.0" in line and "11.0]" in line for line in text)
    assert any(line.endswith("error\tInvalidGeometry") for line in text)  # no camera has so small a sensor
    assert inspect.dump(content, str(tmp_path)) == ["a.x3f-calibration.bin"] and (tmp_path / "a.x3f-calibration.bin").read_bytes() == entries
    assert inspect.main([]) == 1


def test_tiles_keep_their_budgets():
    from photonlake.sources.errors import Limits

    data = fx.dng(fx.rgb(2, 1, range(6)))
    assert tiff.guarded(dng.parse, data, Limits())[1] is None
    assert tiff.guarded(dng.parse, data, Limits(max_frame_samples=5))[1] == "ResourceLimit"
    assert dng.integral_pair([1.0, 2.5]) is None and dng.integral_pair([1.0, 2.0]) == [1, 2]
