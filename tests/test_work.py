"""Work that grows with the input and no faster."""

import time

from photonlake.functions import cipher
from photonlake.plans import queries
from photonlake.plans.registry import QUERIES
from tests.conftest import SMALL


def test_a_long_page_is_cut_in_one_pass(spark, tmp_path):
    html = "".join(chr(32 + i * 7 % 90) if i % 50 else "é\0€" for i in range(300_000))
    data = html.encode()
    spark.createDataFrame([(5, html), (6, None), (7, ""), (8, "a\0")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    began = time.time()
    got = {r.page_id: (r.n, r.total, r.wrong) for r in queries.prefix_byte_decode(spark, str(tmp_path)).collect()}
    assert got == {5: (len(data), sum(data), 0), 8: (2, 97, 0)}
    got = {r.page_id: (r.n, r.total) for r in queries.keystream_xor(spark, str(tmp_path)).collect()}
    key = cipher.keystream(cipher.MODULUS)
    want = lambda p, page: (len(p), sum(b ^ int(key[(i + page * 9973) % cipher.MODULUS]) for i, b in enumerate(p)))
    assert got == {5: want(data, 5), 8: want(b"a\0", 8)}
    assert time.time() - began < 90  # looked up byte by byte in a text, these pages take many times as long


def test_tags_are_read_once_for_all_look_ups(spark):
    plan = QUERIES["tiff_lookups"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2  # files are built, then parsed
