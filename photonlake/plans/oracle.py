"""The queries of plans/queries.py in DuckDB SQL, written apart from the Spark plans."""

from __future__ import annotations

# the virtual sensor
PX = """px AS (SELECT vec_id::BIGINT y, i::INT x, floor((embedding[i + 1]::DOUBLE + 1.0) * 2048)::BIGINT code FROM embeddings, range(64) t(i))"""
NH = "nh AS (SELECT max(vec_id) + 1 n FROM embeddings)"
PLANES = f"""{PX}, {NH}, pl AS (SELECT 2 plane, y, x, code FROM px UNION ALL SELECT 0, y, x - 32, code FROM px, nh WHERE y < n // 2 AND x >= 32
  UNION ALL SELECT 1, y - n // 2, x, code FROM px, nh WHERE y >= n // 2 AND y < 2 * (n // 2) AND x < 32)"""
IL = f"{PX}, {NH}, il AS (SELECT y, (x // 3)::INT x, x % 3 channel, code FROM px WHERE x < 63)"
LIN = f"{IL}, lin AS (SELECT y, x, channel, code / 4096.0 v FROM il)"
HIST = f"{PX}, hist AS (SELECT code, count(*) n FROM px WHERE x <= 1 OR x >= 62 GROUP BY code)"
BLACK = f"""{HIST}, cum AS (SELECT code, n, sum(n) OVER (ORDER BY code) c, sum(n) OVER () t FROM hist), bl AS (SELECT min(code) black FROM cum WHERE c > t // 2)"""
CAUSES = "(CASE WHEN (y * 7 + x * 13) % 97 = 0 THEN 1 ELSE 0 END + CASE WHEN y % 8 = 3 AND x % 8 = 5 THEN 2 ELSE 0 END)"
CLIP = f"(CASE WHEN code >= 2900 AND {CAUSES} = 0 THEN 1 ELSE 0 END)"
LOW = f"{PLANES}, low AS (SELECT plane, y, x, code / 4096.0 v, {CLIP} influence FROM pl WHERE plane <> 2)"


def _upsampled(source: str, values: str, influence: str = "influence") -> str:
    """Bilinear at half-pixel alignment by looking up the four neighbours of each fine sample."""
    picked = ", ".join(f"sum(s.{v} * wy * wx) {v}" for v in values.split())
    return f"""axis_y AS (SELECT p, least(greatest(floor((p - 0.5) / 2) + k, 0), n // 2 - 1)::BIGINT q, CASE WHEN k = 0 THEN 1 - ((p - 0.5) / 2 - floor((p - 0.5) / 2)) ELSE (p - 0.5) / 2 - floor((p - 0.5) / 2) END wy
      FROM nh, range((SELECT n // 2 * 2 FROM nh)) a(p), range(2) b(k)),
    axis_x AS (SELECT p, least(greatest(floor((p - 0.5) / 2) + k, 0), 31)::INT q, CASE WHEN k = 0 THEN 1 - ((p - 0.5) / 2 - floor((p - 0.5) / 2)) ELSE (p - 0.5) / 2 - floor((p - 0.5) / 2) END wx
      FROM range(64) a(p), range(2) b(k)),
    up AS (SELECT s.plane, ay.p y, ax.p::INT x, {picked}, max(s.{influence}) influence FROM {source} s JOIN axis_y ay ON ay.q = s.y JOIN axis_x ax ON ax.q = s.x GROUP BY ALL)"""


BILINEAR = f"""{LOW}, {_upsampled("low", "v")}, tp AS (SELECT y, x, code / 4096.0 v, {CLIP} influence FROM px),
  rec AS (SELECT t.y, t.x, a.v v0, b.v v1, t.v v2, greatest(a.influence, b.influence, t.influence) clip FROM tp t JOIN up a ON a.plane = 0 AND a.y = t.y AND a.x = t.x JOIN up b ON b.plane = 1 AND b.y = t.y AND b.x = t.x)"""
PAIRS = f"""{PLANES}, gd AS (SELECT y // 2 y, (x // 2)::INT x, sum(code) guide, max(CASE WHEN code >= 2900 THEN 1 ELSE 0 END) influence FROM px GROUP BY ALL),
  pairs AS (SELECT p.plane, p.y, p.x, g.guide, p.code * 4 source, g.influence FROM pl p JOIN gd g USING (y, x) WHERE plane <> 2)"""
FIT = f"""{PAIRS}, box AS (SELECT a.plane, a.y, a.x, count(*) n, sum(b.guide)::DOUBLE sg, sum(b.source)::DOUBLE ss, sum(b.guide * b.guide)::DOUBLE sgg, sum(b.guide * b.source)::DOUBLE sgs, max(b.influence) influence
    FROM pairs a JOIN pairs b ON a.plane = b.plane AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY ALL),
  fit0 AS (SELECT plane, y, x, n, (sgs / n - sg / n * (ss / n)) / (greatest(sgg / n - sg / n * (sg / n), 0) + 1e-10) slope, ss / n ms, sg / n mg, influence FROM box),
  fit AS (SELECT plane, y, x, n, slope, ms - slope * mg icpt, influence FROM fit0)"""
# levels of the DNG queries
BLACK_AT = "10 * (ry % 2) + 5 * (rx % 3) + 3 * channel + (rx * 7 % 5 - 2)"
DEN = """phases AS (SELECT c, max(10 * r + 5 * k + 3 * c + h) most FROM range(3) a(c), range(2) b(r), range(3) d(k), (SELECT x % 3 ph, max(x * 7 % 5 - 2) h FROM range(19) e(x) GROUP BY 1) WHERE ph = k GROUP BY c),
  den AS (SELECT c channel, 2600.0 + 100 * c - most denominator FROM phases)"""
ACTIVE = "greatest(0, least(y - 1, n - 3)) ry, greatest(0, least(x - 1, 18)) rx"

GAIN_CTE = """gr(i, g) AS (VALUES (0, 1.0), (1, 1.5), (2, 2.0), (3, 0.5), (4, 0.75), (5, 1.25))"""


def _gain(top: str, left: str, height: str, width: str, source: str, out: str = "gained") -> str:
    return f"""ga AS (SELECT *, greatest(0, least(1, ((y - {top} + 0.5) / ({height}) - 0.25) / 0.5)) fy, greatest(0, least(2, ((x - {left} + 0.5) / ({width}) - 0.25) / 0.25)) fx FROM {source}),
    gb AS (SELECT *, floor(fy)::INT r0, least(floor(fy)::INT + 1, 1) r1, floor(fx)::INT c0, least(floor(fx)::INT + 1, 2) c1 FROM ga),
    {out} AS (SELECT gb.* EXCLUDE (v), least(v * ((a.g * (1 - (fx - c0)) + b.g * (fx - c0)) * (1 - (fy - r0)) + (c.g * (1 - (fx - c0)) + d.g * (fx - c0)) * (fy - r0)), 1.0) v
      FROM gb JOIN gr a ON a.i = r0 * 3 + c0 JOIN gr b ON b.i = r0 * 3 + c1 JOIN gr c ON c.i = r1 * 3 + c0 JOIN gr d ON d.i = r1 * 3 + c1)"""


def _point(expression: str) -> str:
    return f"WITH {LIN} SELECT y, x, channel, round({expression} + 1e-9, 6) v FROM lin, nh"


def _clamp(expression: str) -> str:
    return f"greatest(-1.0, least(1.0, {expression}))"


BYTES = """bytes AS (SELECT page_id, i, ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::INT b FROM (SELECT page_id, hex(encode(coalesce(html, ''))) hx FROM pages) p, range((SELECT max(octet_length(encode(html))) FROM pages)) t(i) WHERE 2 * i < length(hx))"""
PACKED = f"""{PX}, packed AS (SELECT y, i, bit_or(b) AS byte FROM (
    SELECT y, (x // 2) * 3 i, code >> 4 b FROM px WHERE x % 2 = 0 UNION ALL SELECT y, (x // 2) * 3 + 1, (code & 15) << 4 FROM px WHERE x % 2 = 0
    UNION ALL SELECT y, (x // 2) * 3 + 1, code >> 8 FROM px WHERE x % 2 = 1 UNION ALL SELECT y, (x // 2) * 3 + 2, code & 255 FROM px WHERE x % 2 = 1) GROUP BY ALL)"""
_ORIENTED = {1: ("y", "x"), 2: ("y", "63 - x"), 3: ("n - 1 - y", "63 - x"), 4: ("n - 1 - y", "x"), 5: ("y", "x"), 6: ("n - 1 - y", "x"), 7: ("n - 1 - y", "63 - x"), 8: ("y", "63 - x")}
_PREDICT = {1: "a", 2: "b", 3: "c", 4: "a + b - c", 5: "a + ((b - c) >> 1)", 6: "b + ((a - c) >> 1)", 7: "(a + b) >> 1"}
_CASE = lambda column, values: "CASE " + " ".join(f"WHEN {column} = {k!r} THEN {v!r}" for k, v in values.items())


def _sof3_diffs(kind: int) -> str:
    return f"""WITH {PX}, n AS (SELECT a.y, a.x, a.code, l.code a, u.code b, d.code c FROM px a LEFT JOIN px l ON l.y = a.y AND l.x = a.x - 1 LEFT JOIN px u ON u.y = a.y - 1 AND u.x = a.x LEFT JOIN px d ON d.y = a.y - 1 AND d.x = a.x - 1)
      SELECT y, x, ((code - CASE WHEN y = 0 AND x = 0 THEN 2048 WHEN y = 0 THEN a WHEN x = 0 THEN b ELSE {_PREDICT[kind]} END) % 65536 + 65536) % 65536 d FROM n"""


KEYSTREAM = """st(k, s) AS (SELECT 0::BIGINT, 51749 % 244944 UNION ALL SELECT k + 1, (((1597 * s) % 4294967296 + 51749) % 4294967296) % 244944 FROM st WHERE k < 244943)"""

ORACLE_SQL = {
    "plane_stats": f"WITH {PLANES} SELECT plane, max(x)::BIGINT + 1 width, max(y) + 1 height, sum(code)::BIGINT sum, min(code) min, max(code) max FROM pl GROUP BY plane",
    "code_histogram": f"WITH {HIST} SELECT code, n FROM hist",
    "black_level": f"WITH {BLACK} SELECT 2 plane, black, round(sum((code - black) ** 2 * n) / sum(n), 6) noise_variance FROM hist, bl WHERE abs(code - black) <= 64 GROUP BY black",
    "normalize_plane": f"WITH {BLACK} SELECT y, x, round((code - black)::DOUBLE / (4095 - black), 6) v FROM px, bl",
    "normalized_stats": f"""WITH {BLACK}, v AS (SELECT (code - black)::DOUBLE / (4095 - black) v FROM px, bl)
        SELECT 2 plane, count(*) n, round(min(v), 6) least, round(max(v), 6) greatest, round(avg(v), 6) mean FROM v""",
    "linearize_lut": f"WITH {PX} SELECT y, x, floor(least(greatest(code, 0), 2047) ** 2 / 1024)::DOUBLE v FROM px",
    "black_repeat_denominator": f"WITH {DEN} SELECT channel::BIGINT channel, denominator::DOUBLE denominator FROM den",
    "dng_normalize": f"WITH {IL}, {DEN}, a AS (SELECT *, {ACTIVE} FROM il, nh) SELECT y, x, a.channel, round((code - ({BLACK_AT.replace('channel', 'a.channel')}))::DOUBLE / denominator, 6) v FROM a JOIN den ON den.channel = a.channel",
    "sample_flags": f"""WITH {IL} SELECT y, x, channel, CASE WHEN code >= 4095 THEN 1 ELSE 0 END + CASE WHEN code >= 2600 + 100 * channel THEN 2 ELSE 0 END
        + CASE WHEN y < 1 OR y >= n - 1 OR x < 1 OR x >= 20 THEN 4 ELSE 0 END flags FROM il, nh""",
    "corrected_flags": f"""WITH {IL} SELECT 8 + CASE WHEN code >= 4095 THEN 1 ELSE 0 END + CASE WHEN code >= 2600 + 100 * channel THEN 2 ELSE 0 END
        + CASE WHEN y < 1 OR y >= n - 1 OR x < 1 OR x >= 20 THEN 4 ELSE 0 END flags, count(*) n FROM il, nh GROUP BY 1""",
    "opcode_map_table": _point("((1 + 600 * least(round(v * 65535), 99)) * 37 % 65536)::DOUBLE / 65535"),
    "opcode_map_table_codes": f"WITH {IL} SELECT y, x, channel, (least(code, 2999) * 11 % 5000)::DOUBLE v FROM il",
    "opcode_polynomial": _point(_clamp("-0.25 + ((-0.5 * v + 1.25) * v + 0.5) * v")),
    "opcode_gain_map": f"WITH {LIN}, {GAIN_CTE}, {_gain('0', '0', '(SELECT n FROM nh)', '21', 'lin')} SELECT y, x, channel, round(v + 1e-9, 6) v FROM gained",
    "opcode_row_delta": _point(_clamp("v + (y % 9 - 4) / 16.0")),
    "opcode_col_delta": _point(_clamp("v + (x % 7 - 3) / 8.0")),
    "opcode_row_scale": _point(_clamp("v * (1 + (y % 5) / 4.0)")),
    "opcode_col_scale": _point(_clamp("v * (0.5 + (x % 6) / 4.0)")),
    "opcode_pitch_area": _point(f"CASE WHEN y BETWEEN 2 AND 39 AND x BETWEEN 1 AND 19 AND (y - 2) % 3 = 0 AND (x - 1) % 2 = 0 AND channel >= 1 THEN {_clamp('v * (2.0 - ((x - 1) // 2) / 8.0)')} ELSE v END"),
    "opcode_trim": f"WITH {LIN} SELECT y, x, channel, round(v + 1e-9, 6) v FROM lin, nh WHERE y >= 1 AND y < n - 3 AND x >= 2 AND x < 20",
    "opcode_chain": f"""WITH {LIN}, {GAIN_CTE}, tr AS (SELECT lin.* FROM lin, nh WHERE y >= 1 AND y < n - 1 AND x >= 1 AND x < 20), {_gain('1', '1', '(SELECT n - 2 FROM nh)', '19', 'tr')},
        po AS (SELECT y, x, channel, CASE WHEN channel < 2 THEN {_clamp('0.125 + 0.75 * v')} ELSE v END v FROM gained)
        SELECT y, x, channel, round(CASE WHEN y BETWEEN 4 AND 19 AND x BETWEEN 3 AND 14 AND (y - 4) % 4 = 0 THEN {_clamp('v * CASE (y - 4) // 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.75 WHEN 2 THEN 1.25 ELSE 1.5 END')} ELSE v END + 1e-9, 6) v FROM po""",
    "profile_gain": f"""WITH {LIN}, rgb AS (SELECT y, x, max(v) FILTER (channel = 0) r, max(v) FILTER (channel = 1) g, max(v) FILTER (channel = 2) b FROM lin GROUP BY ALL),
        c AS (SELECT y, x, greatest(0, least(1, ((y + 0.5) / n - 0.25) / 0.5)) fy, greatest(0, least(1, ((x + 0.5) / 21 - 0.25) / 0.5)) fx,
          greatest(0, least(1, (r * 0.25 + g * 0.5 + b * 0.125 + least(r, g, b) * 0.0625 + greatest(r, g, b) * 0.0625) * 1.5)) ** 2 * 3 t FROM rgb, nh),
        e AS (SELECT c.*, i, j, k, (CASE WHEN i = 0 THEN 1 - (fy - y0) ELSE fy - y0 END) * (CASE WHEN j = 0 THEN 1 - (fx - x0) ELSE fx - x0 END) * (CASE WHEN k = 0 THEN 1 - (t - t0) ELSE t - t0 END) w,
          least(y0 + i, 1) gy, least(x0 + j, 1) gx, least(t0 + k, 2) gt
          FROM (SELECT *, least(floor(fy), 1) y0, least(floor(fx), 1) x0, least(floor(t), 2) t0 FROM c) c, range(2) a(i), range(2) b(j), range(2) d(k))
        SELECT y, x, round(sum(w * (1 + ((gy * 2 + gx) * 3 + gt) / 8.0)), 4) gain FROM e GROUP BY ALL""",
    "parity_diff_encode": f"""WITH {PX} SELECT a.y, a.x, a.code - CASE WHEN a.x >= 2 THEN l.code WHEN a.y >= 2 THEN u.code ELSE 100 END d FROM px a
        LEFT JOIN px l ON l.y = a.y AND l.x = a.x - 2 LEFT JOIN px u ON u.x = a.x AND u.y = a.y - 2""",
    "parity_predict_decode": f"WITH {PX} SELECT y, x, code FROM px",
    "prefix_byte_decode": f"WITH {BYTES} SELECT page_id, count(*) n, sum(b)::BIGINT total, sum(b * (i % 251 + 1))::BIGINT weighted, 0::BIGINT wrong FROM bytes GROUP BY page_id",
    "keystream_xor": f"""WITH RECURSIVE {KEYSTREAM}, {BYTES}, e AS (SELECT page_id, i, xor(b, (s * 256 // 244944)::INT) e FROM bytes JOIN st ON st.k = (i + page_id * 9973) % 244944)
        SELECT page_id, count(*) n, sum(e)::BIGINT total, sum(e * (i % 251 + 1))::BIGINT weighted FROM e GROUP BY page_id""",
    "pack_12bit": f"WITH {PACKED} SELECT y, i, byte FROM packed",
    "unpack_10bit": f"""WITH {PACKED}, bits AS (SELECT y, i * 8 + k pos, (byte >> (7 - k)) & 1 bit FROM packed, range(8) t(k))
        SELECT y, (pos // 10)::INT i, sum(bit << (9 - pos % 10))::BIGINT code FROM bits WHERE pos < 760 GROUP BY ALL""",
    "tile_assemble": f"WITH {PX} SELECT y, x, code FROM px",
    "tile_samples": f"""WITH {PX}, {NH} SELECT (ty * 4 + tx)::BIGINT tile, (ly * 20 + lx)::INT i, coalesce(code, 999) code
        FROM range((SELECT (n + 23) // 24 FROM nh)) a(ty), range(4) b(tx), range(24) c(ly), range(20) d(lx) LEFT JOIN px ON px.y = ty * 24 + ly AND px.x = tx * 20 + lx""",
    "uninterleave": f"""WITH {PX}, {NH}, ry AS (SELECT i dest, row_number() OVER (ORDER BY i % 3, i) - 1 stored FROM range((SELECT n FROM nh)) t(i)), rx AS (SELECT i dest, row_number() OVER (ORDER BY i % 5, i) - 1 stored FROM range(64) t(i))
        SELECT ry.dest y, rx.dest::INT x, code FROM px JOIN ry ON ry.stored = y JOIN rx ON rx.stored = x""",
    "orient_undo": f"WITH {PX}, {NH} " + " UNION ALL ".join(f"SELECT {o} orientation, {y} y, sum(code * ({x} + 1))::BIGINT weighted FROM px, nh GROUP BY 2" for o, (y, x) in _ORIENTED.items()),
    "defect_map": f"""WITH {PX}, bad(y, x) AS (VALUES (1, 1), (1, 3), (2, 2), (11, 5), (11, 60)), c AS (SELECT px.y, px.x, CASE WHEN bad.y IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN px.y % 8 = 3 AND px.x % 8 = 5 THEN 2 ELSE 0 END causes
        FROM px LEFT JOIN bad ON bad.y = px.y AND bad.x = px.x) SELECT y, x, causes FROM c WHERE causes <> 0""",
    "repair_idw": f"""WITH {PX}, c AS (SELECT y, x, code / 4096.0 v, {CAUSES} causes, {CLIP} clip FROM px),
        met AS (SELECT m.y, m.x, greatest(abs(i), abs(j)) ring, 1.0 / (i * i + j * j) w, d.v, d.clip FROM c m, range(-8, 9) a(i), range(-8, 9) b(j), c d WHERE m.causes <> 0 AND (i <> 0 OR j <> 0) AND d.y = m.y + i AND d.x = m.x + j AND d.causes = 0),
        r AS (SELECT y, x, ring, sum(w * v) / sum(w) v, max(clip) influence FROM met GROUP BY ALL)
        SELECT y, x, round(arg_min(v, ring), 6) v, arg_min(influence, ring) influence FROM r GROUP BY y, x""",
    "clip_mask": f"WITH {PX} SELECT y, x, {CLIP} clip FROM px",
    "downsample_2x2": f"WITH {PX} SELECT y // 2 y, (x // 2)::INT x, avg(code / 4096.0) v, max({CLIP}) influence FROM px GROUP BY 1, 2",
    "local_regression": f"WITH {FIT} SELECT plane, y, x, n, round(slope, 6) slope, round(icpt, 4) intercept, influence FROM fit",
    "upsample_bilinear": f"WITH {LOW}, {_upsampled('low', 'v')} SELECT plane, y, x, round(v, 6) v, influence FROM up",
    "reconstruct_bilinear": f"WITH {BILINEAR} SELECT y, x, round(v0, 6) v0, round(v1, 6) v1, round(v2, 6) v2, clip FROM rec",
    "reconstruct_guided": f"""WITH {FIT}, {_upsampled("fit", "slope icpt")}, tp AS (SELECT y, x, code / 4096.0 v, {CLIP} influence FROM px)
        SELECT t.y, t.x, round(a.slope * t.v + a.icpt / 16384.0, 5) v0, round(b.slope * t.v + b.icpt / 16384.0, 5) v1, round(t.v, 5) v2, greatest(t.influence, a.influence, b.influence) clip
        FROM tp t JOIN up a ON a.plane = 0 AND a.y = t.y AND a.x = t.x JOIN up b ON b.plane = 1 AND b.y = t.y AND b.x = t.x""",
    "color_matrix": f"""WITH {BILINEAR}, g AS (SELECT y, x, v0 * 0.75 a, v1 * 0.625 b, v2 * 0.5 c FROM rec)
        SELECT y, x, round(1.5 * a - 0.25 * b - 0.125 * c, 6) r, round(-0.5 * a + 1.75 * b - 0.25 * c, 6) g, round(0.0625 * a - 0.75 * b + 1.875 * c, 6) b FROM g""",
    "rgba": f"WITH {BILINEAR} SELECT y, x, round(v0, 6) r, round(v1, 6) g, round(v2, 6) b, 1.0::DOUBLE a FROM rec",
    "clip_combined": f"WITH {BILINEAR} SELECT y, sum(clip)::BIGINT clipped, count(*) n FROM rec GROUP BY y",
    "residual_summary": f"""WITH {LOW}, {_upsampled('low', 'v')}, r AS (SELECT u.plane, round((u.v - code / 4096.0) * 4096, 4) r FROM up u JOIN px ON px.y = u.y AND px.x = u.x WHERE {CAUSES.replace('y ', 'px.y ').replace('x ', 'px.x ')} = 0)
        SELECT plane, count(*) n, round(avg(r), 4) bias, round(sqrt(avg(r * r)), 4) rms, round(quantile_disc(abs(r), 0.95), 4) p95 FROM r GROUP BY plane""",
    "cause_counts": f"""WITH {PX}, c AS (SELECT {CAUSES} + 4 * {CLIP} causes FROM px) SELECT 2 plane, causes, count(*) n, causes <> 0 excluded, bit_count(causes)::INT n_causes FROM c GROUP BY causes""",
    "cause_marginals": f"""WITH {PX}, c AS (SELECT {CAUSES} + 4 * {CLIP} causes FROM px) SELECT 2 plane, count(*) total, count(*) FILTER (causes <> 0) excluded, count(*) FILTER (causes & 1 <> 0) bad, count(*) FILTER (causes & 2 <> 0) autofocus,
        count(*) FILTER (causes & 4 <> 0) encoded_max, count(*) FILTER (bit_count(causes) > 1) overlapping FROM c""",
    "overlap_ranges": """WITH r AS (SELECT o_custkey k, o_orderkey * 100 AS "start", floor(o_totalprice / 3)::BIGINT "length" FROM orders),
        e AS (SELECT *, max("start" + "length") OVER (PARTITION BY k ORDER BY "start", "length" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) earlier_end FROM r) SELECT * FROM e WHERE earlier_end > "start" """,
    "tag_budget": """WITH u AS (SELECT page_id % 10 image_id, page_id, sum(octet_length(encode(html))) OVER (PARTITION BY page_id % 10 ORDER BY page_id ROWS UNBOUNDED PRECEDING)::BIGINT used FROM pages) SELECT *, used > 20000 AS "over" FROM u""",
    "duplicate_tags": "SELECT l_orderkey image_id, 0 dir_ord, l_linenumber tag_id, count(*) n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "container_probe": """WITH h AS (SELECT doc_id, left((['464F5662', '49492A00', '4D4D002A', '4949', ''])[doc_id % 5 + 1] || hex(encode(coalesce(text, ''))), 8) m FROM documents)
        SELECT doc_id, CASE m WHEN '464F5662' THEN 'X3f' WHEN '49492A00' THEN 'Tiff' WHEN '4D4D002A' THEN 'Tiff' ELSE 'Unknown' END container FROM h""",
    "white_balance_lookup": f"""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 14 END light, o_custkey % 15 setting FROM orders) SELECT o_orderkey, coalesce(
        {_CASE('light', {1: 'Sunlight', 9: 'Sunlight', 2: 'Fluorescent', 3: 'Incandescent', 4: 'Flash', 10: 'Overcast', 11: 'Shade'})} END,
        {_CASE('setting', {1: 'Auto', 2: 'Sunlight', 3: 'Shade', 4: 'Overcast', 5: 'Incandescent', 6: 'Fluorescent', 7: 'Flash', 8: 'Custom', 12: 'AutoLSP'})} END) preset FROM e""",
    "status_map": f"""WITH e AS (SELECT (['NotRecognized', 'UnsupportedFormat', 'UnsupportedFeature', 'ResourceLimit', 'Allocation', 'InvalidContainer', 'Truncated', 'InvalidOffset', 'InvalidTag', 'InvalidGeometry', 'Other'])[l_orderkey % 11 + 1] error FROM lineitem)
        SELECT error, count(*) n, {_CASE('error', {'NotRecognized': 7, 'UnsupportedFormat': 3, 'UnsupportedFeature': 3, 'ResourceLimit': 5, 'Allocation': 6})} ELSE 4 END status FROM e GROUP BY error""",
    "codec_names": f"WITH e AS (SELECT p_partkey, ([1, 7, 34892, 52546, 8])[p_partkey % 5 + 1] c FROM part) SELECT p_partkey, {_CASE('c', {7: 1, 52546: 2, 1: 3, 34892: 4})} ELSE 0 END codec FROM e",
    "ifd_pivot": "WITH t AS (SELECT l_orderkey image_id, l_linenumber k, l_partkey v FROM lineitem WHERE l_linenumber <> 7) SELECT image_id, "
    + ", ".join(f"max(v) FILTER (k = {i}) {name}" for i, name in enumerate(("analog_balance", "as_shot_neutral", "as_shot_white_xy", "color_matrix_1", "color_matrix_2", "forward_matrix_1"), 1))
    + ", max(v) FILTER (k = 7) forward_matrix_2 FROM t GROUP BY image_id",
}
ORACLE_SQL |= {f"sof3_predict_{k}": f"WITH {PX} SELECT y, x, code FROM px" for k in (1, 2, 3, 4)}
ORACLE_SQL |= {"sof3_restart": f"WITH {PX} SELECT y, x, code FROM px", "sof3_point": f"WITH {PX} SELECT y, x, code // 4 * 4 code FROM px"}
ORACLE_SQL |= {f"sof3_diffs_{k}": _sof3_diffs(k) for k in range(1, 8)}
