"""The queries of plans/rendered.py in DuckDB SQL, with the camera's calibration as plain values."""

from __future__ import annotations

from photonlake.plans.oracle import NH, PLANES

SENSOR = f"{PLANES}, sz AS (SELECT n // 2 h, n // 2 * 2 n2 FROM nh), ps AS (SELECT pl.* FROM pl, sz WHERE plane <> 2 OR y < n2)"
LEVELS = f"""{SENSOR}, hi AS (SELECT plane, code, count(*) n FROM ps WHERE (plane = 2 AND (x <= 1 OR x >= 62)) OR (plane <> 2 AND (x = 0 OR x = 31)) GROUP BY ALL),
  cu AS (SELECT plane, code, sum(n) OVER (PARTITION BY plane ORDER BY code) c, sum(n) OVER (PARTITION BY plane) t FROM hi),
  me AS (SELECT plane, min(code) black FROM cu WHERE c > t // 2 GROUP BY plane),
  lv AS (SELECT plane, black, sum((code - black) ** 2 * n) / sum(n) / ((4095 - black) * (4095 - black)) noise FROM hi JOIN me USING (plane) WHERE abs(code - black) <= 64 GROUP BY plane, black)"""
LAYERS = f"""{LEVELS}, bad(plane, y, x) AS (VALUES (2, 1, 1), (2, 1, 3), (2, 2, 2), (2, 11, 5), (2, 11, 60), (0, 7, 3), (0, 8, 3), (0, 8, 30), (1, 7, 3), (1, 8, 3), (1, 8, 30)),
  ca AS (SELECT ps.plane, ps.y, ps.x, (code - black)::DOUBLE / (4095 - black) v, code, black, noise, CASE WHEN bad.plane IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN (ps.plane = 2 AND ps.x BETWEEN 5 AND 61 AND (ps.x - 5) % 8 = 0 AND ((ps.y >= 3 AND ps.y <= n2 - 5 AND (ps.y - 3) % 8 = 0) OR (ps.y >= 4 AND ps.y <= n2 - 4 AND (ps.y - 4) % 8 = 0)))
        OR (ps.plane <> 2 AND ps.x BETWEEN 2 AND 30 AND (ps.x - 2) % 4 = 0 AND ps.y >= 1 AND ps.y <= n2 // 2 - 3 AND (ps.y - 1) % 8 = 0) THEN 2 ELSE 0 END causes
    FROM ps JOIN lv ON lv.plane = ps.plane LEFT JOIN bad ON bad.plane = ps.plane AND bad.y = ps.y AND bad.x = ps.x, sz),
  cl AS (SELECT *, CASE WHEN code >= 4095 AND causes = 0 THEN 1 ELSE 0 END clip FROM ca),
  de AS (SELECT plane, y, x, v, clip FROM cl WHERE causes = 0),
  sp AS (SELECT plane, y, x, y + i dy, x + j dx, greatest(abs(i), abs(j)) ring, 1.0::DOUBLE / (i * i + j * j) w FROM cl, range(-8, 9) a(i), range(-8, 9) b(j) WHERE causes <> 0 AND (i <> 0 OR j <> 0)),
  ri AS (SELECT s.plane, s.y, s.x, ring, sum(w * d.v) / sum(w) v, max(d.clip) infl FROM sp s JOIN de d ON d.plane = s.plane AND d.y = s.dy AND d.x = s.dx GROUP BY ALL),
  re AS (SELECT plane, y, x, arg_min(v, ring) v, arg_min(infl, ring) infl FROM ri GROUP BY ALL),
  la AS (SELECT c.plane, c.y, c.x, CASE WHEN causes <> 0 THEN re.v ELSE c.v END v, causes, clip, CASE WHEN causes <> 0 THEN re.infl ELSE clip END influence, noise, black
    FROM cl c LEFT JOIN re ON re.plane = c.plane AND re.y = c.y AND re.x = c.x)"""
BITS = f"{LAYERS}, lb AS (SELECT * EXCLUDE (influence), causes + CASE WHEN clip <> 0 THEN 4 ELSE 0 END + CASE WHEN causes <> 0 AND influence <> 0 THEN 8 ELSE 0 END influence FROM la)"


def _fit(layers: str) -> str:
    return f"""co AS (SELECT y // 2 y, x // 2 x, avg(v) g, bit_or(influence) gi, max(noise) / 4 gn FROM {layers} WHERE plane = 2 GROUP BY 1, 2),
      pr AS (SELECT l.plane, l.y, l.x, g, l.v s, l.influence | gi i, gn FROM {layers} l JOIN co ON co.y = l.y AND co.x = l.x WHERE l.plane <> 2),
      bx AS (SELECT a.plane, a.y, a.x, a.gn, count(*) n, sum(b.g) sg, sum(b.s) ss, sum(b.g * b.g) sgg, sum(b.g * b.s) sgs, bit_or(b.i) influence
        FROM pr a JOIN (SELECT pr.*, y + u ty, x + w tx FROM pr, range(-2, 3) p(u), range(-2, 3) q(w)) b ON a.plane = b.plane AND b.ty = a.y AND b.tx = a.x GROUP BY ALL),
      sl AS (SELECT plane, y, x, influence, (sgs / n - sg / n * (ss / n)) / (greatest(sgg / n - (sg / n) * (sg / n), 0) + greatest(gn, 1e-10)) slope, ss / n ms, sg / n mg FROM bx),
      ft AS (SELECT plane, y, x, influence, slope, ms - slope * mg icpt FROM sl)"""


def _up(source: str, values: str, out: str) -> str:
    """Half-pixel bilinear doubling: each fine sample takes three quarters of its own coarse one and a quarter of the next, along both axes."""
    sums = ", ".join(f"sum(s.{v} * wy * wx) {v}" for v in values.split())
    axis = "SELECT p, CASE WHEN k = 0 THEN p // 2 ELSE least(greatest(p // 2 + CASE WHEN p % 2 = 0 THEN -1 ELSE 1 END, 0), {last}) END q, CASE WHEN k = 0 THEN 0.75 ELSE 0.25 END w"
    return f"""{out}_y AS ({axis.format(last="h - 1")} wy FROM sz, range((SELECT n2 FROM sz)) a(p), range(2) b(k)), {out}_x AS ({axis.format(last="31")} wx FROM range(64) a(p), range(2) b(k)),
      {out} AS (SELECT s.plane, ay.p y, ax.p x, {sums}, bit_or(s.influence) influence FROM {source} s JOIN {out}_y ay ON ay.q = s.y JOIN {out}_x ax ON ax.q = s.x GROUP BY ALL)""".replace(" w wy", " wy").replace(" w wx", " wx")


LOW = "lw AS (SELECT plane, y, x, v, influence FROM {0} WHERE plane <> 2)"
GAINS = (1.5 * 1.0 * 0.5, 1.0 * 1.25 * 0.5, 2.0 * 0.5 * 0.5)
MIX = [m * GAINS[i % 3] for i, m in enumerate([1.5, -0.25, -0.125, -0.5, 1.75, -0.25, 0.0625, -0.75, 1.875])]
OUT = "SELECT y - 6 y, (x - 4)::INT x, " + ", ".join(f"round({MIX[3 * c]!r}::DOUBLE * v0 + {MIX[3 * c + 1]!r}::DOUBLE * v1 + {MIX[3 * c + 2]!r}::DOUBLE * v2 + 1e-9, 5) {n}" for c, n in enumerate("rgb")) + ", clip FROM nat, sz WHERE y BETWEEN 6 AND n2 - 5 AND x BETWEEN 4 AND 59"
PROJECTED = f"""{BITS}, {LOW.format("lb")}, {_up("lw", "v", "pu")}, {_fit("lb")}, {_up("ft", "slope icpt", "fu")},
  pj AS (SELECT u.plane, u.y // 2 y, (u.x // 2)::INT x, avg(u.v) bilinear, avg(f.slope * t.v + f.icpt) guided, bit_or(u.influence | f.influence | t.influence) causes
    FROM pu u JOIN fu f ON f.plane = u.plane AND f.y = u.y AND f.x = u.x JOIN lb t ON t.plane = 2 AND t.y = u.y AND t.x = u.x GROUP BY 1, 2, 3)"""



def _restored(transformed: bool, adaptive: bool) -> str:
    power = lambda v: f"pow({v} / 4096.0::DOUBLE, 0.4166666567325592) * 4096.0::DOUBLE"
    t = "greatest(0.0, least(1.0, (m - 1000) / 9000.0::DOUBLE))"
    a, tau = ("1.0", "25.0") if transformed else (f"({t} * 3 + 1 - {t})", f"((1 - {t}) * 25 + {t} * 1000)") if adaptive else ("1.0", "(CASE WHEN m <= 1000 THEN 25.0 ELSE m * 25.0 / 1000.0 END)")
    plain = f"({power('greatest(f, 0)')} + 5) / ({power('b / w')} + 5)" if transformed else "(greatest(f, 0) + 5) / (b / w + 5)"
    ratio = plain if transformed else f"CASE WHEN f < 11000 OR {plain} >= 1 THEN {plain} ELSE 1 + (1 - greatest(0, least(1, (f - 11000) / 3000.0::DOUBLE))) * ({plain} - 1) END"
    step = lambda c: "floor(" + (power(f"{c} / w") if transformed else f"{c} / w") + " + 0.5)::INT"
    inside = "y BETWEEN 5 AND n2 - 5 AND x BETWEEN 5 AND 58"
    return f"""WITH {SENSOR}, co AS (SELECT y // 2 y, x // 2 x, avg(code) a FROM ps WHERE plane = 2 GROUP BY 1, 2), cc AS (SELECT y, x, a r0, a * 0.5 r1, a * 2.5 + 100 r2, a * 2 c0, a + 300 c1, 5000 - a c2 FROM co),
        fi AS (SELECT y, x, code g0, code // 2 g1, code + 100 g2, code * 3.0::DOUBLE f, greatest(code, code + 100)::DOUBLE m FROM ps WHERE plane = 2),
        ne AS (SELECT fi.*, y // 2 + i cy, x // 2 + j cx, exp(-{a} * sqrt((x % 2 * 0.5 - 0.25 - j) ** 2 + (y % 2 * 0.5 - 0.25 - i) ** 2)::DOUBLE) sp FROM fi, range(-2, 3) p(i), range(-2, 3) q(j)),
        we AS (SELECT ne.*, cc.* EXCLUDE (y, x), sp / (1 + (abs(r0 - g0) + abs(r1 - g1) + abs(r2 - g2)) / {tau}) v, ne.cy = ne.y // 2 AND ne.cx = ne.x // 2 own FROM ne JOIN cc ON cc.y = cy AND cc.x = cx),
        su AS (SELECT y, x, f, sum(v) w, sum(v * c0) c0, sum(v * c1) c1, sum(v * c2) c2, sum(v * r2) b, max(CASE WHEN own THEN (r0 + r1 - 2 * r2) / greatest(r2, 0.0001) END) chroma FROM we GROUP BY ALL),
        ra AS (SELECT *, {ratio} ratio, 1 - 0.75 / (exp(7 - 4 * chroma) + 1) s FROM su)
      SELECT y, x, CASE WHEN {inside} THEN {step("c0")} ELSE 0 END r, CASE WHEN {inside} THEN {step("c1")} ELSE 0 END g, CASE WHEN {inside} THEN {step("c2")} ELSE 0 END b,
        round(CASE WHEN {inside} THEN greatest(0.001, least(1000, CASE WHEN ratio > 1 THEN 1 + s * (ratio - 1) ELSE 1 / (1 + s * (1 / ratio - 1)) END)) ELSE f END + 1e-9, 5) gain FROM ra, sz"""


ORACLE_SQL = {
    "calibrated_planes": f"WITH {LAYERS} SELECT plane, y, x, round(v, 6) v, causes, clip, influence, round(noise, 9) noise FROM la",
    "clipping_planes": f"WITH {LAYERS} SELECT plane, 4095 threshold_code, 'EstimatedEncodedMaximum' provenance, max(x) + 1 width, max(y) + 1 height, sum(clip)::BIGINT clipped FROM la GROUP BY plane",
    "render_guided": f"""WITH {LAYERS}, {_fit("la")}, {_up("ft", "slope icpt", "fu")}, nat AS (SELECT t.y, t.x, a.slope * t.v + a.icpt v0, b.slope * t.v + b.icpt v1, t.v v2, greatest(t.influence, a.influence, b.influence) clip
        FROM la t JOIN fu a ON a.plane = 0 AND a.y = t.y AND a.x = t.x JOIN fu b ON b.plane = 1 AND b.y = t.y AND b.x = t.x WHERE t.plane = 2) {OUT}""",
    "render_bilinear": f"""WITH {LAYERS}, {LOW.format("la")}, {_up("lw", "v", "pu")}, nat AS (SELECT t.y, t.x, a.v v0, b.v v1, t.v v2, greatest(t.influence, a.influence, b.influence) clip
        FROM la t JOIN pu a ON a.plane = 0 AND a.y = t.y AND a.x = t.x JOIN pu b ON b.plane = 1 AND b.y = t.y AND b.x = t.x WHERE t.plane = 2) {OUT}""",
    "render_errors": "SELECT i::INT image_id, CASE WHEN i = 10 THEN 'InvalidGeometry' ELSE 'InvalidContainer' END error FROM range(1, 11) t(i)",
    "attribute_sources": f"WITH {BITS} SELECT plane, influence causes, count(*) n FROM lb GROUP BY ALL",
    "projection": f"WITH {PROJECTED} SELECT plane, y, x, round(bilinear + 1e-9, 5) bilinear, round(guided + 1e-9, 5) guided, causes FROM pj",
    "measure_projection": f"""WITH {PROJECTED}, js AS (SELECT pj.*, (bilinear - l.v) * (4095 - l.black) rb, (guided - l.v) * (4095 - l.black) rg FROM pj JOIN lb l USING (plane, y, x), sz
          WHERE y BETWEEN 6 AND (n2 - 5 + 1) // 2 - 4 AND x BETWEEN 5 AND 26),
        ok AS (SELECT plane, count(*) n, avg(rb) bb, sqrt(avg(rb * rb)) bm, quantile_disc(abs(rb), 0.95) bp, avg(rg) gb, sqrt(avg(rg * rg)) gm, quantile_disc(abs(rg), 0.95) gp FROM js WHERE causes = 0 GROUP BY plane)
        SELECT j.plane, count(*) total, count(*) FILTER (causes <> 0) excluded, max(n) bilinear_n, round(max(bb) + 1e-7, 3) bilinear_bias, round(max(bm) + 1e-7, 3) bilinear_rms, round(max(bp) + 1e-7, 3) bilinear_p95,
          max(n) guided_n, round(max(gb) + 1e-7, 3) guided_bias, round(max(gm) + 1e-7, 3) guided_rms, round(max(gp) + 1e-7, 3) guided_p95 FROM js j LEFT JOIN ok ON ok.plane = j.plane GROUP BY j.plane""",
    "autofocus_grid": """SELECT 2 plane, y + k y, 340 n, (217 + 5641) * 170 AS "columns" FROM range(464, 3313, 32) t(y), range(2) r(k) UNION ALL SELECT 0, y, 340, (108 + 2820) * 170 FROM range(232, 1657, 16) t(y)""",
    "diagnostic_counts": f"""WITH {PROJECTED}, po AS (SELECT 'native-full-plane' scope, plane, influence causes FROM lb UNION ALL SELECT 'projected-common', plane, causes FROM pj, sz WHERE y BETWEEN 6 AND (n2 - 5 + 1) // 2 - 4 AND x BETWEEN 5 AND 26)
        SELECT scope, plane, causes, count(*) n, causes <> 0 excluded, bit_count(causes)::INT n_causes FROM po GROUP BY scope, plane, causes""",
    "restore": _restored(False, False),
    "restore_adaptive": _restored(False, True),
    "restore_transformed": _restored(True, False),
    "plane_checksums": f"""WITH {SENSOR}, li AS (SELECT y, list(b ORDER BY x, k) l FROM (SELECT y, x, k, ('0x' || substr(printf('%08X', bits::BIGINT), 7 - 2 * k, 2))::INT::HUGEINT b FROM (
          SELECT y, x, CASE WHEN code = 0 THEN 0 ELSE (127 + floor(log2(code))::BIGINT) * 8388608 + (code - (1::BIGINT << floor(log2(code))::INT)) * (8388608 >> floor(log2(code))::INT) END bits FROM px) f, range(4) t(k)) GROUP BY y)
        SELECT y, format('{{:016x}}', list_reduce(list_prepend(14695981039346656037::HUGEINT, l), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT) checksum FROM li""",
    "enum_codes": "SELECT p_partkey, ([1, 2, 0])[p_partkey % 3 + 1] byte_order, p_partkey % 3 provenance FROM part",
    "autofocus_grid": """SELECT 2 plane, y + k y, 340 n, (217 + 5641) * 170 AS "columns" FROM range(464, 3313, 32) t(y), range(2) r(k) UNION ALL SELECT 0, y, 340, (108 + 2820) * 170 FROM range(232, 1657, 16) t(y)""",
}
