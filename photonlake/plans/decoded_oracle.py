"""The queries of plans/decoded.py in DuckDB SQL: what the files were built from, computed without a file."""

from __future__ import annotations

from photonlake.plans.oracle import NH, PX

CUT = f"{PX}, {NH}, fr AS (SELECT coalesce((SELECT max(k) FROM range(2, 33) t(k), nh WHERE n % k = 0), (SELECT n FROM nh))::BIGINT r)"
IMAGES = f"{CUT}, im AS (SELECT DISTINCT y // r image_id, r FROM px, fr)"
RGB = f"{CUT}, rgb AS (SELECT y // r image_id, y % r y, (x // 3)::INT x, x % 3 channel, code FROM px, fr WHERE x < 63)"
PART = "k AS (SELECT p_partkey k FROM part)"
BLOCKS = "c AS (SELECT c_custkey // 64 b, c_custkey k, c_name n, row_number() OVER (PARTITION BY c_custkey // 64 ORDER BY c_custkey, c_name) - 1 i FROM customer)"
SECTIONS = f"{PART}, f AS (SELECT k, ([262146, 262145, 196608, 262146])[k % 4 + 1] version, (['SdQuattro', 'Quattro', 'Merrill', 'SdQuattro'])[k % 4 + 1] sensor FROM k)"
TAGS = """analog_balance as_shot_neutral as_shot_white_xy color_matrix_1 color_matrix_2 forward_matrix_1 forward_matrix_2 color_matrix_3 forward_matrix_3 camera_calibration_1
    camera_calibration_2 camera_calibration_3 illuminant_1 illuminant_2 illuminant_3""".split()
SHIFT = "0.00000859375"

ORACLE_SQL = {
    "x3f_planes": f"""WITH {CUT} SELECT y // r image_id, 2 plane, y % r y, x, code FROM px, fr UNION ALL SELECT y // r, 0, y % r, x - 32, code FROM px, fr WHERE x >= 32
        UNION ALL SELECT y // r, 1, y % r, x, code FROM px, fr WHERE x < 32""",
    "x3f_planes_merrill": f"""WITH {CUT} SELECT y // r image_id, 0 plane, y % r y, x, code FROM px, fr UNION ALL SELECT y // r, 1, y % r, x, 4095 - code FROM px, fr
        UNION ALL SELECT y // r, 2, r - 1 - y % r, x, code FROM px, fr""",
    "plane_files": f"WITH {CUT} SELECT y // r image_id, y % r y, string_agg(printf('%02X%02X', code & 255, code >> 8), '' ORDER BY x) bytes FROM px, fr GROUP BY 1, 2",
    "x3f_sections": f"""WITH {SECTIONS} SELECT k image_id, version, sensor, 28 raw_bytes, CASE WHEN k % 3 <> 0 THEN 66 ELSE 54 END jpeg_bytes, CASE WHEN k % 3 <> 0 THEN 44 ELSE 32 END exif_bytes,
        CASE WHEN k % 3 <> 0 THEN k % 13 END light_source, NULL::VARCHAR error FROM f WHERE k % 7 <> 0
        UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, 'InvalidContainer' FROM f WHERE k % 7 = 0""",
    "x3f_calibration": f"""WITH {SECTIONS} SELECT k image_id, 'Tag' "name", 'Text' kind, 'image ' || k text, NULL::VARCHAR error, NULL::BOOLEAN "empty" FROM f WHERE k % 7 <> 0 AND k % 5 <> 0
        UNION ALL SELECT k, NULL, NULL, NULL, 'InvalidContainer', true FROM f WHERE k % 7 <> 0 AND k % 5 = 0""",
    "camf_texts": f"""WITH {BLOCKS}, g AS (SELECT b, count(*) m, arg_min(n, i) first FROM c GROUP BY b), e(o, nm, kind, dims) AS (VALUES (0, 'Head', 'Text', NULL), (1, 'Names', 'Properties', NULL), (2, 'Keys', 'Matrix', 1),
          (3, 'Signed', 'Matrix', 1), (4, 'Bytes', 'Matrix', 1), (5, 'Shorts', 'Matrix', 2), (6, 'Floats', 'Matrix', 3))
        SELECT b image_id, o AS "ord", nm AS "name", kind, CASE WHEN o = 0 THEN 'block ' || b || ': ' || first END text, dims n_dims, CASE WHEN o >= 2 THEN m END n_values, NULL::VARCHAR error FROM g, e""",
    "camf_properties": f"""WITH {BLOCKS} SELECT b image_id, 'k' || k AS "key", n AS "value" FROM c WHERE i < 9""",
    "camf_matrices": f"""WITH {BLOCKS} SELECT b image_id, 'Keys' AS "name", i, k::DOUBLE AS "value" FROM c UNION ALL SELECT b, 'Signed', i, k % 30000 - 15000 FROM c UNION ALL SELECT b, 'Bytes', i, k % 256 FROM c
        UNION ALL SELECT b, 'Shorts', i, k % 65536 FROM c UNION ALL SELECT b, 'Floats', i, k / 4.0 FROM c""",
    "calibration_values": f"WITH {BLOCKS} SELECT b image_id, CASE WHEN count(*) = 64 THEN sum(k)::DOUBLE END total, CASE WHEN count(*) <> 64 THEN 'InvalidContainer' END error FROM c GROUP BY b",
    "calibration_property": f"""WITH {BLOCKS} SELECT b image_id, max(n) FILTER (k = 65 AND i < 9) AS "value", CASE WHEN count(*) FILTER (k = 65 AND i < 9) = 0 THEN 'InvalidContainer' END error FROM c GROUP BY b""",
    "probe_files": f"""WITH {PART}, f AS (SELECT k, k % 8 s, k % 8 IN (1, 6, 7) dng FROM k)
        SELECT k image_id, CASE WHEN s = 0 THEN 'X3f' WHEN dng THEN 'Dng' WHEN s <> 3 THEN 'Unknown' END container, CASE WHEN s = 0 THEN 262146 END "version", CASE WHEN s = 6 THEN 'MM' WHEN dng THEN 'II' END byte_order,
          CASE WHEN dng THEN k % 50 + 1 END width, CASE WHEN dng THEN k % 7 + 1 END height, CASE WHEN dng THEN 16 END bits, CASE WHEN dng THEN true END is_linear_raw, CASE WHEN dng THEN true END has_tiles,
          CASE WHEN s = 7 THEN 'Other' WHEN dng THEN 'Apple' END make, CASE WHEN s = 3 THEN 'UnsupportedFeature' END probe_error,
          CASE WHEN s IN (0, 7) THEN 'recognized-unsupported' WHEN dng THEN 'supported' ELSE 'not recognized' END classification, CASE WHEN dng THEN 3 END codec, CASE WHEN dng THEN 3 END channels, NULL::VARCHAR error FROM f""",
    "tiff_tags": f"""WITH {PART}, e AS (SELECT k, 0 o, 254 t, 4 ft, 1 n, 1.0::DOUBLE v, NULL::VARCHAR s FROM k UNION ALL SELECT k, 0, 256, 4, 1, 8, NULL FROM k UNION ALL SELECT k, 0, 271, 2, 6, NULL, 'Apple' FROM k
          UNION ALL SELECT k, 0, 305, 2, 6 + length(k::VARCHAR), NULL, 'part ' || k FROM k UNION ALL SELECT k, 0, 50728, 5, 3, (k % 9) / 4.0, NULL FROM k UNION ALL SELECT k, 0, 50730, 10, 1, -(k % 7) / 8.0, NULL FROM k
          UNION ALL SELECT k, 2, 254, 4, 1, 0, NULL FROM k UNION ALL SELECT k, 2, 256, 4, 1, k % 40 + 1, NULL FROM k UNION ALL SELECT k, 2, 271, 2, 6, NULL, 'Apple' FROM k UNION ALL SELECT k, 2, 50717, 4, 3, k + 2, NULL FROM k
          UNION ALL SELECT k, 2, 50719, 12, 2, 0.25, NULL FROM k UNION ALL SELECT k, 2, 50720, 11, 2, 2.5, NULL FROM k UNION ALL SELECT k, 1, 254, 4, 1, 4, NULL FROM k UNION ALL SELECT k, 1, 256, 3, 1, k % 300, NULL FROM k)
        SELECT k image_id, o dir_ord, o = 0 is_root, t tag_id, ft field_type, n AS "count", CASE WHEN k % 2 = 1 THEN 'II' ELSE 'MM' END byte_order, v AS "last", s AS text, NULL::VARCHAR error FROM e""",
    "tiff_lookups": f"WITH {PART} SELECT k image_id, 8.0::DOUBLE root_width, (k % 40 + 1)::DOUBLE raw_width, k::DOUBLE white, 9 n_root FROM k",
    "dng_codes": f"WITH {RGB} SELECT image_id, y, x, channel, code FROM rgb",
    "dng_lossless": f"WITH {RGB} SELECT image_id, y, x, channel, CASE WHEN image_id % 3 = 2 THEN code // 4 * 4 ELSE code END code FROM rgb",
    "dng_linear": f"""WITH {RGB}, a AS (SELECT image_id, y, x, channel, (2 * CASE WHEN channel = 2 THEN code // 2 * 2 ELSE code END - CASE channel WHEN 0 THEN 64 WHEN 1 THEN 32 ELSE 16 END) / 8000.0 v FROM rgb),
          b AS (SELECT * EXCLUDE (v), CASE WHEN channel >= 1 THEN greatest(-1, least(1, v * (0.5 + (x % 4) / 8.0))) ELSE v END v FROM a)
        SELECT image_id, y, x, channel, round(CASE WHEN channel < 2 THEN greatest(-1, least(1, 0.0625 + 0.75 * v)) ELSE v END + {SHIFT}, 4) v FROM b""",
    "dng_flags": f"""WITH {RGB} SELECT image_id, channel, 8 + CASE WHEN code >= 4095 THEN 1 ELSE 0 END + CASE WHEN 2 * code >= CASE channel WHEN 0 THEN 8064 WHEN 1 THEN 8032 ELSE 8016 END THEN 2 ELSE 0 END flags, count(*) n FROM rgb GROUP BY 1, 2, 3""",
    "dng_states": f"""WITH {IMAGES} SELECT image_id, 21 width, r height, CASE WHEN image_id % 4 = 0 THEN 1 ELSE 0 END AS "left", CASE WHEN image_id % 4 = 0 THEN 20 ELSE 21 END AS "right", CASE WHEN image_id % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE crop_x, CASE WHEN image_id % 5 <> 0 THEN 1 END whole_x, image_id % 8 + 1 orientation,
        'Applied' linearization, 'Unapplied' default_crop, 'Applied' opcode_list_1, CASE WHEN image_id % 7 = 0 THEN 'PartiallyApplied' ELSE 'Applied' END opcode_list_3, 'NotPresent' demosaic,
        CASE WHEN image_id % 8 = 0 THEN 'NotPresent' ELSE 'Unapplied' END orientation_state, CASE WHEN image_id % 4 = 0 OR image_id % 5 = 0 THEN 'UnsupportedFeature' END legacy_error, NULL::VARCHAR error FROM im""",
    "opcode_lists": f"""WITH {IMAGES} SELECT image_id, 1 AS "list", 0 AS "ord", 'table' kind, 0 AS "right", 2 plane, 1 planes, 4096 n_params, 8384512.0::DOUBLE total, 0 skipped, NULL::VARCHAR error FROM im
        UNION ALL SELECT image_id, 2, 0, 'column_scale', 21, 1, 2, 21, 14.25, 0, NULL FROM im
        UNION ALL SELECT image_id, 3, 0, 'polynomial', 0, 0, 2, 2, 0.8125, CASE WHEN image_id % 7 = 0 THEN 1 ELSE 0 END, NULL FROM im
        UNION ALL SELECT image_id, 3, 1, 'trim', 20, 0, 3, 0, 0, CASE WHEN image_id % 7 = 0 THEN 1 ELSE 0 END, NULL FROM im WHERE image_id % 4 = 0""",
    "dng_masks": f"""WITH {CUT} SELECT y // r image_id, 'Sky' AS "name", 'm' || (y // r) instance_id, y // r AS "top", y % r y, x, code & 255 v FROM px, fr""",
    "dng_previews": f"WITH {IMAGES} SELECT image_id, 'FFD8' || repeat(printf('%02X', image_id % 200), (image_id % 9 + 2)::BIGINT) || 'FFD9' jpeg, NULL::VARCHAR error FROM im",
    "profile_tables": f"""WITH {PART} SELECT k image_id, 2 n, 0.25::DOUBLE step, 1.5::DOUBLE gamma, j i,
        CASE k % 4 WHEN 0 THEN k % 250 + 1 + j WHEN 1 THEN 100 * (k % 600) + 1000 + j WHEN 2 THEN 0.5 + j / 4.0 ELSE 1 + k / 64.0 + j END::DOUBLE gain FROM k, range(4) t(j)""",
    "calibration_tags": f"WITH {PART} SELECT k image_id, " + ", ".join(f"CASE WHEN (k + {j}) % 3 <> 0 THEN k % 16 / 8.0 - 1 + {j} / 4.0 END {n}" for j, n in enumerate(TAGS)) + " FROM k",
    "capabilities": "SELECT r_regionkey, 5::BIGINT bits FROM region",
}
