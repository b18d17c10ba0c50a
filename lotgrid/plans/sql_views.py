"""The adapters of ``inputs`` once more, as SQL, for the checks."""

from __future__ import annotations

from lotgrid.functions.hashing import seed_terms

BOROUGH_VALUES = "(VALUES (1,'Manhattan'),(2,'Bronx'),(3,'Brooklyn'),(4,'Queens'),(5,'Staten Island')) AS d(boro_code, borough)"


def hash_sql(key: str, seed: int = 0) -> str:
    offset, factor = seed_terms(seed)
    first = f"((((({key})::BIGINT) % 2147483647) * 2654435761 + {offset}) % 4294967296)"
    second = f"((xor({first}, {first} >> 16) * {factor} + 12345) % 4294967296)"
    return f"xor({second}, {second} >> 15)"




VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "boroughs": ((), f"SELECT * FROM {BOROUGH_VALUES}"),
    "v1": (
        (),
        """SELECT o_orderkey AS bbl, o_orderstatus AS bldg_class, o_orderstatus = 'F' AS is_vacant, o_totalprice AS lot_area,
        (o_custkey % 5 + 1)::INT AS boro, (o_custkey*37)%5000 AS x, (o_orderkey*53)%5000 AS y, o_orderkey%20+5 AS side
        FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'""",
    ),
    "v2": (
        (),
        """SELECT o_orderkey AS bbl, substr(o_orderpriority,1,1) AS bldg_class, substr(o_orderpriority,1,1) IN ('1','2') AS is_vacant,
        o_totalprice AS lot_area, (o_custkey % 5 + 1)::INT AS boro, (o_custkey*37)%5000 AS x, (o_orderkey*53)%5000 AS y, o_orderkey%20+5 AS side
        FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1996-01-01' AND o_orderpriority <> '5-LOW')""",
    ),
    "joined": (
        ("v1", "v2"),
        """SELECT coalesce(b.bbl, a.bbl) AS bbl, a.bbl IS NOT NULL AS in1, b.bbl IS NOT NULL AS in2,
        coalesce(a.is_vacant, false) AS vac1, coalesce(b.is_vacant, false) AS vac2, a.bldg_class AS bldg_class_y1, b.bldg_class AS bldg_class_y2,
        coalesce(b.boro, a.boro) AS boro, b.lot_area AS lot_area, a.lot_area AS lot_area_y1,
        coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.side, b.side) AS side
        FROM v1 a FULL OUTER JOIN v2 b ON a.bbl = b.bbl""",
    ),
    "changed": (
        ("joined", "boroughs"),
        """SELECT * FROM (SELECT j.*, d.borough, (side*side)::DOUBLE AS area_m2,
          CASE WHEN in1 AND in2 AND vac1 AND vac2 THEN 'remained_vacant'
               WHEN in1 AND in2 AND NOT vac1 AND vac2 THEN 'became_vacant'
               WHEN in1 AND in2 AND vac1 AND NOT vac2 THEN 'developed'
               WHEN in1 AND NOT in2 AND vac1 THEN 'developed'
               WHEN in2 AND NOT in1 AND vac2 THEN 'became_vacant' END AS change_category
          FROM joined j JOIN boroughs d ON d.boro_code = j.boro) WHERE change_category IS NOT NULL""",
    ),
    "attrs": (
        (),
        """SELECT p_partkey AS bbl, upper(substr(p_type,1,1)) || (p_size%10)::VARCHAR AS bldg_class,
        CASE WHEN p_size%13 <> 0 THEN (p_size%13)::VARCHAR END AS land_use, (p_partkey%5+1)::INT AS boro_code, p_retailprice AS lot_area,
        CASE WHEN p_size%4 <> 3 THEN (p_size%4)::DOUBLE END AS num_bldgs,
        CASE WHEN p_size%5 <> 0 THEN CASE WHEN p_size%5 < 3 THEN 0.0 ELSE p_retailprice END END AS bldg_area,
        CASE WHEN p_size%3 <> 0 THEN CASE WHEN p_size%3 = 1 THEN 0.0 ELSE 1.5 END::DOUBLE END AS built_far FROM part""",
    ),
    "rules": (
        ("attrs",),
        """SELECT *, (coalesce(num_bldgs = 0, false) AND coalesce(bldg_area, 0) = 0 AND coalesce(built_far, 0) = 0)
        OR (num_bldgs IS NULL AND bldg_area IS NULL AND built_far IS NULL) AS potential_vacant,
        coalesce(num_bldgs, 0) = 0 AND (coalesce(bldg_area, 0) > 0 OR coalesce(built_far, 0) > 0) AS inconsistent FROM attrs""",
    ),
    "codes": ((), "SELECT unnest(['M7','E0','E1','E2','E3','E4','E5','E6','E7','E8','E9']) AS code"),
    "overrides": (
        (),
        """SELECT s_suppkey*23 AS bbl, CASE s_nationkey%3 WHEN 0 THEN 'omit' WHEN 1 THEN 'force_nonvacant' ELSE 'force_vacant' END AS action FROM supplier
        UNION ALL SELECT s_suppkey*46, CASE WHEN s_acctbal > 5000 THEN 'force_vacant' ELSE 'force_nonvacant' END FROM supplier""",
    ),
    "relabelled": (
        ("attrs", "overrides", "codes"),
        """SELECT *, bldg_class IN (SELECT code FROM codes) OR bldg_class = 'V0' AS is_vacant FROM (
        SELECT a.* REPLACE (CASE WHEN bbl IN (SELECT bbl FROM overrides WHERE action = 'force_nonvacant') THEN 'XX'
        WHEN bbl IN (SELECT bbl FROM overrides WHERE action = 'force_vacant') THEN 'V0' ELSE bldg_class END AS bldg_class)
        FROM attrs a WHERE bbl NOT IN (SELECT bbl FROM overrides WHERE action = 'omit'))""",
    ),
    "raster": (
        (),
        """SELECT prow, pcol, r, g, b, n, boro_code, k % 5 AS k, CASE k % 5 WHEN 0 THEN 1 WHEN 4 THEN 255 ELSE 0 END AS label FROM (
        SELECT (o_orderkey // 128)::INT AS prow, (o_orderkey % 128)::INT AS pcol, ((7*o_custkey+13*o_orderkey)%256)::INT AS r,
        (floor(o_totalprice)::BIGINT % 256)::INT AS g, ((31*o_orderkey)%256)::INT AS b, ((11*o_custkey+3*o_orderkey)%256)::INT AS n,
        ((o_orderkey % 128) // 26 + 1)::INT AS boro_code, 31*((o_orderkey//128)//8) + 17*((o_orderkey%128)//8) AS k FROM orders)""",
    ),
    "dims": ((), "SELECT (max(o_orderkey) // 128 + 1)::INT AS height, 128 AS width FROM orders"),
    "features": (
        ("raster",),
        """SELECT *, 1 + (N0-R0)/(N0+R0+1e-8) AS nd2, (R0+G0+B0)/3 AS bright, 1.5*(N0-R0)/(N0+R0+0.5) AS sv,
        2.5*(N0-R0)/(N0+6*R0-7.5*B0+1+1e-8) AS ev, 1 + (N0-G0)/(N0+G0+1e-8) AS gn2
        FROM (SELECT prow, pcol, label, boro_code, r/255.0::DOUBLE AS R0, g/255.0::DOUBLE AS G0, b/255.0::DOUBLE AS B0, n/255.0::DOUBLE AS N0 FROM raster)""",
    ),
    "lots": (
        ("dims",),
        """SELECT p_partkey AS bbl, (p_size%5+1)::INT AS category, upper(substr(p_type,1,1)) || (p_size%10)::VARCHAR AS bldg_class, side,
        p_partkey % 3 = 0 AS tri, cx - side/2.0 AS xl, cy - side/2.0 AS yl
        FROM (SELECT part.*, (p_size%8+3)::DOUBLE AS side, ((37*p_partkey)%128)::DOUBLE + 0.25 AS cx, -(((53*p_partkey)%height)::DOUBLE + 0.25) AS cy FROM part, dims)""",
    ),
    "allcells": (
        ("dims",),
        "SELECT i::INT AS prow, j::INT AS pcol FROM dims, unnest(range(height)) AS a(i), unnest(range(width)) AS b(j)",
    ),
    "lot_cells": (
        ("lots", "allcells"),
        """SELECT l.*, c.prow, c.pcol FROM lots l JOIN allcells c
        ON c.pcol + 0.5 >= xl AND c.pcol + 0.5 < xl + side AND -(c.prow + 0.5) >= yl AND -(c.prow + 0.5) < yl + side
        AND (NOT tri OR (c.pcol + 0.5 - xl) + (-(c.prow + 0.5) - yl) < side)""",
    ),
    "burned": (
        ("lot_cells", "overrides"),
        """SELECT prow, pcol, CASE WHEN max(pass) IN (2, 4) THEN 1 ELSE 0 END AS label FROM (
        SELECT c.prow, c.pcol, CASE
          WHEN bbl IN (SELECT bbl FROM overrides WHERE action='force_vacant') THEN 4
          WHEN bbl IN (SELECT bbl FROM overrides WHERE action='force_nonvacant') THEN 3
          WHEN bldg_class = 'M7' OR bldg_class LIKE 'E%' THEN 2 ELSE 1 END AS pass
        FROM lot_cells c WHERE (CASE WHEN tri THEN side*side/2 ELSE side*side END) >= 12) GROUP BY prow, pcol""",
    ),
    "eroded": (
        ("burned",),
        """SELECT a.prow, a.pcol, CASE WHEN a.label = 1 AND EXISTS (SELECT 1 FROM burned z WHERE z.label = 0
          AND z.prow BETWEEN a.prow-2 AND a.prow+2 AND z.pcol BETWEEN a.pcol-2 AND a.pcol+2
          AND (z.prow-a.prow)*(z.prow-a.prow)+(z.pcol-a.pcol)*(z.pcol-a.pcol) <= 4) THEN 255 ELSE a.label END AS label FROM burned a""",
    ),
    "water_cells": (
        ("allcells", "dims"),
        """SELECT DISTINCT prow, pcol FROM (SELECT ((s_suppkey*29)%128)::DOUBLE+0.125 AS x, -(((s_suppkey*31)%height)::DOUBLE+0.125) AS y, (s_suppkey%4+2)::DOUBLE AS s
        FROM supplier, dims) w JOIN allcells ON pcol+0.5 >= x AND pcol+0.5 < x+s AND -(prow+0.5) >= y-s AND -(prow+0.5) < y""",
    ),
    "roadbed_cells": (
        ("allcells", "dims"),
        """SELECT DISTINCT prow, pcol FROM (SELECT ((c_custkey*41)%128)::DOUBLE+0.375 AS x, -(((c_custkey*43)%height)::DOUBLE+0.375) AS y, (c_custkey%2+1)::DOUBLE AS s
        FROM customer, dims) w JOIN allcells ON pcol+0.5 >= x AND pcol+0.5 < x+s AND -(prow+0.5) >= y-s AND -(prow+0.5) < y""",
    ),
    "roads": (
        ("dims",),
        """SELECT s_suppkey AS id, CASE s_nationkey%4 WHEN 0 THEN 'S1100' WHEN 1 THEN 'S1200' WHEN 2 THEN 'S1400' ELSE 'S1630' END AS mtfcc,
        s_nationkey AS county, x0, y0, x0 + (s_suppkey%9) + 0.4 AS x1, y0 - (s_suppkey%5) - 0.15 AS y1
        FROM (SELECT *, ((s_suppkey*61)%128)::DOUBLE+0.3 AS x0, -(((s_suppkey*67)%height)::DOUBLE+0.7) AS y0 FROM supplier, dims)""",
    ),
    # A cell is touched when the parameter intervals of the segment inside its row band and column band overlap.
    "road_cells": (
        ("roads", "allcells"),
        """SELECT DISTINCT prow, pcol FROM roads JOIN allcells ON
        pcol + 1 > x0 AND pcol <= x1 AND -(prow + 1) < y0 AND -prow > y1
        AND greatest((pcol - x0)/(x1 - x0), (-prow - y0)/(y1 - y0), 0) <= least((pcol + 1 - x0)/(x1 - x0), (-(prow + 1) - y0)/(y1 - y0), 1)""",
    ),
    "masked": (
        ("eroded", "water_cells", "roadbed_cells", "road_cells", "allcells"),
        """SELECT prow, pcol, label FROM (SELECT a.prow, a.pcol, CASE WHEN o.prow IS NOT NULL THEN 255 ELSE e.label END AS label FROM allcells a
        LEFT JOIN eroded e USING (prow, pcol)
        LEFT JOIN (SELECT * FROM water_cells UNION SELECT * FROM roadbed_cells UNION SELECT * FROM road_cells) o USING (prow, pcol)) WHERE label IS NOT NULL""",
    ),
    "scores": (
        (),
        """SELECT l_linestatus AS split, l_linenumber AS run_no, greatest(least(round(l_discount*5 + l_quantity/100, 3), 1.0), 0.0) AS prob,
        (l_returnflag = 'R')::INT AS y FROM lineitem""",
    ),
    "score_cells": (("raster",), "SELECT prow, pcol, label, CASE WHEN n >= 16 THEN ((r + b*2) % 256)/255.0::DOUBLE END AS prob FROM raster"),
    "landcover": (
        ("raster",),
        "SELECT DISTINCT prow//5 AS lc_row, pcol//5 AS lc_col, (3*(prow//5) + pcol//5) % 7 AS class FROM raster",
    ),
    "scenes": (
        ("raster",),
        """SELECT 'm_18_060_' || replace(acq, '-', '') AS scene_id, acq::DATE AS acq_date, prow, pcol + shift AS pcol, r, g, b, n
        FROM raster, (VALUES (0,'2021-07-19'),(1,'2022-07-19'),(2,'2022-08-02'),(3,'2023-06-30')) s(shift, acq)""",
    ),
    # Full-window patch origins: 8x8 at stride 4.
    "patch_px": (
        ("raster", "dims"),
        """SELECT a.i*4 AS row_off, b.j*4 AS col_off, prow - a.i*4 AS i, pcol - b.j*4 AS j, prow, pcol, label,
        ((b + 17*a.i + 5*b.j) % 256)/255.0::DOUBLE AS prob FROM raster, dims, unnest([prow//4 - 1, prow//4]) AS a(i), unnest([pcol//4 - 1, pcol//4]) AS b(j)
        WHERE a.i >= 0 AND b.j >= 0 AND a.i*4 + 8 <= height AND b.j*4 + 8 <= width""",
    ),
    "emb": (
        (),
        "SELECT vec_id AS bbl, label, (label = 0)::INT AS y, "
        + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(64))
        + " FROM embeddings",
    ),
    "emb_gaps": (
        ("emb",),
        "SELECT * REPLACE (" + ", ".join(f"CASE WHEN f{i} >= -0.1 THEN f{i} END AS f{i}" for i in range(0, 64, 4)) + ") FROM emb",
    ),
    # Parcel prediction fraction over the scored cells.
    "fractions": (
        ("lot_cells", "score_cells", "relabelled"),
        """SELECT p.bbl, p.bldg_class, p.land_use, p.boro_code, p.is_vacant, valid_pixels, pred_pixels, pred_pixels::DOUBLE / nullif(valid_pixels, 0) AS pred_fraction
        FROM relabelled p JOIN (SELECT bbl, count(prob) AS valid_pixels, count(*) FILTER (prob >= 0.5) AS pred_pixels
        FROM lot_cells JOIN score_cells USING (prow, pcol) GROUP BY bbl) USING (bbl) WHERE valid_pixels >= 5""",
    ),
    "coverages": ((), "SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS coverage"),
    "outcomes": (
        ("fractions", "coverages"),
        """SELECT f.*, coverage, CASE WHEN is_vacant THEN CASE WHEN pred_fraction >= coverage THEN 'TP' ELSE 'FN' END
        ELSE CASE WHEN pred_fraction >= coverage THEN 'FP' ELSE 'TN' END END AS outcome FROM fractions f, coverages""",
    ),
    "runs": (
        (),
        "SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') AS run_id, c_name, c_mktsegment, c_acctbal, "
        + ", ".join(
            f"printf('%.4f', {hash_sql('c_custkey', i)} % 1000 / 1000.0::DOUBLE) AS val_{n}, "
            f"CASE WHEN c_custkey % 5 <> 0 THEN printf('%.4f', {hash_sql('c_custkey', 100 + i)} % 1000 / 1000.0::DOUBLE) ELSE '' END AS test_{n}"
            for i, n in enumerate(("iou", "dice", "precision", "recall", "f1", "f2", "kappa", "ap"))
        )
        + " FROM customer",
    ),
    "registry": (
        (),
        f"""SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') AS run_id,
        CASE WHEN c_custkey % 2 = 0 THEN 'unet' ELSE 'deeplabv3plus' END AS model_type,
        CASE c_custkey % 3 WHEN 0 THEN 'mask_v2.tif' WHEN 1 THEN 'mask.tif' END AS vacancy_mask,
        CASE WHEN c_custkey % 4 <> 0 THEN {hash_sql('c_custkey', 5)} % 1000 / 1000.0::DOUBLE END AS best_val_f2,
        {hash_sql('c_custkey', 6)} % 1000 / 1000.0::DOUBLE AS val_f2,
        CASE WHEN c_custkey % 5 <> 0 THEN {hash_sql('c_custkey', 8)} % 1000 / 1000.0::DOUBLE END AS test_f2,
        CASE WHEN c_custkey % 7 = 0 THEN {hash_sql('c_custkey', 9)} % 1000 / 1000.0::DOUBLE END AS test_best_f2_computed,
        CASE WHEN c_custkey % 8 <> 0 THEN [256, 512, 1024][c_custkey % 3 + 1] END AS patch_size,
        CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ({hash_sql('c_custkey', 7)} % 1000) / 10.0::DOUBLE ELSE ({hash_sql('c_custkey', 7)} % 1000) / 1000.0::DOUBLE END AS f2_value FROM customer""",
    ),
    "history": (
        (),
        "SELECT user_id AS run_id, event_id AS epoch, value AS val_iou, (props->>'$.k')::BIGINT AS k, event_type FROM events",
    ),
    "permits": (
        (),
        """SELECT o_orderpriority AS name, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS total_units_per_capita,
        round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS m1, round(sum(o_totalprice) FILTER (o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'), 2) AS m2,
        round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS m3, round(sum(o_totalprice) / count(*), 2) AS m5 FROM orders GROUP BY 1, 2""",
    ),
}


def with_views(names, body: str) -> str:
    """Prefix ``body`` with the named views and whatever they are built on, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in VIEWS[name][0]:
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body.lstrip()[15:]}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes},\n{body.lstrip()[5:]}"
    return f"WITH {ctes}\n{body}"
