"""Parcel labelling, filters, summaries and vintage change."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotgrid.functions import attributes as A
from lotgrid.functions import geometry as G
from lotgrid.operators import change, parcels, ranking, summary
from lotgrid.plans.inputs import VACANT_CODES, Inputs
from lotgrid.plans.registry import query
from lotgrid.plans.sql_views import hash_sql
from lotgrid.sources import readers

# ---------------------------------------------------------------- change (C, A5, A6, J1)


def changes(t: Inputs):
    return change.changed_parcels(t.vintage(1), t.vintage(2))


@query(
    "change_stats_A5_C5",
    """SELECT coalesce(borough, 'ALL') AS borough, change_category, count(*) AS parcels, sum(area_m2) AS total_area_m2
    FROM changed GROUP BY GROUPING SETS ((borough, change_category), (change_category))""",
    "changed",
)
def _(t: Inputs):
    return change.change_stats(changes(t))


@query(
    "vintage_join_J1",
    """SELECT side, count(*) AS parcels, count(*) FILTER (vac1) AS vacant_y1, count(*) FILTER (vac2) AS vacant_y2 FROM (
    SELECT vac1, vac2, CASE WHEN in1 AND in2 THEN 'both' WHEN in1 THEN 'left_only' ELSE 'right_only' END AS side FROM joined) GROUP BY side""",
    "joined",
)
def _(t: Inputs):
    joined = change.join_vintages(t.vintage(1).select("bbl", "is_vacant"), t.vintage(2).select("bbl", "is_vacant"))
    return joined.groupBy("side").agg(
        F.count("*").alias("parcels"), F.count_if("is_vacant_y1").alias("vacant_y1"), F.count_if("is_vacant_y2").alias("vacant_y2")
    )


@query(
    "vintage_tag_C1",
    """SELECT 1 AS vintage, count(*) AS parcels, count(*) FILTER (is_vacant) AS vacant FROM v1
    UNION ALL SELECT 2, count(*), count(*) FILTER (is_vacant) FROM v2""",
    "v1 v2",
)
def _(t: Inputs):
    out = []
    for year, codes in ((1, ["F"]), (2, ["1", "2"])):
        tagged, vacant = change.tag_vintage(t.vintage(year), codes)
        both = tagged.select(F.lit(0).alias("v")).unionByName(vacant.select(F.lit(1).alias("v")))
        out.append(both.agg(F.count_if(F.col("v") == 0).alias("parcels"), F.count_if(F.col("v") == 1).alias("vacant")).withColumn("vintage", F.lit(year)))
    return summary.union_all(out)


@query(
    "change_category_C2",
    "SELECT change_category, bldg_class_y1, bldg_class_y2, count(*) AS parcels FROM changed GROUP BY ALL",
    "changed",
)
def _(t: Inputs):
    return changes(t).groupBy("change_category", "bldg_class_y1", "bldg_class_y2").agg(F.count("*").alias("parcels"))


@query("changed_parcels_C3", "SELECT bbl, change_category, borough, lot_area, area_m2, x::DOUBLE AS xmin FROM changed", "changed")
def _(t: Inputs):
    return changes(t).select("bbl", "change_category", "borough", "lot_area", "area_m2", G.bounds(F.col("geom")).xmin.alias("xmin"))


@query(
    "change_pivot_A6",
    """SELECT coalesce(borough, 'ALL') AS borough, count(*) FILTER (change_category='remained_vacant') AS remained_vacant,
    count(*) FILTER (change_category='became_vacant') AS became_vacant, count(*) FILTER (change_category='developed') AS developed
    FROM changed GROUP BY GROUPING SETS ((borough), ())""",
    "changed",
)
def _(t: Inputs):
    return change.change_pivot(change.change_stats(changes(t)))


@query(
    "change_acres_X13",
    "SELECT change_category, round(sum(area_m2)/4046.86, 6) AS acres FROM changed GROUP BY 1",
    "changed",
)
def _(t: Inputs):
    return changes(t).groupBy("change_category").agg(F.round(G.acres(F.sum("area_m2")), 6).alias("acres"))


_HOTSPOTS = """, pts AS (SELECT change_category, x + side/2.0 AS cx, y + side/2.0 AS cy, x, y, side FROM changed),
ext AS (SELECT min(x) AS x0, min(y) AS y0, greatest(ceil((max(x+side)-min(x))/500.0), 1) AS nx, greatest(ceil((max(y+side)-min(y))/500.0), 1) AS ny
  FROM pts WHERE change_category <> 'remained_vacant'),
cells AS (SELECT least(floor((cx-x0)/500.0), nx-1) AS ix, least(floor((cy-y0)/500.0), ny-1) AS iy, count(*) AS n FROM pts, ext
  WHERE change_category <> 'remained_vacant' GROUP BY 1, 2 ORDER BY n DESC, ix, iy LIMIT 10),
rects AS (SELECT ix, iy, x0+greatest(ix-1,0)*500 AS xmin, y0+greatest(iy-1,0)*500 AS ymin, x0+least(ix+2,nx)*500 AS xmax, y0+least(iy+2,ny)*500 AS ymax FROM cells, ext)
SELECT row_number() OVER (ORDER BY total_change DESC, ix, iy)::INT AS hotspot_id, xmin, ymin, xmax, ymax, total_change, became_vacant_count, developed_count, remained_vacant_count
FROM (SELECT ix, iy, xmin, ymin, xmax, ymax, count(*) FILTER (change_category IN ('became_vacant','developed')) AS total_change,
  count(*) FILTER (change_category='became_vacant') AS became_vacant_count, count(*) FILTER (change_category='developed') AS developed_count,
  count(*) FILTER (change_category='remained_vacant') AS remained_vacant_count
  FROM rects JOIN pts ON cx > xmin AND cx < xmax AND cy > ymin AND cy < ymax GROUP BY ALL)"""


@query("change_hotspots_C4_J6", "WITH " + _HOTSPOTS[2:], "changed")
def _(t: Inputs):
    return change.hotspots(changes(t), cell=500.0, top_n=10)


# ---------------------------------------------------------------- labels and rules


@query(
    "vacancy_label_P1",
    "SELECT count(*) AS parcels, count(*) FILTER (v) AS vacant, round(avg(v::INT), 6) AS vacant_share FROM (SELECT coalesce(bldg_class IN (SELECT code FROM codes), false) AS v FROM attrs)",
    "attrs codes",
)
def _(t: Inputs):
    return parcels.vacancy_share(parcels.label_vacancy(t.part_attributes, VACANT_CODES)).withColumn("vacant_share", F.round("vacant_share", 6))


@query("potential_vacant_P2", "SELECT bbl FROM rules WHERE potential_vacant", "rules")
def _(t: Inputs):
    return parcels.building_rules(t.part_attributes).where("potential_vacant").select("bbl")


@query("inconsistent_lots_P3", "SELECT bbl, num_bldgs, bldg_area, built_far FROM rules WHERE inconsistent", "rules")
def _(t: Inputs):
    return parcels.building_rules(t.part_attributes).where("inconsistent").select("bbl", "num_bldgs", "bldg_area", "built_far")


@query("land_use_counts_P4", "SELECT land_use, count(*) AS parcels FROM rules WHERE potential_vacant GROUP BY 1", "rules")
def _(t: Inputs):
    return parcels.land_use_counts(t.part_attributes)


@query("override_relabel_P5", "SELECT bbl, bldg_class, is_vacant FROM relabelled", "relabelled")
def _(t: Inputs):
    return parcels.apply_overrides(t.part_attributes, t.overrides, VACANT_CODES + ["V0"]).select("bbl", "bldg_class", "is_vacant")


@query("override_vacant_only_P5", "SELECT bbl, bldg_class FROM relabelled WHERE is_vacant", "relabelled")
def _(t: Inputs):
    return parcels.apply_overrides(t.part_attributes, t.overrides, VACANT_CODES + ["V0"], keep="vacant").select("bbl", "bldg_class")


@query("omit_filter_P6_J4", "SELECT bbl FROM attrs WHERE bbl NOT IN (SELECT bbl FROM overrides WHERE action = 'omit')", "attrs overrides")
def _(t: Inputs):
    return parcels.omit_parcels(t.part_attributes, t.overrides).select("bbl")


@query(
    "override_audit_P7",
    "SELECT DISTINCT bbl, action FROM overrides WHERE action <> 'omit' AND bbl NOT IN (SELECT bbl FROM attrs)",
    "attrs overrides",
)
def _(t: Inputs):
    return parcels.unmatched_overrides(t.overrides, t.part_attributes)


# ---------------------------------------------------------------- geometry and filters


@query(
    "geometry_measures_P8",
    """SELECT bbl, CASE WHEN tri THEN side*side/2 ELSE side*side END AS area_m2, round(CASE WHEN tri THEN side*(2+sqrt(2)) ELSE 4*side END, 6) AS perimeter_m,
    round(CASE WHEN tri THEN xl + side/3 ELSE xl + side/2 END, 6) AS cx, round(CASE WHEN tri THEN yl + side/3 ELSE yl + side/2 END, 6) AS cy, xl AS xmin, yl AS ymin, xl + side AS xmax, yl + side AS ymax FROM lots""",
    "lots",
)
def _(t: Inputs):
    m = parcels.with_measures(t.lots.select("bbl", "geom"))
    return m.select("bbl", F.round("area_m2", 6).alias("area_m2"), *[F.round(c, 6).alias(c) for c in ("perimeter_m", "cx", "cy")], "xmin", "ymin", "xmax", "ymax")


@query(
    "min_size_filter_P9",
    """SELECT count(*) AS parcels, count(*) FILTER (big) AS large_enough, count(*) FILTER (big AND land_use IS NOT NULL) AS with_label
    FROM (SELECT CASE WHEN tri THEN side*side/2 ELSE side*side END >= 30 AS big, land_use FROM lots JOIN attrs USING (bbl))""",
    "lots attrs",
)
def _(t: Inputs):
    sized = t.lots.select("land_use", G.area(F.col("geom")).alias("area_m2"))
    return parcels.size_filter_counts(sized, 30, 1.0, "land_use")


@query(
    "extent_prefilter_P10",
    "SELECT bbl FROM lots WHERE xl <= 100 AND xl + side >= 20 AND yl <= -10 AND yl + side >= -60.5",
    "lots",
)
def _(t: Inputs):
    boxed = t.lots.select("bbl", G.bounds(F.col("geom")).alias("b")).select("bbl", "b.*")
    extent = dict(zip(("xmin", "ymin", "xmax", "ymax"), map(F.lit, (20.0, -60.5, 100.0, -10.0))))
    return parcels.within_extent(boxed, extent).select("bbl")


@query(
    "parcel_window_P11",
    """, w AS (SELECT xl + side/2 AS cx, yl + side/2 AS cy, side/2 + 15 AS h FROM lots WHERE bbl = 7)
    SELECT bbl, greatest(xl, cx-h) AS xmin, greatest(yl, cy-h) AS ymin, least(xl+side, cx+h) AS xmax, least(yl+side, cy+h) AS ymax
    FROM lots, w WHERE xl <= cx+h AND xl+side >= cx-h AND yl <= cy+h AND yl+side >= cy-h""".replace(", w AS", "WITH w AS", 1),
    "lots",
)
def _(t: Inputs):
    boxed = t.lots.select("bbl", G.bounds(F.col("geom")).alias("b")).select("bbl", "b.*")
    return parcels.parcels_around(boxed, 7, 15.0)


@query(
    "attribute_cleaning_P12_J10",
    f"""SELECT land_use_code, coalesce(CASE land_use_code {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.LAND_USE_LABELS.items())} END, 'Unknown') AS land_use_label,
    class_prefix, coalesce(CASE class_prefix {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.CLASS_PREFIX_LABELS.items())} END, 'Unknown') AS class_label, count(*) AS parcels
    FROM (SELECT lpad(coalesce(land_use, ''), 2, '0') AS land_use_code, upper(substr(bldg_class, 1, 1)) AS class_prefix FROM attrs) GROUP BY ALL""",
    "attrs",
)
def _(t: Inputs):
    return (
        parcels.clean_attributes(t.part_attributes)
        .groupBy("land_use_code", "land_use_label", "class_prefix", "class_label")
        .agg(F.count("*").alias("parcels"))
    )


@query(
    "percentile_clip_P13",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.025) AS lo, quantile_cont(o_totalprice, 0.975) AS hi FROM orders) SELECT count(*) AS kept, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders, q WHERE o_totalprice BETWEEN lo AND hi",
)
def _(t: Inputs):
    kept = parcels.clip_percentiles(t.table("orders").select("o_totalprice"), "o_totalprice", 0.95)
    return kept.agg(F.count("*").alias("kept"), F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"))


_THRESHOLD_TEXT = "CASE l_linenumber % 4 WHEN 0 THEN l_quantity::VARCHAR WHEN 1 THEN l_discount::VARCHAR WHEN 2 THEN l_returnflag ELSE (l_quantity*3)::VARCHAR END"


@query(
    "threshold_text_P14",
    f"""SELECT threshold, count(*) AS n FROM (SELECT round(CASE WHEN v > 0 AND v <= 1 THEN v WHEN v > 1 AND v <= 100 THEN v/100 END, 6) AS threshold
    FROM (SELECT try_cast({_THRESHOLD_TEXT} AS DOUBLE) AS v FROM lineitem)) GROUP BY 1""",
)
def _(t: Inputs):
    n = F.col("l_linenumber") % 4
    text = (
        F.when(n == 0, F.col("l_quantity").cast("string"))
        .when(n == 1, F.col("l_discount").cast("string"))
        .when(n == 2, F.col("l_returnflag"))
        .otherwise((F.col("l_quantity") * 3).cast("string"))
    )
    parsed = t.table("lineitem").select(F.round(A.parse_threshold(text), 6).alias("threshold"))
    return parsed.groupBy("threshold").agg(F.count("*").alias("n"))


@query("county_filter_P15", "SELECT r_name AS name FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
def _(t: Inputs):
    return parcels.select_counties(t.counties, ["ASIA", "EUROPE"], "36").select("name")


@query(
    "region_merge_P15",
    "SELECT count(*) AS parts, sum(26*height)::DOUBLE AS area_m2 FROM region, dims WHERE r_name IN ('ASIA', 'EUROPE')",
    "dims",
)
def _(t: Inputs):
    merged = parcels.merge_region(parcels.select_counties(t.counties, ["ASIA", "EUROPE"], "36"))
    return merged.select("parts", G.area(F.col("geom")).alias("area_m2"))


@query(
    "sample_category_P16_J3",
    """SELECT category, count(*) AS parcels FROM (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = bbl AND l_linestatus = 'O') THEN 0
      WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = bbl AND l_linestatus = 'O' AND l_returnflag = 'R' AND l_tax > 0.05) THEN 3 + v ELSE 1 + v END AS category
      FROM (SELECT bbl, (bldg_class IN (SELECT code FROM codes))::INT AS v FROM attrs)) WHERE category > 0 GROUP BY 1""",
    "attrs codes",
)
def _(t: Inputs):
    sampled = t.table("lineitem").where("l_linestatus = 'O'")
    test = sampled.where("l_returnflag = 'R' AND l_tax > 0.05")
    ids = [d.select(F.col("l_partkey").alias("bbl")) for d in (sampled, test)]
    out = parcels.sample_category(parcels.label_vacancy(t.part_attributes, VACANT_CODES), *ids)
    return out.groupBy("category").agg(F.count("*").alias("parcels"))


@query(
    "scene_exclusion_P17",
    "SELECT count(*) FILTER (NOT x) AS kept, count(*) FILTER (x) AS excluded FROM (SELECT strftime(o_orderdate, '%Y%m%d') IN ('19970528', '19990116', '20000301') AS x FROM orders)",
)
def _(t: Inputs):
    kept, excluded = parcels.filter_scenes(t.catalogue, ["19970528", "19990116", "20000301"])
    return kept.agg(F.count("*").alias("kept")).withColumn("excluded", excluded.scalar())


@query(
    "parcel_subset_S1",
    f"SELECT o_orderkey AS bbl FROM orders ORDER BY {hash_sql('o_orderkey', 42)}, o_orderkey LIMIT 2000",
)
def _(t: Inputs):
    subset = readers.scan_parcels(t.spark, f"{t.sf_dir}/orders.parquet", subset_size=2000, key="o_orderkey", seed=42)
    return subset.select(F.col("o_orderkey").alias("bbl"))


@query(
    "two_stratum_sample_D12",
    f"""SELECT bbl, is_target FROM (SELECT bbl, t AS is_target, row_number() OVER (PARTITION BY t ORDER BY {hash_sql('bbl', 42)}, bbl) AS rn FROM
    (SELECT o_orderkey AS bbl, o_orderpriority IN ('1-URGENT') AS t FROM orders)) WHERE rn <= CASE WHEN is_target THEN 600 ELSE 1400 END""",
)
def _(t: Inputs):
    lots = t.table("orders").select(F.col("o_orderkey").alias("bbl"), F.col("o_orderpriority").alias("land_use"))
    return parcels.two_stratum_sample(lots, ["1-URGENT"], 2000, 0.3).select("bbl", "is_target")


_STRATA = f"""SELECT o_orderkey AS bbl, o_orderstatus AS label, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey', 42)}, o_orderkey) - 1 AS pos,
count(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders"""


@query("stratified_split_D13", f"SELECT bbl, label, pos < round(size*0.2) AS is_test FROM ({_STRATA})")
def _(t: Inputs):
    df = t.table("orders").select(F.col("o_orderkey").alias("bbl"), F.col("o_orderstatus").alias("label"))
    return parcels.stratified_split(df, "label", "bbl", 0.2)


@query("stratified_folds_D14", f"SELECT bbl, label, (pos % 5)::INT AS fold FROM ({_STRATA})")
def _(t: Inputs):
    df = t.table("orders").select(F.col("o_orderkey").alias("bbl"), F.col("o_orderstatus").alias("label"))
    return parcels.stratified_folds(df, "label", "bbl", 5)


# ---------------------------------------------------------------- summaries (A)

_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{name}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
    round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem"""
    for name, c in (("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("l_discount", "l_discount"))
)


@query("describe_A1", _DESCRIBE)
def _(t: Inputs):
    d = summary.describe(t.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return d.select(
        "feature", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min",
        *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")], "max",
    )


@query("top_counts_A2", "SELECT land_use, count(*) AS n FROM attrs GROUP BY 1 ORDER BY n DESC, land_use NULLS LAST LIMIT 10", "attrs")
def _(t: Inputs):
    return summary.value_counts(t.part_attributes, "land_use", 10)


@query(
    "clipped_histogram_A3",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.025) AS a, quantile_cont(o_totalprice, 0.975) AS b FROM orders),
    kept AS (SELECT o_totalprice AS v FROM orders, q WHERE o_totalprice BETWEEN a AND b), e AS (SELECT min(v) AS lo, max(v) AS hi FROM kept)
    SELECT least(floor((v-lo)/((hi-lo)/50)), 49)::INT AS bin, count(*) AS n FROM kept, e GROUP BY 1""",
)
def _(t: Inputs):
    kept = parcels.clip_percentiles(t.table("orders").select("o_totalprice"), "o_totalprice", 0.95)
    return summary.histogram(kept, "o_totalprice", 50).select("bin", "n")


@query(
    "exploratory_bundle_A4",
    """SELECT 'potential_vacant' AS part, count(*) AS n FROM rules WHERE potential_vacant UNION ALL SELECT 'inconsistent', count(*) FROM rules WHERE inconsistent
    UNION ALL SELECT 'top_land_use', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM attrs GROUP BY land_use ORDER BY n DESC, land_use NULLS LAST LIMIT 10)
    UNION ALL SELECT 'describe', count(lot_area) FROM attrs UNION ALL SELECT 'vacancy_share', count(*) FROM attrs WHERE bldg_class IN (SELECT code FROM codes)
    UNION ALL SELECT 'land_use_counts', count(*) FROM rules WHERE potential_vacant""",
    "rules codes",
)
def _(t: Inputs):
    bundle = summary.exploratory_bundle(t.part_attributes, ["lot_area"], ["land_use"], VACANT_CODES)
    size = {
        "potential_vacant": F.count("*"),
        "inconsistent": F.count("*"),
        "top_land_use": F.sum("n"),
        "describe": F.sum("n"),
        "vacancy_share": F.sum("vacant"),
        "land_use_counts": F.sum("parcels"),
    }
    return summary.union_all([bundle[k].agg(agg.alias("n")).withColumn("part", F.lit(k)) for k, agg in size.items()])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "cluster_composition_A7",
    "SELECT cluster, "
    + ", ".join(f"round(count(*) FILTER (cat = '{c}') / count(*)::DOUBLE, 6) AS \"{c}\"" for c in ["Vacant", *_PRIORITIES[2:]])
    + " FROM (SELECT o_custkey % 7 AS cluster, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Vacant' ELSE o_orderpriority END AS cat FROM orders) GROUP BY 1",
)
def _(t: Inputs):
    df = t.table("orders").select(
        (F.col("o_custkey") % 7).alias("cluster"), summary.merge_codes(F.col("o_orderpriority"), _PRIORITIES[:2], "Vacant").alias("cat")
    )
    values = ["Vacant", *_PRIORITIES[2:]]
    return summary.cluster_composition(df, "cluster", "cat", values).select("cluster", *[F.round(F.col(f"`{v}`"), 6).alias(v) for v in values])


@query("cluster_means_A8", "SELECT label, " + ", ".join(f"round(avg(f{i}), 6) AS f{i}" for i in range(10)) + " FROM emb GROUP BY 1", "emb")
def _(t: Inputs):
    feats = [f"f{i}" for i in range(10)]
    return summary.cluster_means(t.features, "label", feats).select("label", *[F.round(f, 6).alias(f) for f in feats])


@query("cluster_sizes_A9", "SELECT label, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (), 6) AS pct FROM embeddings GROUP BY 1")
def _(t: Inputs):
    return summary.cluster_sizes(t.features, "label").withColumn("pct", F.round("pct", 6))


@query(
    "cv_summary_A10",
    "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS folds FROM events GROUP BY 1",
)
def _(t: Inputs):
    out = summary.mean_and_spread(t.table("events"), ["event_type"], "value")
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "folds")


# ---------------------------------------------------------------- ranking utilities (W)


@query(
    "even_subset_D15",
    """WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
    WHERE pos IN (SELECT (i*(n-1)) // 99 FROM n, unnest(range(100)) AS a(i))""",
)
def _(t: Inputs):
    return ranking.even_subset(t.table("orders").select("o_orderkey"), "o_orderkey", 100)


@query("next_run_id_W8", "SELECT lpad((max(c_custkey)+1)::VARCHAR, greatest(3, length((max(c_custkey)+1)::VARCHAR))::INT, '0') AS next_run_id FROM customer")
def _(t: Inputs):
    return ranking.next_run_id(t.runs, "run_id")


@query(
    "union_rows_W9",
    "SELECT src, count(*) AS n FROM (SELECT 'water' AS src FROM supplier UNION ALL SELECT 'roadbed' FROM customer UNION ALL SELECT 'roads' FROM supplier) GROUP BY 1",
)
def _(t: Inputs):
    layers = {"water": t.water, "roadbed": t.roadbed, "roads": t.roads}
    rows = summary.union_all([df.select("id").withColumn("src", F.lit(k)) for k, df in layers.items()])
    return rows.groupBy("src").agg(F.count("*").alias("n"))
