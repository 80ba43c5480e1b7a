"""Scenes, queries, pixels and logs as views of the given tables.

Each view is one set of expressions used by Spark and, with a few tokens
swapped, by the SQL check: ``{STR}`` text type, ``{FMT}`` printf, ``{LIST}``
array constructor, ``{JSON}`` JSON text getter.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog

SPARK = {"STR": "STRING", "FMT": "format_string", "LIST": "array", "JSON": "get_json_object", "DBL": "DOUBLE"}
DUCK = {"STR": "VARCHAR", "FMT": "printf", "LIST": "list_value", "JSON": "json_extract_string", "DBL": "DOUBLE"}

OBJECTS = ["agriculture", "forest", "water", "urban", "wetland", "grassland", "barren", "river", "lake", "cropland"]
PLACES = ["Delhi", "Mumbai", "Guwahati", "Kerala", "Jorhat", "Sri Lanka", "Atlantis", "Pune"]
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
]


def pick(index: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE {index} {cases} END"


OBJECT = f"CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE {pick('o_orderkey % 10', OBJECTS)} END"
WKT = "{FMT}('POLYGON((%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f))', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)"

# name -> (source, [(expression, alias)], filter)
VIEWS = {
    "scene_boxes": (
        "orders",
        [
            ("*", None),
            ("(6995 + (o_custkey % 250) * 10) / 1e2", "x0"),
            ("(795 + (o_custkey % 270) * 10) / 1e2", "y0"),
            ("(7005 + (o_custkey % 250) * 10) / 1e2", "x1"),
            ("(805 + (o_custkey % 270) * 10) / 1e2", "y1"),
        ],
        None,
    ),
    "scenes0": (
        "scene_boxes",
        [
            ("'s' || lpad(CAST(o_orderkey AS {STR}), 9, '0')", "scene_id"),
            ("CASE WHEN o_orderkey % 3 = 0 THEN 'Sentinel-1' WHEN o_orderkey % 50 = 1 THEN 'both' ELSE 'Sentinel-2' END", "sensor"),
            ("CASE o_orderkey % 3 WHEN 0 THEN 'sar' WHEN 1 THEN 'optical' ELSE 'multispectral' END", "modality"),
            ("CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END", "acquisition_time"),
            (WKT, "geometry_wkt"),
            ("CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE './data/' || CAST(o_orderkey AS {STR}) || '.tif' END", "file_path"),
            ("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice % 1e2 END", "cloud_cover"),
            (OBJECT, "object"),
            ("CASE o_orderstatus WHEN 'F' THEN 'bigearthnet_txt' WHEN 'O' THEN 'cdvqa' ELSE 'gee_assam' END", "dataset_origin"),
            ("x0", "min_lon"),
            ("y0", "min_lat"),
            ("x1", "max_lon"),
            ("y1", "max_lat"),
            ("'L' || CAST(o_custkey AS {STR})", "place_id"),
            ("'aoi_' || CAST(o_custkey % 40 AS {STR})", "aoi"),
            ("o_orderkey", "scene_no"),
        ],
        None,
    ),
    "search": (
        "customer",
        [
            ("c_custkey", "query_id"),
            (f"CASE WHEN c_custkey % 23 = 4 THEN NULL ELSE 'Show me ' || COALESCE({pick('c_nationkey % 12', OBJECTS)}, 'images') || ' ' || CAST(c_custkey AS {{STR}}) END", "text_query"),
            ("CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE (700 + (c_custkey * 7) % 240) / 1e1 END", "q_min_lon"),
            ("CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE (80 + (c_custkey * 11) % 260) / 1e1 END", "q_min_lat"),
            ("CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE (710 + (c_custkey * 7) % 240 + (c_custkey % 3) * 5) / 1e1 END", "q_max_lon"),
            ("CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE (90 + (c_custkey * 11) % 260 + (c_custkey % 3) * 5) / 1e1 END", "q_max_lat"),
            ("CASE WHEN c_custkey % 7 IN (5, 6) THEN NULL ELSE make_timestamp(1995 + c_custkey % 6, 1 + c_custkey % 12, 1, 0, 0, 0) END", "start_date"),
            ("CASE WHEN c_custkey % 7 IN (4, 6) THEN NULL ELSE make_timestamp(1996 + c_custkey % 6, 1 + c_custkey % 12, 1, 0, 0, 0) END", "end_date"),
            ("CASE c_custkey % 4 WHEN 0 THEN {LIST}('Sentinel-1') WHEN 1 THEN {LIST}('Sentinel-2') WHEN 2 THEN {LIST}('Sentinel-1', 'Sentinel-2') END", "sensors"),
            (pick("c_nationkey % 12", OBJECTS), "query_object"),
            ("CAST(20 AS {DBL})", "cloud_cover_max"),
            ("c_custkey % 5 = 0", "change_flag"),
        ],
        None,
    ),
    "pixels_t1": (
        "lineitem",
        [
            ("l_orderkey", "pair_id"),
            ("l_linenumber * 10000000 + l_partkey", "row"),
            ("l_suppkey", "col"),
            ("l_discount * 10137e-4", "nir"),
            ("l_tax", "red"),
            ("CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity / 5e2 END", "green"),
            ("l_quantity * l_discount", "vv"),
        ],
        None,
    ),
    "pixels_t2": (
        "lineitem",
        [
            ("l_orderkey", "pair_id"),
            ("l_linenumber * 10000000 + l_partkey", "row"),
            ("l_suppkey", "col"),
            ("l_tax", "nir"),
            ("CASE WHEN l_orderkey % 29 = 3 THEN NULL ELSE l_discount END", "red"),
            ("CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice / 1e6 END", "green"),
            ("l_extendedprice / 1e4 * l_tax", "vv"),
        ],
        "NOT (l_quantity = 1 AND l_returnflag = 'R')",
    ),
    "radar": (
        "lineitem",
        [
            ("l_suppkey", "scene_id"),
            ("l_orderkey", "row"),
            ("l_partkey * 10 + l_linenumber", "col"),
            ("l_discount * l_quantity / 1e1", "vv"),
            ("CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_tax * l_quantity / 5e1 END", "vh"),
        ],
        None,
    ),
    "raster0": (
        "lineitem",
        [
            ("l_suppkey", "scene_id"),
            ("row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity) - 1", "pos"),
            ("sqrt(l_extendedprice / 1e5)", "value"),
        ],
        None,
    ),
    "raster": (
        "raster0",
        [("scene_id", None), ("CAST(floor(pos / 25e0) AS BIGINT)", "row"), ("CAST(pos % 25 AS BIGINT)", "col"), ("value", None)],
        "pos % 23 <> 5",  # nodata holes
    ),
    "log": (
        "events",
        [
            ("event_id", "query_id"),
            ("user_id", "session_id"),
            ("CAST(ts AS TIMESTAMP)", "ts"),
            ("event_type", None),
            ("value", None),
            ("event_type || ' ' || CAST(event_id AS {STR})", "query_text"),
            ("event_type IN ('view', 'click')", "is_followup"),
            ("CASE WHEN event_type = 'purchase' THEN 'aoi_' || {JSON}(props, '$.k') END", "aoi"),
            ("CASE WHEN event_type IN ('signup', 'purchase') THEN 'range_' || {JSON}(props, '$.k') END", "time_range"),
            ("CASE WHEN event_type = 'error' THEN 'Sentinel-1' END", "sensor"),
            ("CAST({JSON}(props, '$.k') AS INT) % 2 = 0", "reuse_aoi"),
            ("CAST({JSON}(props, '$.k') AS INT) % 3 = 0", "reuse_time"),
            ("TRUE", "reuse_sensor"),
        ],
        None,
    ),
    "query_text0": (
        "orders",
        [
            ("o_orderkey", "query_id"),
            ("o_orderkey % 6", "kind"),
            ("CASE WHEN o_orderkey % 3 = 0 THEN 'Sentinel-1' ELSE 'Sentinel-2' END", "g_sensor"),
            (pick("o_orderkey % 10", OBJECTS), "g_object"),
            (pick("o_custkey % 8", PLACES), "g_place"),
            (pick("CAST(extract(MONTH FROM o_orderdate) AS INT) - 1", MONTHS), "month_name"),
            ("CAST(extract(YEAR FROM o_orderdate) AS {STR})", "year_text"),
            ("CAST(extract(YEAR FROM o_orderdate) + 1 AS {STR})", "next_year"),
            ("lpad(CAST(extract(MONTH FROM o_orderdate) AS {STR}), 2, '0')", "month_no"),
        ],
        None,
    ),
    "query_text": (
        "query_text0",
        [
            ("*", None),
            (
                "CASE kind "
                "WHEN 0 THEN 'Show me ' || g_sensor || ' images of ' || g_object || ' near ' || g_place || ' from ' || month_name || ' ' || year_text "
                "WHEN 1 THEN 'What changed between ' || month_name || ' ' || year_text || ' and ' || month_name || ' ' || next_year || ' in ' || g_place || '?' "
                "WHEN 2 THEN 'Describe the ' || g_object || ' around ' || g_place "
                "WHEN 3 THEN 'Combine optical and SAR over ' || g_place || ' from ' || year_text || '-' || month_no || '-01 to ' || next_year || '-' || month_no || '-15' "
                "WHEN 4 THEN 'Highlight the ' || g_object || ' seen in ' || year_text || '.' "
                "ELSE 'hello there' END",
                "query_text",
            ),
        ],
        None,
    ),
    "answers": (
        "documents",
        [
            ("doc_id", None),
            ("lang", "task"),
            ("text", "reference"),
            ("replace(text, 'the', 'an') || CASE WHEN doc_id % 2 = 0 THEN ' end' ELSE '' END", "prediction"),
            ("doc_id % 9 <> 4", "success"),
            ("{LIST}(1e-1, 2e-1, 7e-1, 9e-1)", "box"),
            (
                "CASE doc_id % 6 WHEN 0 THEN '[0.1, 0.2, 0.7, 0.9]' WHEN 1 THEN 'box [(0.2,0.2), (0.8, 0.95)]' "
                "WHEN 2 THEN '<0.5, 0.5, 0.9, 0.9>' WHEN 3 THEN 'x1=0.1, y1=0.2, x2=0.6, y2=0.9' "
                "WHEN 4 THEN '[1.5, 0.2, 0.7, 0.9]' ELSE 'none' END",
                "reply",
            ),
        ],
        None,
    ),
    "generated": (
        "documents",
        [
            ("doc_id", None),
            ("lang", "stratum"),
            ("source", "family"),
            ("CASE WHEN doc_id % 19 = 3 THEN '' WHEN doc_id % 19 = 4 THEN '{{\"task\": 1}}' ELSE text END", "query_text"),
            (
                "CASE doc_id % 11 WHEN 0 THEN '{{broken' "
                "WHEN 1 THEN '{{\"query_text\":\"q\",\"task_type\":\"fly\"}}' "
                "WHEN 2 THEN '{{\"task_type\":\"search\"}}' "
                "WHEN 3 THEN '{{\"query_text\":\"q\",\"sensor\":\"Landsat\"}}' "
                "WHEN 4 THEN '{{\"query_text\":\"q\",\"task_type\":\"vqa\",\"sensor\":\"both\"}}' "
                "WHEN 5 THEN '{{\"query_text\":\"q\",\"change_flag\":\"maybe\"}}' "
                "ELSE '{{\"query_text\":\"q\",\"task_type\":\"search\"}}' END",
                "structured_query",
            ),
            ("'{{\"query_text\":\"q\",\"task_type\":\"search\"}}'", "seed_query"),
        ],
        None,
    ),
}


def _expression(item: tuple[str, str | None], tokens: dict[str, str], quote: str) -> str:
    text, alias = item
    if "{" in text:
        text = text.format(**tokens)
    return text if alias is None else f"{text} AS {quote}{alias}{quote}"


def duck_views(*names: str) -> str:
    """``WITH`` list of the named views and the views they need."""
    done: dict[str, str] = {}

    def add(name):
        if name in done or name not in ALL:
            return
        if name == "scenes":
            add("scenes0")
            done[name] = (
                "SELECT *, COALESCE(lead(scene_id) OVER w, lag(scene_id) OVER w) AS paired_scene_id FROM scenes0 "
                "WINDOW w AS (PARTITION BY place_id, sensor ORDER BY acquisition_time NULLS FIRST, scene_id)"
            )
            return
        source, items, where = VIEWS[name]
        add(source)
        columns = ", ".join(_expression(i, DUCK, '"') for i in items)
        done[name] = f"SELECT {columns} FROM {source}" + (f" WHERE {where}" if where else "")

    for name in names:
        add(name)
    return ", ".join(f"{n} AS ({sql})" for n, sql in done.items())


ALL = {*VIEWS, "scenes"}


class Data:
    """The views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        source, items, where = VIEWS[name]
        rows = self.documents if source == "documents" else self.view(source)
        if where:
            rows = rows.filter(where)
        return rows.selectExpr(*[_expression(i, SPARK, "`") for i in items])

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def unpaired(self) -> DataFrame:
        return self.view("scenes0")

    @cached_property
    def scenes(self) -> DataFrame:
        """Scenes with their consecutive pairs."""
        return catalog.pair_consecutive(self.unpaired, ["place_id", "sensor"])

    @cached_property
    def queries(self) -> DataFrame:
        return self.view("search")


def day_text(column: str):
    return F.date_format(column, "yyyy-MM-dd")
