"""Geometry derived from the given tables by integer arithmetic.

Each derived table is a base table and a list of expressions that Spark and DuckDB
read alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def div(x: str, n: int) -> str:
    """Whole-number quotient, in both dialects."""
    return f"CAST(({x} - {x} % {n}) / {n} AS BIGINT)"


def real(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def pick(x: str, *values: str | None) -> str:
    """One of the values by x modulo their number."""
    cases = " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for k, v in enumerate(values))
    return f"CASE {x} % {len(values)} {cases} END"


_HIGHWAYS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "residential", "unclassified", "service", "living_street", "cycleway", "track", "path", "footway", "bridleway", "raceway", "corridor",
)
_COUNTRIES = ("NO", "SE", "FI", "DK", "EE", "LV", "LT", "PL", "XX")
#: Columns of the elevation grid.
GRID = 120

#: name: (base table, expressions)
TABLES: dict[str, tuple[str, list[str]]] = {
    "points": (
        "customer",
        [
            "CAST(c_custkey AS BIGINT) AS id",
            f"{real(16)} + (c_custkey % 997) * {real(0.0005)} AS lon",
            f"{real(59)} + (c_custkey % 991) * {real(0.0003)} AS lat",
            "c_mktsegment AS kind",
        ],
    ),
    "roads": (
        "orders",
        [
            "CAST(o_orderkey AS BIGINT) AS id",
            f"{pick('o_orderkey', *_HIGHWAYS)} AS highway",
            f"{pick(div('o_orderkey', 21), 'asphalt', 'gravel', 'mud', 'sett', 'unknown', '', None, '', None)} AS surface_tag",
            f"{pick(div('o_orderkey', 5), *_COUNTRIES)} AS country",
            f"{pick(div('o_orderkey', 3), '7', '4.5 m', '3m', 'wide', '', None, None, '')} AS width_tag",
            f"{pick(div('o_orderkey', 2), '2', '1', 'two', '', None)} AS lanes_tag",
            "o_custkey % 3 = 0 AS in_forest",
            "o_custkey % 2 = 0 AS in_urban",
            f"{pick('o_orderkey', 'yes', 'no', 'no', None)} AS bridge",
        ],
    ),
    "boxes": (
        "supplier",
        [
            "CAST(s_suppkey AS BIGINT) AS id",
            f"{pick('s_suppkey', 'lake', 'pond', 'river', 'stream', 'wetland', 'coastline', 'ditch', 'basin')} AS water_type",
            f"{pick(div('s_suppkey', 2), 'Polygon', 'LineString', 'MultiPolygon')} AS geom_type",
            f"{pick('s_suppkey', 'needleleaved', 'broadleaved', 'mixed', '', '', '')} AS leaf_type",
            f"{pick(div('s_suppkey', 3), 'scrub', 'heath', 'wood', 'forest')} AS area_type",
            f"{pick(div('s_suppkey', 7), *_COUNTRIES)} AS country",
            f"{real(16)} + (s_suppkey % 89) * {real(0.01)} AS x",
            f"{real(59)} + (s_suppkey % 83) * {real(0.01)} AS y",
            f"(1 + s_suppkey % 7) * {real(0.001)} AS w",
            f"(1 + s_suppkey % 5) * {real(0.001)} AS h",
            "s_suppkey % 4 = 0 AS intermittent",
            "s_name AS name",
        ],
    ),
    "countries": (
        "nation",
        [
            "n_name AS code",
            f"(n_nationkey % 5) * {real(10)} AS xmin",
            f"{div('n_nationkey', 5)} * {real(10)} AS ymin",
            f"(n_nationkey % 5) * {real(10)} + {real(10)} AS xmax",
            f"{div('n_nationkey', 5)} * {real(10)} + {real(10)} AS ymax",
        ],
    ),
    "dem": (
        "(SELECT CAST(o_orderkey AS BIGINT) AS k, max(CAST(round(o_totalprice) AS BIGINT)) AS p FROM orders GROUP BY 1)",
        [
            f"{div('k', GRID)} AS r",
            f"k % {GRID} AS c",
            f"CAST(p % 2000 AS DOUBLE) / {real(4)} - {real(20)} AS z",
            "k % 5 < 2 AS water",
        ],
    ),
    "masks": (
        "(SELECT CAST(l_partkey AS BIGINT) AS k, CAST(l_suppkey AS BIGINT) AS s, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2)",
        [
            f"{pick('s', 'rock', 'pine_floor', 'forest_floor', 'asphalt', 'gravel', 'crop', 'dirt', 'sand', 'water_edge', 'grass')} AS surface",
            f"{div('k', 64)} AS r",
            "k % 64 AS c",
            "(q * 13 + s * 7) % 256 AS weight",
        ],
    ),
    "requests": (
        "events",
        ["CAST(event_id AS BIGINT) AS id", "CAST(user_id AS BIGINT) AS key", "event_type AS action", "ts"],
    ),
    "line_points": (
        "(SELECT CAST(l_orderkey AS BIGINT) AS line_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,"
        " CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s FROM lineitem)",
        [
            "line_id",
            "CAST(seq AS BIGINT) AS seq",
            f"{real(16)} + (p % 400) * {real(0.0001)} AS x",
            f"{real(59)} + (s % 300) * {real(0.0001)} AS y",
        ],
    ),
    "ways": (
        "(SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS k FROM orders WHERE o_orderkey % 7 <> 0)",
        [
            "k AS id",
            "k AS a",
            "k + 1 AS b",
            f"{pick(div('k', 40), 'primary', 'residential', 'track')} AS highway",
            f"(k % 100) * {real(0.0001)} AS ax",
            f"{div('k', 100)} * {real(0.0001)} AS ay",
            f"((k + 1) % 100) * {real(0.0001)} AS bx",
            f"{div('(k + 1)', 100)} * {real(0.0001)} AS by_",
        ],
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    base, expressions = TABLES[name]
    if not base.startswith("("):
        return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*expressions)
    source = base.split(" FROM ")[1].split()[0].rstrip(")")
    return spark.sql(
        f"SELECT {', '.join(expressions)} FROM {base.replace(' FROM ' + source, ' FROM {source}')}", source=spark.read.parquet(f"{sf_dir}/{source}.parquet")
    )


def with_tables(*names: str) -> str:
    """The derived tables as common table expressions for the oracle."""
    parts = []
    for n in names:
        base, expressions = TABLES[n]
        parts.append(f"{n} AS (SELECT {', '.join(expressions)} FROM {base + ' AS base' if base.startswith('(') else base})")
    return "WITH " + ", ".join(parts) + " "
