"""The column functions as SQL functions of a session, for queries written in SQL. They are SQL themselves, so the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewatch.functions import geo, grid, ident

_PLACE = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
_NUMBER = " + ".join(f"int(substring(imo, {i + 1}, 1)) * {7 - i}" for i in range(6))
_PREFIX = "|".join(sorted(ident.NAME_PREFIXES, key=len, reverse=True))

FUNCTIONS = {
    f"tw_haversine({_PLACE}) RETURNS DOUBLE": f"2 * {geo.EARTH_M}D * asin(sqrt(least(1D, power(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin((radians(lon2) - radians(lon1)) / 2), 2))))",
    f"tw_bearing({_PLACE}) RETURNS DOUBLE": "pmod(degrees(atan2(sin(radians(lon2) - radians(lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1)))), 360D)",
    "tw_turn(before DOUBLE, after DOUBLE) RETURNS DOUBLE": "abs(pmod(after - before + 180D, 360D) - 180D)",
    **{f"tw_cell_r{r}(lat DOUBLE, lon DOUBLE) RETURNS BIGINT": grid.cell_sql("lat", "lon", r) for r in grid.EDGE},
    "tw_imo_valid(imo STRING) RETURNS BOOLEAN": f"coalesce(imo rlike '^[0-9]{{7}}$', false) and coalesce(({_NUMBER}) % 10 = int(substring(imo, 7, 1)), false)",
    "tw_name(name STRING) RETURNS STRING": f"nullif(regexp_replace(regexp_replace(trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ')), '^(?:(?:{_PREFIX}) )+', ''), '^(?:{_PREFIX})$', ''), '')",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
