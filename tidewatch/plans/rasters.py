"""Queries over rasters: an image in tiles, its ships, its coast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import rasters
from tidewatch.plans.registry import query
from tidewatch.sources.bindings import table

#: The image that orders make: a pixel an order, in rows of 128; clutter from the price, ships on a lattice, coast in some rows.
_COLS, _COAST_PX = 128, 3
_CENTS = "cast(round(o_totalprice * 100) as bigint)"
_SHIP = f"(o_orderkey // {_COLS}) % 40 between 18 and 21 and (o_orderkey % {_COLS}) % 40 between 17 and 23 and {_CENTS} % 10 < 7"
_LAND = f"(o_orderkey // {_COLS}) % 90 >= 60 and o_orderkey % {_COLS} < 15"
_PIXELS_SQL = f"""px as (select o_orderkey // {_COLS} as r, o_orderkey % {_COLS} as c, (97 + {_CENTS} % 97 + case when {_SHIP} then 6000 else 0 end)::double as v, {_LAND} as land from orders),
    dim as (select max(r) + 1 as n from px)"""


def _image(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, land pixels) of the scene."""
    spark_sql = lambda text: F.expr(text.replace("o_orderkey // 128", "o_orderkey div 128"))
    o = table(spark, sf_dir, "orders")
    # The scene's rows follow from one number, the largest key.
    n_rows = (o.agg(F.max("o_orderkey")).first()[0] or 0) // _COLS + 1
    value = 97 + spark_sql(f"{_CENTS} % 97") + F.when(spark_sql(_SHIP), 6000).otherwise(0)
    px = o.select(F.lit("orders").alias("scene_id"), spark_sql("o_orderkey div 128").alias("row"), (F.col("o_orderkey") % _COLS).alias("col"), value.alias("value"), F.lit(n_rows).alias("n_rows"), F.lit(_COLS).alias("n_cols"), spark_sql(_LAND).alias("land"))
    return px.drop("land"), px.filter("land").withColumn("value", F.lit(1)).drop("land")


@query(f"""with recursive {_PIXELS_SQL},
    rows_ as (select e, case when e < 0 then -1 - e when e >= n then 2 * n - 1 - e else e end as r from dim, unnest(range(-25, n + 25)) u(e)),
    cols_ as (select e, case when e < 0 then -1 - e when e >= {_COLS} then {2 * _COLS - 1} - e else e end as c from unnest(range(-25, {_COLS + 25})) u(e)),
    grid as (select y.e as r, x.e as c, px.v from rows_ y cross join cols_ x left join px on px.r = y.r and px.c = x.c),
    across as (select *, sum(v) over o as so, count(v) over o as no, sum(v) over i as si, count(v) over i as ni from grid
        window o as (partition by r order by c rows between 25 preceding and 25 following), i as (partition by r order by c rows between 12 preceding and 12 following)),
    down as (select *, coalesce(sum(so) over o, 0) - coalesce(sum(si) over i, 0) as s, sum(no) over o - sum(ni) over i as n from across
        window o as (partition by c order by r rows between 25 preceding and 25 following), i as (partition by c order by r rows between 12 preceding and 12 following)),
    sea as (select d.r, d.c, d.v, s / n as mu from down d where d.v is not null and d.r >= 0 and d.r < (select n from dim) and d.c between 0 and {_COLS - 1} and n > 0
        and d.v > n * (pow(1e-6, -1.0 / n) - 1) * greatest(s / n, 1e-12)),
    near as (select distinct sea.r, sea.c from sea join px on px.land and abs(sea.r - px.r) + abs(sea.c - px.c) <= {_COAST_PX}),
    hot as (select r * {_COLS} + c as id, sea.* from sea anti join near using (r, c)),
    reach(id, blob) as (select id, id from hot union select b.id, reach.blob from reach join hot a on a.id = reach.id join hot b on abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1),
    named as (select id, min(blob) as blob from reach group by id),
    e as (select blob, count(*) as area_px, sum(v * r) / sum(v) as y, sum(v * c) / sum(v) as x, max(v) as peak, avg(mu) as around, var_pop(r) as rr, var_pop(c) as cc, covar_pop(r, c) as rc from hot join named using (id) group by blob having count(*) between 3 and 4000)
    select e.blob, area_px, round(y, 4) as row_, round(x, 4) as col_, peak, round(10 * log10(peak / coalesce(hot.mu, around)), 4) as contrast_db,
        round(4 * sqrt((rr + cc) / 2 + sqrt(pow((rr - cc) / 2, 2) + rc * rc)), 4) as length_px from e left join named on named.blob = e.blob and named.id = floor(y) * {_COLS} + floor(x) left join hot on hot.id = named.id""")
def raster_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright objects off the coast, in blocks of 64 pixels with halos, from tiles of 48."""
    image, land = (rasters.tiles_of(x, 48) for x in _image(spark, sf_dir))
    found = rasters.detect(image, land, _COAST_PX, block=64)
    return found.select("blob", "area_px", F.round("row", 4).alias("row_"), F.round("col", 4).alias("col_"), "peak", F.round("contrast_db", 4).alias("contrast_db"), F.round("length_px", 4).alias("length_px"))
