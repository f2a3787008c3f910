"""Queries of warps between grids and of the fine stack that is prepared with them; imported by the catalogue, which registers them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import products, raster, warp
from ..session import cut
from . import bindings as b
from .catalogue import DAYS_OF, query, r6, sql

DAYS_OF |= {"prepare_fine": ("date",)}

# Two sites: one whose fine and coarse grids share UTM zone 32, and one at 12 degrees east whose fine grid is of zone 33.
_FINE = {"zone": (32, 1), "x0": (500_000.0, -208_700.0), "y0": (5_700_000.0, -1_400.0), "dx": (10.0, 0.0), "dy": (10.0, 0.0), "height": (4, 0), "width": (4, 0)}
_COARSE = {"zone": (32, 0), "x0": (500_004.0, 208_644.0), "y0": (5_699_997.0, -1_400.0), "dx": (18.0, 0.0), "dy": (18.0, 0.0), "height": (2, 0), "width": (2, 0)}


def _grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sites = b.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("site")).distinct()
    sites = cut(sites)  # two rows, read many times
    of = lambda g: sites.select("site", *[(F.lit(x) + F.col("site") * y).cast("int" if isinstance(x, int) else "double").alias(c) for c, (x, y) in g.items()])
    return of(_FINE), of(_COARSE)


_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * 0.9996
_ROOT = 2 * math.sqrt(_N) / (1 + _N)


def _series(names: tuple[str, str, str], terms: list[float], f: str, g: str) -> str:
    first, at, other = names
    return first + "".join(f" + ({c!r}) * {f}({2 * k} * {at}) * {g}({2 * k} * {other})" for k, c in enumerate(terms, 1))


_BACK = [-(_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96), -(_N**2 / 48 + _N**3 / 15), -17 * _N**3 / 480]
_LATITUDE = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]
_FORTH = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
#: Positions centres(site, row, col, x, y) of zone 32 as `moved`, for site 1 in zone 33.
_MOVED = [
    f"m1 AS (SELECT site, row, col, x, y, y / {_RADIUS!r} AS xi, (x - 500000) / {_RADIUS!r} AS eta FROM centres)",
    f"m2 AS (SELECT *, {_series(('xi', 'xi', 'eta'), _BACK, 'sin', 'cosh')} AS a, {_series(('eta', 'xi', 'eta'), _BACK, 'cos', 'sinh')} AS e FROM m1)",
    "m3 AS (SELECT site, row, col, x, y, asin(sin(a) / cosh(e)) AS chi, atan2(sinh(e), cos(a)) + radians(9 - 15) AS lam FROM m2)",
    "m4 AS (SELECT *, chi" + "".join(f" + ({c!r}) * sin({2 * k} * chi)" for k, c in enumerate(_LATITUDE, 1)) + " AS phi FROM m3)",
    f"m5 AS (SELECT *, sinh(atanh(sin(phi)) - {_ROOT!r} * atanh({_ROOT!r} * sin(phi))) AS t FROM m4)",
    "m6 AS (SELECT site, row, col, x, y, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM m5)",
    f"moved AS (SELECT site, row, col, CASE WHEN site = 0 THEN x ELSE 500000 + {_RADIUS!r} * ({_series(('eta', 'xi', 'eta'), _FORTH, 'cos', 'sinh')}) END AS x, CASE WHEN site = 0 THEN y ELSE {_RADIUS!r} * ({_series(('xi', 'xi', 'eta'), _FORTH, 'sin', 'cosh')}) END AS y FROM m6)",
]


def _read(ratio: int, kernel: str) -> list[str]:
    """What the cells of the coarse bounds, `ratio` times as fine, read of the fine grids: near(site, row, col, r, c, w)."""
    step, wide = 18 / ratio, max(1.0, 18 / ratio / 10)

    def weight(cell: str, at: str) -> str:
        x = f"(abs({cell} + 0.5::DOUBLE - {at}) / {wide!r})"
        if kernel == "bilinear":
            return f"greatest(0.0::DOUBLE, 1 - {x})"
        return f"(CASE WHEN {x} < 1 THEN 1.5 * {x} ** 3 - 2.5 * {x} ** 2 + 1 WHEN {x} < 2 THEN -0.5 * {x} ** 3 + 2.5 * {x} ** 2 - 4 * {x} + 2 ELSE 0 END)"

    if kernel == "nearest":
        near = "SELECT site, row, col, CAST(floor(v) AS INT) AS r, CAST(floor(u) AS INT) AS c, 1.0::DOUBLE AS w FROM inside"
    else:
        four = "(VALUES (0), (1), (2), (3))"
        near = f"SELECT site, row, col, i.r, j.c, {weight('i.r', 'v')} * {weight('j.c', 'u')} AS w FROM inside, {four} i(r), {four} j(c)"
    return [
        "sites AS (SELECT DISTINCT scene % 2 AS site FROM px)",
        f"centres AS (SELECT site, r AS row, c AS col, 500004.0::DOUBLE + site * 208644 + (c + 0.5::DOUBLE) * {step!r} AS x, 5699997.0::DOUBLE - site * 1400 - (r + 0.5::DOUBLE) * {step!r} AS y FROM sites, range({2 * ratio}) a(r), range({2 * ratio}) o(c))",
        *_MOVED,
        "inside AS (SELECT * FROM (SELECT site, row, col, (5700000.0::DOUBLE - site * 1400 - y) / 10 AS v, (x - 500000.0::DOUBLE + site * 208700) / 10 AS u FROM moved) WHERE v >= 0 AND v < 4 AND u >= 0 AND u < 4)",
        f"near AS (SELECT * FROM ({near}) WHERE w <> 0)",
    ]


_SEEN = "seen AS (SELECT scene, scene % 2 AS site, row AS r, col AS c, CASE WHEN b02 > -0.2 THEN b02 END AS b02, b03 FROM px)"


def _warped(ratio: int, kernel: str) -> None:
    def run(spark, sf_dir):
        fine, coarse = _grids(spark, sf_dir)
        rows = b.px(spark, sf_dir).withColumn("site", F.col("scene") % 2).withColumn("b02", F.when(F.col("b02") > -0.2, F.col("b02")))
        return warp.warp(rows, fine, warp.refined(coarse, ratio), ["site"], ["scene", "site"], ["b02", "b03"], kernel)

    run.__name__ = f"warp_{kernel}"
    values = "max(b02) AS b02", "max(b03) AS b03"
    if kernel != "nearest":
        values = tuple(f"sum(w * {x}) / nullif(sum(w) FILTER ({x} IS NOT NULL), 0) AS {x}" for x in ("b02", "b03"))
    query(sql([b.PX, *_read(ratio, kernel), _SEEN], f"SELECT scene, site, CAST(row AS INT) AS row, CAST(col AS INT) AS col, {r6(*values)} FROM seen JOIN near USING (site, r, c) GROUP BY 1, 2, 3, 4"))(run)


_warped(2, "bilinear")
_warped(1, "cubic")
_warped(3, "nearest")


@query(sql([b.PX, *_read(2, "bilinear"), "mean AS (SELECT scene, p.scene % 2 AS site, n.row, n.col, " + ", ".join(f"sum(w * (p.{x} + 0.6)) / sum(w) AS {x}" for x in ("b02", "b03", "b04")) + " FROM px p JOIN near n ON n.site = p.scene % 2 AND n.r = p.row AND n.c = p.col GROUP BY 1, 2, 3, 4)"],
           "SELECT scene, site, CAST(row AS INT) AS row, CAST(col AS INT) AS col, " + r6("CASE WHEN b02 + b03 + b04 > 0 THEN b03 / (b02 + b03 + b04) END AS truth") + " FROM mean"))
def withheld_on_grid(spark, sf_dir):
    """The withheld scenes' greenness on the fusion grid."""
    fine, coarse = _grids(spark, sf_dir)
    rows = b.bright(b.px(spark, sf_dir)).withColumn("site", F.col("scene") % 2)
    return products.truth_on_grid(rows, fine, warp.refined(coarse, 2), ["site"], ["scene", "site"])


@query(sql([b.PX, *_read(2, "bilinear"), """named AS (SELECT scene % 2 AS site, date, 'scene' || lpad(CAST(scene AS VARCHAR), 9, '0') AS filename, scene, row AS r, col AS c, b02, b03, b04, b8a FROM px WHERE scene % 5 <> 0),
chosen AS (SELECT * FROM named k WHERE filename = (SELECT min(filename) FROM named o WHERE o.site = k.site AND o.date = k.date)),
refl AS (SELECT site, date, filename, near.row, near.col, """ + ", ".join(f"sum(w * {x} * 10000 / 10000) / sum(w) AS {x}" for x in raster.BANDS) + """ FROM chosen JOIN near USING (site, r, c) GROUP BY 1, 2, 3, 4, 5),
seen AS (SELECT site, date, filename, row // 2 AS r, col // 2 AS c, count(*) FILTER (greatest(b02, b03, b04, b8a) > 0.001) AS n FROM refl GROUP BY 1, 2, 3, 4, 5),
cells AS (SELECT k.site, k.date, k.filename, k.r, k.c, coalesce(n, 0) = 4 AS clear FROM (SELECT DISTINCT site, date, filename, a.r, o.c FROM chosen, (VALUES (0), (1)) a(r), (VALUES (0), (1)) o(c)) k LEFT JOIN seen s ON s.filename = k.filename AND s.r = k.r AND s.c = k.c),
away AS (SELECT a.site, a.date, a.filename, a.r, a.c, min(sqrt((a.r - k.r) ** 2 + (a.c - k.c) ** 2)) AS d FROM cells a LEFT JOIN cells k ON k.filename = a.filename AND NOT k.clear GROUP BY 1, 2, 3, 4, 5),
scaled AS (SELECT *, CASE WHEN max(d) OVER (PARTITION BY filename) <= 1 AND d > 0 THEN 2.0 ELSE d END AS distance FROM away)"""],
           "SELECT f.site, f.date, f.filename, CAST(row AS INT) AS row, CAST(col AS INT) AS col, " + r6(*raster.BANDS, "distance") + " FROM refl f JOIN scaled s ON s.filename = f.filename AND s.r = f.row // 2 AND s.c = f.col // 2"))
def prepare_fine(spark, sf_dir):
    """Scenes of two sites on the bounds of their coarse scenes; every fifth scene is excluded."""
    fine, coarse = _grids(spark, sf_dir)
    name = F.concat(F.lit("scene"), F.lpad(F.col("vec_id").cast("string"), 9, "0"))
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 366).cast("int"))
    tiles = b.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("site"), date.alias("date"), name.alias("filename"), F.transform("embedding", lambda x: x.cast("double") * 10_000).alias("bands"), "vec_id")
    return products.prepare_fine(tiles.drop("vec_id"), tiles.filter("vec_id % 5 = 0").select("filename"), fine, coarse, 2)
