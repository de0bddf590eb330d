"""Augmentation queries."""

from math import pi

from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_normal as N
from ..functions.keyed import sql_rounded as R
from ..functions.keyed import sql_uniform as U
from ..functions.keyed import uniform
from ..operators import augment
from ..registry import query
from ..sources.tables import images, table, voxel_classes, volumes, with_views
from ..sources.views import features


@query(
    "augment_flip_2d",
    with_views(
        f"SELECT vec_id, CASE WHEN fx THEN 7 - a ELSE a END AS x, CASE WHEN fy THEN 7 - b ELSE b END AS y, value FROM (SELECT vec_id, value, CASE WHEN t THEN y ELSE x END AS a, CASE WHEN t THEN x ELSE y END AS b, fx, fy FROM img8 JOIN (SELECT vec_id, {U('flipt', 'vec_id')} < 0.5 AS t, {U('flipx', 'vec_id')} < 0.5 AS fx, {U('flipy', 'vec_id')} < 0.5 AS fy FROM embeddings) USING (vec_id))",
        "img8",
    ),
)
def augment_flip_2d(spark, d):
    return augment.flipped_2d(images(spark, d), "vec_id", 8, "flip").select("vec_id", "x", "y", "value")


_ORDERS = ("zxy", "zyx", "xzy", "xyz", "yzx", "yxz")
_PERMUTED = ", ".join(f"CASE WHEN f{a} THEN 7 - (CASE k {' '.join(f'WHEN {k} THEN {o[i]}' for k, o in enumerate(_ORDERS))} END) ELSE (CASE k {' '.join(f'WHEN {k} THEN {o[i]}' for k, o in enumerate(_ORDERS))} END) END AS {a}" for i, a in enumerate("zxy"))


@query("augment_flip_3d", with_views(f"SELECT cube_id, {_PERMUTED}, value FROM vol8 JOIN (SELECT cube_id, CAST(floor({U('f3p', 'cube_id')} * 6) AS BIGINT) AS k, {U('f3z', 'cube_id')} < 0.5 AS fz, {U('f3x', 'cube_id')} < 0.5 AS fx, {U('f3y', 'cube_id')} < 0.5 AS fy FROM (SELECT DISTINCT cube_id FROM vol8)) USING (cube_id)", "vol8"))
def augment_flip_3d(spark, d):
    return augment.flipped_3d(volumes(spark, d), "cube_id", 8, "f3")


@query("augment_grey", with_views(f"SELECT vec_id, x, y, {R('power(least(greatest(v * a + c, 0.0), 1.0), g)', 4)} AS value FROM (SELECT vec_id, x, y, least(greatest(value + 0.5, 0.0), 1.0) AS v FROM img8) JOIN (SELECT vec_id, 1.0 + 0.3 * ({U('greya', 'vec_id')} - 0.5) AS a, 0.3 * ({U('greyc', 'vec_id')} - 0.5) AS c, power(2.0, 2.0 * {U('greyg', 'vec_id')} - 1.0) AS g FROM embeddings) USING (vec_id)", "img8"))
def augment_grey(spark, d):
    v = F.least(F.greatest(F.col("value") + 0.5, F.lit(0.0)), F.lit(1.0))
    return images(spark, d).select("vec_id", "x", "y", r(augment.grey(v, "grey", F.col("vec_id")), 4).alias("value"))


def _params(seed: str, key: str, source: str, dims: int = 2) -> str:
    u = lambda n: U(seed + n, key)
    both = lambda n, m: f"{m} * 2.0 * ({u(n)} - 0.5)"
    if dims == 2:
        cols = f"{both('rot', 15.0)} AS rot, {both('shear', 3.0)} AS shear, CAST(1.0 AS DOUBLE) AS scale_0, 1.0 + (1.1::DOUBLE - 1.0) * {u('scale1')} AS scale_1, {both('stretch0', 0.1)} AS stretch_0, {both('stretch1', 0.1)} AS stretch_1"
    else:
        cols = f"{both('twist', 15.0)} AS twist, least(15.0 - abs({both('twist', 15.0)}), 15.0 * {u('rot')}) AS rot, {both('shear', 3.0)} AS shear, " + ", ".join(f"1.0 + (1.1::DOUBLE - 1.0) * {u(f'scale{a}')} AS scale_{a}" for a in "012") + ", " + ", ".join(f"{both(f'stretch{a}', 0.1)} AS stretch_{a}" for a in "0123")
    return f"par AS (SELECT {key}, {cols} FROM {source})"


@query("warp_params", f"WITH {_params('warp', 'vec_id', 'embeddings')} SELECT vec_id, {R('rot')} AS rot, {R('shear')} AS shear, {R('scale_1')} AS scale_1, {R('stretch_0')} AS stretch_0, {R('stretch_1')} AS stretch_1 FROM par")
def warp_params(spark, d):
    p = augment.warp_params(table(spark, d, "embeddings").select("vec_id"), "vec_id", "warp")
    return p.select("vec_id", *(r(F.col(c)).alias(c) for c in ("rot", "shear", "scale_1", "stretch_0", "stretch_1")))


_RAD = repr(pi / 180)


def _uv(x: str, y: str, c: float, rot: str, z: str | None = None) -> tuple[str, str]:
    mx, my = f"stretch_0 / {c} * ({y})", f"stretch_1 / {c} * ({x})"
    if z:
        mx, my = f"{mx} + stretch_2 / {c} * ({z})", f"{my} + stretch_3 / {c} * ({z})"
    xt, yt = f"({x}) * (1.0 / scale_0 + ({mx}))", f"({y}) * (1.0 / scale_1 + ({my}))"
    sh = f"shear * {_RAD}::DOUBLE"
    u = f"({xt}) * cos({rot} - {sh}) - ({yt}) * sin({rot} + {sh}) + {c}"
    v = f"({yt}) * cos({rot} + {sh}) + ({xt}) * sin({rot} - {sh}) + {c}"
    return u, v


_U2, _V2 = _uv("tx - 3.5", "ty - 3.5", 3.5, f"rot * {_RAD}::DOUBLE")
_GRID2 = "grid AS (SELECT tx, ty FROM (SELECT unnest(range(8)) AS tx) CROSS JOIN (SELECT unnest(range(8)) AS ty))"
_MAP2 = f"map AS (SELECT vec_id, tx, ty, CAST(trunc({_U2} + 0.5) AS BIGINT) AS x, CAST(trunc({_V2} + 0.5) AS BIGINT) AS y FROM par CROSS JOIN grid)"


@query("augment_warp2d", with_views("SELECT m.vec_id, tx AS x, ty AS y, coalesce(i.value, 0.0) AS value FROM map m LEFT JOIN img8 i ON i.vec_id = m.vec_id AND i.x = m.x AND i.y = m.y", "img8", more=f"{_params('warp', 'vec_id', 'embeddings')}, {_GRID2}, {_MAP2}"))
def augment_warp2d(spark, d):
    p = augment.warp_params(table(spark, d, "embeddings").select("vec_id"), "vec_id", "warp")
    return augment.gathered(augment.warp_map_2d(p, 8, 8), images(spark, d), "vec_id", ("x", "y"))


_U3, _V3 = _uv("tx - 3.5", "ty - 3.5", 3.5, f"(rot * {_RAD}::DOUBLE + (tz - 3.5) * (twist * {_RAD}::DOUBLE / 3.5))", "tz - 3.5")
_GRID3 = "grid AS (SELECT tz, tx, ty FROM (SELECT unnest(range(8)) AS tz) CROSS JOIN (SELECT unnest(range(8)) AS tx) CROSS JOIN (SELECT unnest(range(8)) AS ty))"
_MAP3 = f"map AS (SELECT cube_id, tz, tx, ty, CAST(trunc((tz - 3.5) / scale_2 + 3.5 + 0.5) AS BIGINT) AS z, CAST(trunc({_U3} + 0.5) AS BIGINT) AS x, CAST(trunc({_V3} + 0.5) AS BIGINT) AS y FROM par CROSS JOIN grid)"
_CUBES = "(SELECT DISTINCT vec_id // 8 AS cube_id FROM embeddings)"
_WARP3 = f"{_params('warp3', 'cube_id', _CUBES, 3)}, {_GRID3}, {_MAP3}"


def _map3(spark, d):
    cubes = table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("cube_id")).distinct()
    return augment.warp_map_3d(augment.warp_params(cubes, "cube_id", "warp3", dims=3), 8, 8)


@query("augment_warp3d", with_views("SELECT m.cube_id, tz AS z, tx AS x, ty AS y, coalesce(i.value, 0.0) AS value FROM map m LEFT JOIN vol8 i ON i.cube_id = m.cube_id AND i.z = m.z AND i.x = m.x AND i.y = m.y", "vol8", more=_WARP3))
def augment_warp3d(spark, d):
    return augment.gathered(_map3(spark, d), volumes(spark, d), "cube_id", ("z", "x", "y"))


@query("augment_warp_labels", with_views("SELECT m.cube_id, tz - 1 AS z, tx - 1 AS x, ty - 1 AS y, coalesce(i.cls, 0) AS cls FROM map m LEFT JOIN (SELECT * FROM cls8 WHERE z BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6) i ON i.cube_id = m.cube_id AND i.z = m.z AND i.x = m.x AND i.y = m.y WHERE tz BETWEEN 1 AND 6 AND tx BETWEEN 1 AND 6 AND ty BETWEEN 1 AND 6", "cls8", more=_WARP3))
def augment_warp_labels(spark, d):
    inner = " AND ".join(f"{a} BETWEEN 1 AND 6" for a in ("z", "x", "y"))
    labels = voxel_classes(volumes(spark, d)).where(inner)
    target = _map3(spark, d).where(" AND ".join(f"t{a} BETWEEN 1 AND 6" for a in ("z", "x", "y")))
    out = augment.gathered(target, labels, "cube_id", ("z", "x", "y"), "cls")
    return out.select("cube_id", *((F.col(a) - 1).alias(a) for a in ("z", "x", "y")), "cls")


@query("warp_gate", f"WITH {_params('warp', 'vec_id', 'embeddings')} SELECT vec_id, CASE WHEN {U('gate', 'vec_id')} < 0.5 AND abs(rot) < 10 THEN 'warp' WHEN {U('gate', 'vec_id')} < 0.5 THEN 'fallback' ELSE 'cut' END AS branch FROM par")
def warp_gate(spark, d):
    p = augment.warp_params(table(spark, d, "embeddings").select("vec_id"), "vec_id", "warp")
    feasible = p.where(F.abs("rot") < 10).select("vec_id", F.lit(True).alias("ok"))
    gated = p.select("vec_id").join(feasible, "vec_id", "left").withColumn("on", uniform("gate", F.col("vec_id")) < 0.5)
    return gated.select("vec_id", F.when(F.col("on") & F.coalesce("ok", F.lit(False)), "warp").when(F.col("on"), "fallback").otherwise("cut").alias("branch"))


_UC, _VC = _uv("i - 3.5", "j - 3.5", 3.5, f"rot * {_RAD}::DOUBLE")


def _grown(a: str) -> str:
    return f"CAST(8 + 2 * greatest(floor(abs(least(min({a}), 0.0))), ceil(greatest(max({a}) - 7, 0.0))) AS BIGINT)"


@query("warp_required_size", f"WITH {_params('warp', 'vec_id', 'embeddings')} SELECT vec_id, {_grown('u')} AS req_x, {_grown('v')} AS req_y FROM (SELECT vec_id, {_UC} AS u, {_VC} AS v FROM par CROSS JOIN (SELECT unnest([0, 7]) AS i) CROSS JOIN (SELECT unnest([0, 7]) AS j)) GROUP BY vec_id")
def warp_required_size(spark, d):
    return augment.required_size(augment.warp_params(table(spark, d, "embeddings").select("vec_id"), "vec_id", "warp"), "vec_id", 8)


@query("shift_augment", with_views(f"SELECT copy, vec_id, x - dx AS x, y - dy AS y, value FROM img8 CROSS JOIN (SELECT k // 2 AS dx, k % 2 AS dy, row_number() OVER (ORDER BY {U('shift', 'k')}, k) - 1 AS copy FROM (SELECT unnest(range(4)) AS k)) WHERE copy < 3 AND x - dx BETWEEN 0 AND 6 AND y - dy BETWEEN 0 AND 6", "img8"))
def shift_augment(spark, d):
    return augment.shifted_copies(images(spark, d).drop("label"), "vec_id", 2, 3, 8, "shift")


@query("augment_batch_warp", with_views(f"SELECT m.vec_id, tx AS x, ty AS y, coalesce(i.value, 0.0) AS value FROM (SELECT vec_id, tx, ty, CAST(trunc({_U2.replace('rot *', '(rot + twist * (vec_id % 50 - 24.5) / 24.5) *')} + 0.5) AS BIGINT) AS x, CAST(trunc({_V2.replace('rot *', '(rot + twist * (vec_id % 50 - 24.5) / 24.5) *')} + 0.5) AS BIGINT) AS y FROM bpar CROSS JOIN grid) m LEFT JOIN img8 i ON i.vec_id = m.vec_id AND i.x = m.x AND i.y = m.y", "img8", more=f"bpar AS (SELECT vec_id, 0.0::DOUBLE AS rot, 7.0 * 2.0 * ({U('bw', chr(39) + 'shear' + chr(39), 'vec_id // 50')} - 0.5) AS shear, 5.0 * 2.0 * ({U('bw', chr(39) + 'twist' + chr(39), 'vec_id // 50')} - 0.5) AS twist, 1.0 + 0.15::DOUBLE * {U('bw', chr(39) + 'sx' + chr(39), 'vec_id // 50')} AS scale_0, 1.0 + 0.15::DOUBLE * {U('bw', chr(39) + 'sy' + chr(39), 'vec_id // 50')} AS scale_1, 0.25 * 2.0 * ({U('bw', chr(39) + 'tx' + chr(39), 'vec_id // 50')} - 0.5) AS stretch_0, 0.25 * 2.0 * ({U('bw', chr(39) + 'ty' + chr(39), 'vec_id // 50')} - 0.5) AS stretch_1 FROM embeddings), {_GRID2}"))
def augment_batch_warp(spark, d):
    batch = F.expr("vec_id div 50")
    u = lambda name: uniform("bw", name, batch)
    p = table(spark, d, "embeddings").select("vec_id").withColumns({"shear": 7.0 * 2.0 * (u("shear") - 0.5), "twist": 5.0 * 2.0 * (u("twist") - 0.5), "scale_0": 1.0 + 0.15 * u("sx"), "scale_1": 1.0 + 0.15 * u("sy"), "stretch_0": 0.25 * 2.0 * (u("tx") - 0.5), "stretch_1": 0.25 * 2.0 * (u("ty") - 0.5)})
    p = p.withColumn("rot", 0.0 + F.col("twist") * (F.col("vec_id") % 50 - 24.5) / 24.5)
    return augment.gathered(augment.warp_map_2d(p, 8, 8), images(spark, d), "vec_id", ("x", "y"))


@query("input_noise", with_views(f"SELECT vec_id, x, y, {R('value + 0.1 * ' + N('noise', 'vec_id', 'x', 'y'), 4)} AS value FROM img8", "img8"))
def input_noise(spark, d):
    return images(spark, d).select("vec_id", "x", "y", r(augment.noisy(F.col("value"), 0.1, "noise", F.col("vec_id"), F.col("x"), F.col("y")), 4).alias("value"))


_PATTERN = f"pt AS (SELECT x, y, v / max(v) OVER () AS g FROM (SELECT x, y, 0.5 + 2 * CASE WHEN x = y THEN 1 ELSE 0 END + 2 * CASE WHEN x + y = 7 THEN 1 ELSE 0 END + CASE WHEN x = 0 THEN 1 ELSE 0 END + CASE WHEN x = 7 THEN 1 ELSE 0 END + CASE WHEN y = 0 THEN 1 ELSE 0 END + CASE WHEN y = 7 THEN 1 ELSE 0 END AS v FROM (SELECT unnest(range(8)) AS x) CROSS JOIN (SELECT unnest(range(8)) AS y)))"


@query("test_pattern", with_views(f"SELECT vec_id, x, y, {R('value * g')} AS value FROM img8 JOIN pt USING (x, y)", "img8", more=_PATTERN))
def test_pattern(spark, d):
    """Images under the test pattern of their extent."""
    pattern = augment.pattern(spark, 8, 8).withColumnRenamed("value", "g")
    return images(spark, d).join(F.broadcast(pattern), ["x", "y"]).select("vec_id", "x", "y", r(F.col("value") * F.col("g")).alias("value"))


@query("dropout_gate", with_views(f"SELECT vec_id, x * 8 + y AS i, CASE WHEN {U('drop', 'vec_id', 'x * 8 + y')} >= 0.5 THEN {R('2.0 * value')} ELSE 0.0::DOUBLE END AS value FROM img8", "img8"))
def dropout_gate(spark, d):
    """Features with half of them dropped."""
    return features(spark, d).select("vec_id", "i", r(F.col("value") * augment.dropout(0.5, "drop", F.col("vec_id"), F.col("i"))).alias("value"))
