"""Networks over volumes: forward passes, gradients, training, and dense prediction by tiles."""

import numpy as np
from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_rounded as R
from ..functions.keyed import sql_uniform as U
from ..functions.keyed import uniform
from ..operators import batches, graph, kernels, nets, tiles
from ..plans import trainer
from ..registry import query
from ..sources.tables import table, volumes, with_views
from ..sources.views import biases, sql_biases, sql_weights, weights
from .inference import malis_sql
from .sampling import CDF, cdf

K1 = {"f": 2, "ch": 1, "kz": 3, "kx": 3, "ky": 3}
K2 = {"f": 2, "ch": 2, "kz": 2, "kx": 2, "ky": 2}
EXTENT = (8, 8, 8)
#: Volumes of all their slices.
_WHOLE = "wv8 AS MATERIALIZED (SELECT * FROM vol8 WHERE cube_id IN (SELECT vec_id // 8 FROM embeddings GROUP BY 1 HAVING count(*) = 8))"
_KERNELS = ", ".join((_WHOLE, sql_weights("v1", "vol1", K1, 0.4), sql_biases("vb1", "vol1b", "f", 2), sql_weights("v2", "vol2", K2, 0.4), sql_biases("vb2", "vol2b", "f", 2)))
#: First layer at every position: a true convolution, before its pool.
_FIRST = f"""{_KERNELS},
f1 AS MATERIALIZED (SELECT cube_id, f, z - 2 + kz AS z, x - 2 + kx AS x, y - 2 + ky AS y, sum(value * w) AS v FROM wv8 CROSS JOIN v1
  WHERE z - 2 + kz BETWEEN 0 AND 5 AND x - 2 + kx BETWEEN 0 AND 5 AND y - 2 + ky BETWEEN 0 AND 5 GROUP BY ALL)"""


def slices(spark, d):
    """Embeddings as the slices of volumes of eight: whole ones only."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("cube_id"), (F.col("vec_id") % 8).alias("z"), F.transform("embedding", lambda v: r(v.cast("double"), 4)).alias("values"))
    whole = e.groupBy("cube_id").count().where("count = 8").select("cube_id")
    return tiles.slab_pieces(e.join(whole, "cube_id", "left_semi"), "cube_id", "z", "values", 8, 8)


def _array(spark, name, dims, value="w"):
    return kernels.weights_array((weights if value == "w" else biases)(spark, name, *((dims, 0.4) if value == "w" else dims)), dims if value == "w" else dict([dims]), value)


def _net(spark):
    """A convolution with a pool of two along each axis and a second convolution with two classes, on the keyed parameters that the twins have."""
    net = nets.Net((1, *EXTENT), [nets.Layer("conv", 1, 2, "tanh", 3, 2, dims=3), nets.Layer("conv", 2, 2, "linear", 2, dims=3)], 2)
    return net, np.concatenate([_array(spark, "vol1", K1).ravel(), _array(spark, "vol1b", ("f", 2), "b"), _array(spark, "vol2", K2).ravel(), _array(spark, "vol2b", ("f", 2), "b")])


def _whole(spark, d):
    """Volumes as examples of their own: (key, features)."""
    at = F.array_sort(F.collect_list(F.struct("z", "values")))
    return slices(spark, d).groupBy("key").agg(F.flatten(F.transform(at, lambda s: s["values"])).alias("features"))  # eight slices


_TWO = f"""{_FIRST},
h1 AS (SELECT cube_id, f AS ch, z // 2 AS z, x // 2 AS x, y // 2 AS y, tanh(max(v) + any_value(b)) AS h FROM f1 JOIN vb1 USING (f) GROUP BY ALL),
f2 AS (SELECT cube_id, v2.f, z - 1 + kz AS z, x - 1 + kx AS x, y - 1 + ky AS y, sum(h * w) + any_value(b) AS v FROM h1 JOIN v2 USING (ch) JOIN vb2 ON vb2.f = v2.f
  WHERE z - 1 + kz BETWEEN 0 AND 1 AND x - 1 + kx BETWEEN 0 AND 1 AND y - 1 + ky BETWEEN 0 AND 1 GROUP BY ALL)"""
_SHARE = "exp(v) / sum(exp(v)) OVER (PARTITION BY cube_id, z, x, y)"


@query("forward_volume_net", with_views(f"SELECT cube_id, f AS c, z * 4 + x * 2 + y AS pos, {R(_SHARE)} AS p FROM f2", "vol8", more=_TWO))
def forward_volume_net(spark, d):
    net, w = _net(spark)
    out = nets.outputs(_whole(spark, d), net, w)
    return out.select(F.col("key").alias("cube_id"), "c", "pos", r(F.col("p")).alias("p"))


_DENSE = f"""{_FIRST},
g1 AS (SELECT a.cube_id, a.f AS ch, a.z - dz AS z, a.x - dx AS x, a.y - dy AS y, tanh(max(a.v) + any_value(b)) AS h FROM f1 a JOIN vb1 USING (f), (SELECT unnest(range(2)) AS dz), (SELECT unnest(range(2)) AS dx), (SELECT unnest(range(2)) AS dy)
  WHERE a.z - dz BETWEEN 0 AND 4 AND a.x - dx BETWEEN 0 AND 4 AND a.y - dy BETWEEN 0 AND 4 GROUP BY ALL),
f2 AS (SELECT cube_id, v2.f, z - 2 + 2 * kz AS z, x - 2 + 2 * kx AS x, y - 2 + 2 * ky AS y, sum(h * w) + any_value(b) AS v FROM g1 JOIN v2 USING (ch) JOIN vb2 ON vb2.f = v2.f
  WHERE z - 2 + 2 * kz BETWEEN 0 AND 2 AND x - 2 + 2 * kx BETWEEN 0 AND 2 AND y - 2 + 2 * ky BETWEEN 0 AND 2 GROUP BY ALL)"""
_DENSE_SQL = with_views(f"SELECT cube_id, f AS c, z, x, y, {R(_SHARE)} AS p FROM f2", "vol8", more=_DENSE)


def _dense(spark, d, how, **more):
    net, w = _net(spark)
    return tiles.predicted(slices(spark, d), EXTENT, net, w, (2, 2, 2), how, **more)


@query("predict_volume_fragments", _DENSE_SQL)
def predict_volume_fragments(spark, d):
    return tiles.voxels(_dense(spark, d, "fragments"), 6).withColumnRenamed("key", "cube_id")


@query("predict_volume_strided", _DENSE_SQL)
def predict_volume_strided(spark, d):
    return tiles.voxels(_dense(spark, d, "strides"), 6).withColumnRenamed("key", "cube_id")


_MIRROR = lambda a: f"CASE WHEN {a} < 0 THEN -1 - ({a}) WHEN {a} > 7 THEN 15 - ({a}) ELSE {a} END"
#: The field is six wide, so two positions are mirrored before the volume and two behind it.
_GROWN = f"""{_WHOLE}, gv AS MATERIALIZED (SELECT cube_id, a.i AS z, b.i AS x, c.i AS y, value FROM (SELECT unnest(range(12)) AS i) a, (SELECT unnest(range(12)) AS i) b, (SELECT unnest(range(12)) AS i) c
  JOIN wv8 v ON v.z = {_MIRROR('a.i - 2')} AND v.x = {_MIRROR('b.i - 2')} AND v.y = {_MIRROR('c.i - 2')})"""
_PADDED = _DENSE.replace(f"{_WHOLE}, ", "").replace("FROM wv8 CROSS JOIN v1", "FROM gv CROSS JOIN v1").replace("BETWEEN 0 AND 5", "BETWEEN 0 AND 9").replace("BETWEEN 0 AND 4", "BETWEEN 0 AND 8").replace("BETWEEN 0 AND 2 ", "BETWEEN 0 AND 6 ")


@query("predict_volume_padded", with_views(f"SELECT cube_id, f AS c, z, x, y, CAST(floor({R(_SHARE)} * 255.0) AS BIGINT) AS p FROM f2", "vol8", more=f"{_GROWN}, {_PADDED}"))
def predict_volume_padded(spark, d):
    return tiles.voxels(_dense(spark, d, "fragments", mirrored=True), as_uint8=True).withColumnRenamed("key", "cube_id")


_LABEL = "CASE WHEN abs(value) < 0.01 THEN -1 WHEN value > 0 THEN 1 ELSE 0 END"
_SLOPES = f"""{_KERNELS},
lin AS (SELECT cube_id, f, z - 2 + kz AS z, x - 2 + kx AS x, y - 2 + ky AS y, sum(value * w) + any_value(b) AS v FROM wv8 CROSS JOIN v1 JOIN vb1 USING (f)
  WHERE z - 2 + kz BETWEEN 0 AND 5 AND x - 2 + kx BETWEEN 0 AND 5 AND y - 2 + ky BETWEEN 0 AND 5 GROUP BY ALL),
pr AS (SELECT cube_id, z, x, y, [exp(v0) / (exp(v0) + exp(v1)), exp(v1) / (exp(v0) + exp(v1))] AS p, cls FROM (SELECT cube_id, z, x, y, max(CASE WHEN f = 0 THEN v END) AS v0, max(CASE WHEN f = 1 THEN v END) AS v1, max(cls) AS cls
  FROM (SELECT cube_id, f, z, x, y, v, NULL AS cls FROM lin UNION ALL SELECT cube_id, NULL, z - 1, x - 1, y - 1, NULL, {_LABEL} FROM wv8) GROUP BY cube_id, z, x, y) WHERE v0 IS NOT NULL AND cls >= 0),
sl AS MATERIALIZED (SELECT cube_id, f, z, x, y, p[f + 1] * (CASE WHEN cls = f THEN by_p ELSE 0.0 END - by_p * p[cls + 1]) AS s FROM (SELECT *, -1.0 / (p[cls + 1] + 1e-6) AS by_p, unnest([0, 1]) AS f FROM pr)),
n AS (SELECT count(*) / 2.0 AS n FROM sl)"""


def _labels(pieces):
    """The voxels' classes: 1 for positive values, 0 for others, -1 near zero."""
    return pieces.withColumn("values", F.transform("values", lambda v: F.when(F.abs(v) < 0.01, -1.0).when(v > 0, 1.0).otherwise(0.0)))


@query(
    "gradient_volume",
    with_views(
        f"SELECT f, kz, kx, ky, {R('sum(s * value) / any_value(n)', 8)} AS g FROM sl CROSS JOIN n CROSS JOIN (SELECT kz, kx, ky FROM v1 WHERE f = 0) k JOIN wv8 v ON v.cube_id = sl.cube_id AND v.z = sl.z + 2 - kz AND v.x = sl.x + 2 - kx AND v.y = sl.y + 2 - ky GROUP BY f, kz, kx, ky",
        "vol8",
        more=_SLOPES,
    ),
)
def gradient_volume(spark, d):
    """The gradient of a convolution over volumes with a softmax, added up over tiles with halos."""
    net = nets.Net((1, *EXTENT), [nets.Layer("conv", 1, 2, "linear", 3, dims=3)], 2)
    w = np.concatenate([_array(spark, "vol1", K1).ravel(), _array(spark, "vol1b", ("f", 2), "b")])
    pieces, own = slices(spark, d), (2, 3, 6)
    _, g, _ = nets.gradient(tiles.examples(pieces, _labels(pieces), EXTENT, net, own), net.at(tiles.example_extent(net, own)), w)
    rows = [(f, kz, kx, ky, float(v)) for (f, kz, kx, ky), v in np.ndenumerate(g[:54].reshape(2, 3, 3, 3))]
    return spark.createDataFrame(rows, "f long, kz long, kx long, ky long, g double").withColumn("g", r(F.col("g"), 8))


@query("train_volume_epochs")
def train_volume_epochs(spark, d):
    """The log of a network over volumes trained on tiles in four batches an epoch, judged on every fifth volume."""
    net, own, pieces = _net(spark)[0], (2, 2, 2), slices(spark, d)
    found = lambda p: tiles.examples(p, _labels(p), EXTENT, net, own)
    run = trainer.Trainer(net.at(tiles.example_extent(net, own)), found(pieces.where("key % 5 <> 0")), found(pieces.where("key % 5 = 0")), n_batches=4, rate=0.2)
    return run.run(8, evaluate_every=4).select("step", *(F.round(c, 9).alias(c) for c in ("loss", "rate", "valid_loss", "valid_error")))


# Quarters of volumes, eight slices of 4 x 4, with segments by half depth and half width.
_QUARTERS = "SELECT cube_id * 4 + (x // 4) * 2 + y // 4 AS vec_id, z * 16 + (x % 4) * 4 + y % 4 AS node, CAST(CASE WHEN value <= -0.02 THEN 0 ELSE 1 + (z // 4) * 2 + (x % 4) // 2 END AS BIGINT) AS seg FROM vol8"
_QUARTER_NEAR = "(m.node = n.node + 16 OR (m.node = n.node + 4 AND (n.node // 4) % 4 < 3) OR (m.node = n.node + 1 AND n.node % 4 < 3))"


def _quarter_edges(spark, d):
    v = volumes(spark, d)
    node = (F.col("z") * 16 + (F.col("x") % 4) * 4 + F.col("y") % 4).alias("node")
    seg = F.when(F.col("value") <= -0.02, F.lit(0)).otherwise(1 + F.expr("z div 4") * 2 + F.expr("(x % 4) div 2")).alias("seg")
    voxels = v.select((F.col("cube_id") * 4 + F.expr("x div 4") * 2 + F.expr("y div 4")).alias("vec_id"), node, seg)
    inside = ((F.col("sa") == F.col("sb")) & (F.col("sa") > 0)).cast("double")
    p = 0.05 + 0.45 * inside + 0.45 * uniform("malis2", F.col("vec_id"), F.col("a"), F.col("b"))
    return graph.lattice_edges(voxels, "vec_id", (8, 4, 4)).select("vec_id", "a", "b", p.alias("p"), "sa", "sb")


def _by_blocks(spark, d, restricted):
    return graph.maximin_edges_by_blocks(_quarter_edges(spark, d), "vec_id", (8, 4, 4), (2, 4, 4), restricted, dealt=True)


@query("malis_volume_counts", malis_sql(f"SELECT vec_id AS part_id, a, b, {R('p')} AS p, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg FROM mm", "p", _QUARTERS, _QUARTER_NEAR, "vol8"))
def malis_volume_counts(spark, d):
    return _by_blocks(spark, d, False).withColumn("p", r(F.col("p"))).withColumnRenamed("vec_id", "part_id")


@query("malis_volume_counts_restricted", malis_sql("SELECT vec_id AS part_id, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM mm GROUP BY vec_id", "CASE WHEN sa = sb AND sa > 0 THEN 1.0::DOUBLE ELSE p END", _QUARTERS, _QUARTER_NEAR, "vol8"))
def malis_volume_counts_restricted(spark, d):
    return graph.maximin_loss(_by_blocks(spark, d, True), "vec_id").select(F.col("vec_id").alias("part_id"), "n_pos", "n_neg")


def _stream(spark, d, plan, size, range_draws):
    pieces = slices(spark, d)
    labels = pieces.withColumn("values", F.transform("values", lambda v: F.when(F.abs(v) < 0.01, -1.0).when(v > 0, 1.0).otherwise(0.0)))
    cubes = batches.cubes_of(pieces, cdf(spark, d).withColumnRenamed("cube_id", "key"), EXTENT)
    return batches.Stream(batches.Volumes(pieces, labels, cubes, (1, 8, 8)), plan, size, range_draws)


def _batch_rows(batch):
    """(slot, cube_id, kind, i, value): values of features (kind 0) and labels (kind 1) by their place."""
    kinds = [batch.select(F.col("key").alias("slot"), F.col("volume").alias("cube_id"), F.lit(k).cast("long").alias("kind"), F.posexplode(c).alias("i", "v")) for k, c in enumerate(("features", "label"))]
    return kinds[0].withColumn("v", F.col("v").cast("double")).unionByName(kinds[1].withColumn("v", F.col("v").cast("double"))).select("slot", "cube_id", "kind", F.col("i").cast("long").alias("i"), r(F.col("v")).alias("value"))


_AT = lambda a, span: f"CAST(floor({U('whole' + a, 'draw', 'a')} * {span}) AS BIGINT)"
_TURNED = lambda a, n: f"CASE WHEN {U('wholem' + a, 'draw')} < 0.5 THEN {n - 1} - g{a} ELSE g{a} END"
_PICK = f"floor({U('wholeswap', 'draw')} * 6)"
#: Position on each axis before the axes were permuted: that of the turned axis that stands for it.
_BACK = [f"CASE {' '.join(f'WHEN {_PICK} = {k} THEN t{chr(122 if o.index(axis) == 0 else 119 + o.index(axis))}' for k, o in enumerate(batches.AXIS_ORDERS))} END" for axis in range(3)]
_GRADED = f"power(least(greatest(value * (1.0 + 0.3 * ({U('wholegreya', 'draw', '0')} - 0.5)) + 0.3 * ({U('wholegreyc', 'draw', '0')} - 0.5), 0.0), 1.0), power(2.0, 2.0 * {U('wholegreyg', 'draw', '0')} - 1.0))"
_DRAWS = f"""{_WHOLE}, {CDF},
dr AS MATERIALIZED (SELECT draw, cube_id FROM (SELECT draw, {U('wholecube', 'draw')} AS u FROM (SELECT unnest(range(400)) AS draw)) JOIN cdf ON u >= lo AND u < hi WHERE cube_id IN (SELECT cube_id FROM wv8)),
wc8 AS MATERIALIZED (SELECT w.*, CASE WHEN abs(value) < 0.01 THEN -1 WHEN value > 0 THEN 1 ELSE 0 END AS cls FROM wv8 w)"""
_TRIED = f"""{_DRAWS},
ca AS MATERIALIZED (SELECT draw, cube_id, a, {_AT('z', 4)} AS oz, {_AT('x', 4)} AS ox, {_AT('y', 4)} AS oy FROM dr, (SELECT unnest(range(11)) AS a)),
nn AS MATERIALIZED (SELECT draw, a, any_value(ca.cube_id) AS cube_id, any_value(oz) AS oz, any_value(ox) AS ox, any_value(oy) AS oy, count(*) FILTER (WHERE cls < 0) AS n FROM ca JOIN wc8 v ON v.cube_id = ca.cube_id AND z BETWEEN oz + 1 AND oz + 2 AND x BETWEEN ox + 1 AND ox + 2 AND y BETWEEN oy + 1 AND oy + 2 GROUP BY draw, a),
fit AS (SELECT draw, coalesce(min(a) FILTER (WHERE n <= 0.1 * 8), 10) AS a FROM nn GROUP BY draw),
ok AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY draw) - 1 AS slot FROM nn JOIN fit USING (draw, a) WHERE n <= 0.1 * 8),
tu AS (SELECT slot, draw, cube_id, oz, ox, oy, gz, gx, gy, {_TURNED('z', 4)} AS tz, {_TURNED('x', 4)} AS tx, {_TURNED('y', 4)} AS ty FROM ok, (SELECT unnest(range(4)) AS gz), (SELECT unnest(range(4)) AS gx), (SELECT unnest(range(4)) AS gy) WHERE slot BETWEEN 16 AND 31),
src AS (SELECT slot, draw, cube_id, gz, gx, gy, oz + {_BACK[0]} AS z, ox + {_BACK[1]} AS x, oy + {_BACK[2]} AS y FROM tu),
met AS (SELECT slot, draw, cube_id, gz, gx, gy, value, cls FROM src JOIN wc8 USING (cube_id, z, x, y))"""


@query(
    "whole_batch_volumes",
    with_views(
        f"SELECT slot, cube_id, 0::BIGINT AS kind, gz * 16 + gx * 4 + gy AS i, {R(_GRADED)} AS value FROM met UNION ALL SELECT slot, cube_id, 1::BIGINT, (gz - 1) * 4 + (gx - 1) * 2 + gy - 1, CAST(cls AS DOUBLE) FROM met WHERE gz BETWEEN 1 AND 2 AND gx BETWEEN 1 AND 2 AND gy BETWEEN 1 AND 2",
        "cls8",
        more=_TRIED,
    ),
)
def whole_batch_volumes(spark, d):
    """The second batch of 16 volumes: the first of eleven places with at most a tenth unlabelled, axes permuted and mirrored, graded."""
    plan = batches.Plan((4, 4, 4), (1, 1, 1), most_unlabelled=0.1, aniso=False, grey=(0,), seed="whole")
    return _batch_rows(_stream(spark, d, plan, 16, 96).batch(1))


_ORDERED = f"""{_DRAWS.replace('wholecube', 'planescube')},
pl AS (SELECT row_number() OVER (ORDER BY draw) - 1 AS slot, draw, cube_id, CAST(floor({U('planesorder', 'draw', '0')} * 3) AS BIGINT) AS o, CAST(floor({U('planesz', 'draw', '0')} * 8) AS BIGINT) AS oz, CAST(floor({U('planesx', 'draw', '0')} * 3) AS BIGINT) AS ox, CAST(floor({U('planesy', 'draw', '0')} * 3) AS BIGINT) AS oy FROM dr),
tu AS (SELECT *, {_TURNED('x', 5).replace('wholem', 'planesm')} AS tx, {_TURNED('y', 5).replace('wholem', 'planesm')} AS ty FROM pl, (SELECT unnest(range(5)) AS gx), (SELECT unnest(range(5)) AS gy) WHERE slot BETWEEN 32 AND 47),
sw AS (SELECT *, oz AS c0, ox + CASE WHEN {U('planesswap', 'draw')} < 0.5 THEN ty ELSE tx END AS c1, oy + CASE WHEN {U('planesswap', 'draw')} < 0.5 THEN tx ELSE ty END AS c2 FROM tu),
src AS (SELECT *, CASE o WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS z, CASE o WHEN 0 THEN c1 WHEN 1 THEN c2 ELSE c0 END AS x, CASE o WHEN 0 THEN c2 WHEN 1 THEN c0 ELSE c1 END AS y FROM sw),
met AS (SELECT s.slot, s.cube_id, gx, gy, v.value, v.cls FROM src s JOIN wc8 v ON v.cube_id = s.cube_id AND v.z = s.z AND v.x = s.x AND v.y = s.y)"""


@query(
    "whole_batch_planes",
    with_views(
        f"SELECT slot, cube_id, 0::BIGINT AS kind, gx * 5 + gy AS i, {R('value')} AS value FROM met UNION ALL SELECT slot, cube_id, 1::BIGINT, (gx - 1) // 2 * 2 + (gy - 1) // 2, CAST(cls AS DOUBLE) FROM met WHERE gx IN (1, 3) AND gy IN (1, 3)",
        "cls8",
        more=_ORDERED,
    ),
)
def whole_batch_planes(spark, d):
    """The third batch of 16 planes: cut across any axis at any depth, swapped and mirrored, with every second label of the inner part."""
    plan = batches.Plan((1, 5, 5), (0, 1, 1), (1, 2, 2), aniso=False, seed="planes")
    return _batch_rows(_stream(spark, d, plan, 16, 64).batch(2))
