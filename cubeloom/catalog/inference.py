"""Dense prediction and graphs."""

from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_rounded as R
from ..functions.keyed import sql_uniform as U
from ..functions.keyed import uniform
from ..operators import graph, inference, layers
from ..registry import query
from ..sources.tables import images, volumes, voxel_segments, with_views
from ..sources.views import sql_weights, weights
from .layers import CONV2, conv2
from .losses import _EDGES

_DENSE = f"SELECT a.vec_id, a.f, a.x, a.y, {R('tanh(max(b.z))')} AS h FROM c2 a JOIN c2 b ON a.vec_id = b.vec_id AND a.f = b.f AND b.x BETWEEN a.x AND a.x + 1 AND b.y BETWEEN a.y AND a.y + 1 WHERE a.x < 4 AND a.y < 4 GROUP BY a.vec_id, a.f, a.x, a.y"


def _activated(df):
    return df.select("vec_id", "f", "x", "y", r(layers.activation(F.col("z"), "tanh")).alias("h"))


@query("predict_dense_strided", with_views(_DENSE, "img8", more=CONV2))
def predict_dense_strided(spark, d):
    return _activated(inference.strided(conv2(spark, d), ["vec_id", "f"], 2, 6, "z"))


@query("predict_dense_mfp", with_views(_DENSE, "img8", more=CONV2))
def predict_dense_mfp(spark, d):
    return _activated(inference.fragmented(conv2(spark, d), ["vec_id", "f"], 2, 6, "z"))


# A cube's slices side by side: a plane of 64 x 8.
_PLANE = f"{sql_weights('pw', 'plane', {'kx': 3, 'ky': 3}, 0.5)}, pc AS (SELECT cube_id, z * 8 + v.x - 2 + kx AS x, y - 2 + ky AS y, sum(value * w) AS v FROM vol8 v CROSS JOIN pw WHERE z * 8 + v.x - 2 + kx BETWEEN 0 AND 61 AND y - 2 + ky BETWEEN 0 AND 5 GROUP BY ALL)"


@query("predict_dense_tiled", with_views(f"SELECT cube_id, x, y, {R('tanh(v)')} AS h FROM pc", "vol8", more=_PLANE))
def predict_dense_tiled(spark, d):
    plane = volumes(spark, d).select("cube_id", (F.col("z") * 8 + F.col("x")).alias("x"), "y", "value", F.lit(0).cast("long").alias("ch"))
    w = weights(spark, "plane", {"kx": 3, "ky": 3}, 0.5).withColumns({"f": F.lit(0).cast("long"), "ch": F.lit(0).cast("long")})
    b = spark.range(1).select(F.col("id").alias("f"), F.lit(0.0).alias("b"))
    tiles = inference.tiled(plane, "x", 16, 2, 4)
    out = layers.conv(tiles, w, b, ["cube_id", "tile"], {"x": 18, "y": 8}, {"x": 3, "y": 3})
    stitched = inference.untiled(out, "x", 16, 62)
    return stitched.select("cube_id", "x", "y", r(layers.activation(F.col("z"), "tanh")).alias("h"))


@query("preview_center_slices", with_views("SELECT cube_id, z - 3 AS z, x, y, value FROM vol8 WHERE z BETWEEN 3 AND 4", "vol8"))
def preview_center_slices(spark, d):
    return inference.centre_slices(volumes(spark, d), 8, 2)


@query("affinity_graph", with_views("SELECT cube_id, head AS dir, z, x, y, y1 AS connected FROM edge", "seg8", more=_EDGES))
def affinity_graph(spark, d):
    return graph.affinity_edges(voxel_segments(volumes(spark, d)), "cube_id", ("z", "x", "y")).select("cube_id", "dir", "z", "x", "y", "connected")


_COMP = "n AS (SELECT cube_id, z * 64 + x * 8 + y AS node FROM seg8 WHERE seg > 0), e AS (SELECT cube_id, z * 64 + x * 8 + y AS a, (z + CASE head WHEN 0 THEN 1 ELSE 0 END) * 64 + (x + CASE head WHEN 1 THEN 1 ELSE 0 END) * 8 + y + CASE head WHEN 2 THEN 1 ELSE 0 END AS b FROM edge WHERE y1 = 1 AND cube_id < 6), be AS (SELECT * FROM e UNION ALL SELECT cube_id, b, a FROM e), w AS (SELECT cube_id, node AS root, node FROM n WHERE cube_id < 6 UNION SELECT w.cube_id, w.root, be.b FROM w JOIN be ON be.cube_id = w.cube_id AND be.a = w.node), c AS (SELECT cube_id, node, min(root) AS comp FROM w GROUP BY cube_id, node)"


def _nodes(spark, d):
    seg = voxel_segments(volumes(spark, d))
    place = F.col("z") * 64 + F.col("x") * 8 + F.col("y")
    nodes = seg.where("seg > 0").select("cube_id", place.alias("node"))
    step = F.when(F.col("dir") == 0, 64).when(F.col("dir") == 1, 8).otherwise(1)
    edges = graph.affinity_edges(seg, "cube_id", ("z", "x", "y"))
    return edges.select("cube_id", place.alias("a"), (place + step).alias("b"), "connected"), nodes, seg.select("cube_id", place.alias("node"), "seg")


_COMP_SQL = with_views("SELECT cube_id, node, CASE WHEN count(*) OVER (PARTITION BY cube_id, comp) >= 3 THEN comp ELSE -1 END AS comp FROM c", "seg8", more=f"{_EDGES}, {_COMP}").replace("WITH ", "WITH RECURSIVE ", 1).replace(" AND cube_id < 6", "").replace(" WHERE cube_id < 6 UNION", " UNION")


@query("connected_components", _COMP_SQL)
def connected_components(spark, d):
    edges, nodes, _ = _nodes(spark, d)
    return graph.components(edges.where("connected = 1").select("cube_id", "a", "b"), nodes, "cube_id", least=3)


@query("loss_malis_stats")
def loss_malis_stats(spark, d):
    edges, _, seg = _nodes(spark, d)
    p = 0.05 + 0.45 * F.col("connected") + 0.45 * uniform("malis", F.col("cube_id"), F.col("a"), F.col("b"))
    side = lambda n, s: seg.select("cube_id", F.col("node").alias(n), F.col("seg").alias(s))
    met = edges.withColumn("p", p).join(side("a", "sa"), ["cube_id", "a"]).join(side("b", "sb"), ["cube_id", "b"])
    return graph.maximin_counts(met.select("cube_id", "a", "b", "p", "sa", "sb"), "cube_id").withColumn("nll", r(F.col("nll"), 4))


def _plane_edges(spark, d):
    """The pixel graphs of segmented images, with predicted affinities: vec_id, a, b, p, sa, sb."""
    seg = voxel_segments(images(spark, d)).select("vec_id", (F.col("x") * 8 + F.col("y")).alias("a"), F.col("seg").alias("sa"))
    step = seg.withColumn("b", F.explode(F.when(F.col("a") % 8 < 7, F.array(F.col("a") + 8, F.col("a") + 1)).otherwise(F.array(F.col("a") + 8))))
    met = step.join(seg.select("vec_id", F.col("a").alias("b"), F.col("sa").alias("sb")), ["vec_id", "b"])
    inside = ((F.col("sa") == F.col("sb")) & (F.col("sa") > 0)).cast("double")
    p = 0.05 + 0.45 * inside + 0.45 * uniform("malis2", F.col("vec_id"), F.col("a"), F.col("b"))
    return met.select("vec_id", "a", "b", p.alias("p"), "sa", "sb")


_PLANE_NODES = "SELECT vec_id, x * 8 + y AS node, CAST(CASE WHEN value <= 0 THEN 0 ELSE 1 + (x // 4) * 2 + y // 4 END AS BIGINT) AS seg FROM img8"
_PLANE_NEAR = "(m.node = n.node + 8 OR (m.node = n.node + 1 AND n.node % 8 < 7))"


def malis_sql(body: str, strength: str, nodes: str = _PLANE_NODES, near: str = _PLANE_NEAR, view: str = "img8") -> str:
    """body over mm (vec_id, a, b, p, pos, neg): edges are added one at a time to lists of component * 5 + segment."""
    side = lambda c, s: f"len(list_filter(l, lambda v: v = {c} * 5 + {s}))"
    total = lambda c: " + ".join(side(c, s) for s in (1, 2, 3, 4))
    same = " + ".join(f"{side('ca', s)} * {side('cb', s)}" for s in (1, 2, 3, 4))

    def rounds(name: str, order: str, count: str) -> str:
        return f"""{name} AS (SELECT vec_id, 0::BIGINT AS r, l, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS n FROM starts UNION ALL
SELECT vec_id, r, CASE WHEN ca = cb THEN l ELSE list_transform(l, lambda v: CASE WHEN v // 5 = cb THEN ca * 5 + v % 5 ELSE v END) END, a, b, CASE WHEN ca = cb THEN 0 ELSE {count} END
FROM (SELECT e.vec_id, e.r, e.a, e.b, t.l, t.l[e.a + 1] // 5 AS ca, t.l[e.b + 1] // 5 AS cb FROM {name} t JOIN {order} e ON e.vec_id = t.vec_id AND e.r = t.r + 1))"""

    more = f"""nd AS MATERIALIZED ({nodes}),
ed AS MATERIALIZED (SELECT vec_id, a, b, sa, sb, 0.05::DOUBLE + 0.45::DOUBLE * CAST(sa = sb AND sa > 0 AS DOUBLE) + 0.45::DOUBLE * {U('malis2', 'vec_id', 'a', 'b')} AS p FROM (SELECT n.vec_id, n.node AS a, m.node AS b, n.seg AS sa, m.seg AS sb FROM nd n JOIN nd m ON n.vec_id = m.vec_id AND {near})),
inner_order AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, a, b) AS r FROM ed WHERE sa = sb AND sa > 0),
outer_order AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY {strength} DESC, a, b) AS r FROM ed),
starts AS MATERIALIZED (SELECT vec_id, list(node * 5 + seg ORDER BY node) AS l FROM nd GROUP BY vec_id),
{rounds('inside', 'inner_order', same)},
{rounds('across', 'outer_order', f'({total("ca")}) * ({total("cb")}) - ({same})')},
mm AS (SELECT e.vec_id, e.a, e.b, e.p, coalesce(i.n, 0) AS pos, o.n AS neg FROM ed e JOIN (SELECT * FROM across WHERE r > 0) o USING (vec_id, a, b) LEFT JOIN (SELECT * FROM inside WHERE r > 0) i USING (vec_id, a, b))"""
    return with_views(body, view, more=more).replace("WITH ", "WITH RECURSIVE ", 1)


@query("malis_edge_counts", malis_sql(f"SELECT vec_id, a, b, {R('p')} AS p, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, {R('ln(neg + 1)')} AS log_neg FROM mm", "p"))
def malis_edge_counts(spark, d):
    counts = graph.maximin_edges(_plane_edges(spark, d), "vec_id")
    return counts.withColumns({"p": r(F.col("p")), "log_neg": r(F.ln(F.col("neg") + 1))})


_MALIS = f"""SELECT vec_id, {R('(sum(CASE WHEN pos > 0 THEN -pos * ln(p) ELSE 0 END) + sum(CASE WHEN neg > 0 THEN -neg * ln(1 - p) ELSE 0 END)) / (sum(pos) + sum(neg) + 1e-6)')} AS nll,
CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CAST(sum(pos) + sum(neg) AS BIGINT) AS n_tot,
CAST(sum(CASE WHEN p < 0.5 THEN pos ELSE 0 END) AS BIGINT) AS false_splits, CAST(sum(CASE WHEN p > 0.5 THEN neg ELSE 0 END) AS BIGINT) AS false_merges,
{R('sum(CASE WHEN p < 0.5 THEN pos ELSE 0 END + CASE WHEN p > 0.5 THEN neg ELSE 0 END) / (sum(pos) + sum(neg) + 1e-6)')} AS rand_index FROM mm GROUP BY vec_id"""


def _malis(spark, d, restricted):
    out = graph.maximin_loss(graph.maximin_edges(_plane_edges(spark, d), "vec_id", restricted), "vec_id")
    return out.withColumns({"nll": r(F.col("nll")), "rand_index": r(F.col("rand_index"))})


@query("loss_malis", malis_sql(_MALIS, "p"))
def loss_malis(spark, d):
    return _malis(spark, d, False)


@query("loss_malis_restricted", malis_sql(_MALIS, "CASE WHEN sa = sb AND sa > 0 THEN 1.0::DOUBLE ELSE p END"))
def loss_malis_restricted(spark, d):
    return _malis(spark, d, True)
