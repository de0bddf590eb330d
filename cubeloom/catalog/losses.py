"""Losses and error rates."""

from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_rounded as R
from ..functions.keyed import sql_uniform as U
from ..functions.keyed import uniform
from ..operators import losses
from ..operators.graph import affinity_edges
from ..registry import query
from ..sources.tables import images, table, task_parts, voxel_segments, volumes, with_views
from ..sources.views import cube_info, features
from .layers import AFFINITY, MLP, affinity, affinity_rows, probabilities

# y: the label, or -1 for every fifth image (unlabelled)
_Y = "t AS (SELECT *, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS y FROM p2)"
_E = "1e-6::DOUBLE"


def _nll(body: str, more: str = "") -> str:
    return with_views(body, "img8", more=f"{MLP}, {_Y}{more}")


def _targets(spark, d):
    return probabilities(spark, d).withColumn("y", F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label")))


def _out(df, digits=4):
    return df.select(*(r(F.col(c), digits).alias(c) for c in df.columns))


@query("loss_nll", _nll(f"SELECT {R(f'sum(CASE WHEN y = c THEN -ln(p + {_E}) END) / greatest(count(*) FILTER (WHERE y = c), 1)', 4)} AS nll FROM t"))
def loss_nll(spark, d):
    return _out(losses.nll(_targets(spark, d)))


@query("loss_nll_class_weighted", _nll(f"SELECT {R(f'sum(CASE WHEN y = c THEN -ln(p + {_E}) * (0.5 + c / 10.0) END) / greatest(count(*) FILTER (WHERE y = c), 1)', 4)} AS nll FROM t"))
def loss_nll_class_weighted(spark, d):
    return _out(losses.nll(_targets(spark, d), 0.5 + F.col("c") / 10.0))


@query("loss_label_propagation", _nll(f"SELECT {R(f'sum(CASE WHEN y = c OR (y < 0 AND p > 0.12) THEN -ln(p + {_E}) END) / greatest(count(*) FILTER (WHERE y = c OR (y < 0 AND p > 0.12)), 1)', 4)} AS nll FROM t"))
def loss_label_propagation(spark, d):
    return _out(losses.propagated_nll(_targets(spark, d), 0.12))


_INFO = f", info AS (SELECT cube_id, cls, CAST({U('lab', 'cube_id', 'cls')} < 0.8 AS BIGINT) AS labeled, CAST({U('np', 'cube_id', 'cls')} < 0.1 AS BIGINT) AS not_present FROM (SELECT DISTINCT vec_id // 8 AS cube_id FROM embeddings) CROSS JOIN (SELECT unnest(range(2)) AS cls))"


@query(
    "loss_lazy_labels",
    _nll(
        f"SELECT {R(f'sum(CASE WHEN y = c THEN -ln(p + {_E}) * labeled * w ELSE 0 END - ln(1.0 - p * not_present * w + {_E})) / greatest(sum(CASE WHEN y = c THEN labeled ELSE 0 END) + sum(not_present), 1)', 4)} AS nll FROM (SELECT t.*, labeled, not_present, CASE WHEN c = 0 THEN 1.0 ELSE 0.8 END AS w FROM t JOIN info ON t.vec_id // 8 = info.cube_id AND t.c % 2 = info.cls)",
        _INFO,
    ),
)
def loss_lazy_labels(spark, d):
    t = _targets(spark, d).withColumn("cube_id", F.expr("vec_id div 8")).withColumn("cls", F.col("c") % 2)
    met = t.join(cube_info(spark, d), ["cube_id", "cls"]).withColumn("w", F.when(F.col("c") == 0, 1.0).otherwise(0.8))
    return _out(losses.lazy_nll(met))


@query("loss_example_weighted", _nll(f"SELECT {R(f'sum(CASE WHEN y = c THEN -ln(p + {_E}) * (1.0 + vec_id % 3) END) / greatest(count(*) FILTER (WHERE y = c), 1)', 4)} AS nll FROM t"))
def loss_example_weighted(spark, d):
    return _out(losses.nll(_targets(spark, d), 1.0 + F.col("vec_id") % 3))


@query("loss_nll_weak", _nll(f"SELECT {R(f'sum(CASE WHEN y >= 0 THEN -ln(p + {_E}) * (0.5 * CASE WHEN y = c THEN 1.0 ELSE 0.0 END + 0.5 * p) END) / greatest(count(*) FILTER (WHERE y = c), 1)', 4)} AS nll FROM t"))
def loss_nll_weak(spark, d):
    return _out(losses.weak_nll(_targets(spark, d)))


_BIN = f"SELECT head, a, y FROM (SELECT doc_id, 4.0 * ({U('act', 'doc_id', 'head')} - 0.5) AS a, head, CASE head WHEN 0 THEN quality ELSE toxic END AS y FROM labels CROSS JOIN (SELECT unnest(range(2)) AS head))"


def _heads(spark, d):
    both = table(spark, d, "labels").crossJoin(spark.range(2).withColumnRenamed("id", "head"))
    return both.select("doc_id", "head", F.when(F.col("head") == 0, F.col("quality")).otherwise(F.col("toxic")).alias("y"), (4.0 * (uniform("act", F.col("doc_id"), F.col("head")) - 0.5)).alias("a"))


@query("loss_multi_binary", f"SELECT {R(f'avg(-ln(1.0 / (1.0 + exp(-a)) + {_E}) * (1.0 - y) - ln(1.0 - 1.0 / (1.0 + exp(-a)) + {_E}) * y * 2.0)', 4)} AS nll FROM ({_BIN})")
def loss_multi_binary(spark, d):
    return _out(_heads(spark, d).agg(losses.binary_nll(F.col("a"), F.col("y"), 1.0, 2.0).alias("nll")))


@query("loss_mse", with_views(f"SELECT {R('avg(power(o.value - t.value, 2))')} AS mse FROM img8 o JOIN img8 t ON t.vec_id = o.vec_id + 1 AND t.x = o.x AND t.y = o.y", "img8"))
def loss_mse(spark, d):
    x = features(spark, d)
    nxt = x.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("value").alias("target"))
    return _out(x.join(nxt, ["vec_id", "i"]).agg(losses.squared(F.col("value"), F.col("target")).alias("mse")), 6)


@query("loss_mse_masked", with_views(f"SELECT {R('avg(power((value - 0.1) * CASE WHEN x > 1 THEN 1.0 ELSE 0.0 END, 2))')} AS mse FROM img8", "img8"))
def loss_mse_masked(spark, d):
    mask = F.when(F.col("i") >= 16, 1.0).otherwise(0.0)
    return _out(features(spark, d).agg(losses.squared(F.col("value"), F.lit(0.1), mask).alias("mse")), 6)


_EDGES = "edge AS (SELECT a.cube_id, 0 AS head, a.z, a.x, a.y, CAST(a.seg = b.seg AND a.seg > 0 AS BIGINT) AS y1 FROM seg8 a JOIN seg8 b ON a.cube_id = b.cube_id AND a.z + 1 = b.z AND a.x = b.x AND a.y = b.y UNION ALL SELECT a.cube_id, 1, a.z, a.x, a.y, CAST(a.seg = b.seg AND a.seg > 0 AS BIGINT) FROM seg8 a JOIN seg8 b ON a.cube_id = b.cube_id AND a.z = b.z AND a.x + 1 = b.x AND a.y = b.y UNION ALL SELECT a.cube_id, 2, a.z, a.x, a.y, CAST(a.seg = b.seg AND a.seg > 0 AS BIGINT) FROM seg8 a JOIN seg8 b ON a.cube_id = b.cube_id AND a.z = b.z AND a.x = b.x AND a.y + 1 = b.y)"


def _affinity_targets(spark, d):
    edges = affinity_edges(voxel_segments(volumes(spark, d)), "cube_id", ("z", "x", "y")).select("cube_id", F.col("dir").alias("head"), F.col("z").alias("d"), "x", "y", F.col("connected").alias("y1"))
    keys = ["cube_id", "head", "d", "x", "y"]
    n = task_parts(spark, affinity_rows(spark, d))
    return affinity(spark, d).repartition(n, *keys).join(edges.withColumnRenamed("y1", "target").repartition(n, *keys), keys)


@query("loss_affinity", with_views(f"SELECT {R('avg(nll)', 4)} AS nll FROM (SELECT ap.head, sum(CASE WHEN c = y1 THEN -ln(p + {_E}) END) / count(*) FILTER (WHERE c = y1) AS nll FROM ap JOIN edge USING (cube_id, head, z, x, y) GROUP BY ap.head)", "seg8", more=f"{AFFINITY}, {_EDGES}"))
def loss_affinity(spark, d):
    t = _affinity_targets(spark, d).drop("y").withColumnRenamed("target", "y")
    return _out(losses.nll(t, by=["head"]).agg(F.avg("nll").alias("nll")))


_CE = f"ce AS (SELECT vec_id, i, 1.0 / (1.0 + exp(-4.0 * value)) AS p, CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END AS t, exp(-power(abs(x - 4), 3) / 20.0) AS w FROM (SELECT vec_id, x, x * 8 + y AS i, value FROM img8))"


def _ce(spark, d):
    x = features(spark, d)
    far = F.abs(F.expr("i div 8") - 4).cast("double")
    return x.select("vec_id", (1.0 / (1.0 + F.exp(-4.0 * F.col("value")))).alias("p"), F.when(F.col("value") > 0, 1.0).otherwise(0.0).alias("t"), F.exp(-F.pow(far, F.lit(3.0)) / 20.0).alias("w"))


@query("loss_cross_entropy", with_views(f"SELECT {R('-avg((ln(p) * t + ln(1.0 - p) * (1.0 - t)) * w)', 4)} AS ce FROM ce", "img8", more=_CE))
def loss_cross_entropy(spark, d):
    return _out(_ce(spark, d).agg(losses.cross_entropy(F.col("p"), F.col("t"), F.col("w")).alias("ce")))


@query("loss_cross_entropy_by_row", with_views(f"SELECT vec_id, {R('-avg(ln(p) * t + ln(1.0 - p) * (1.0 - t))', 4)} AS ce FROM ce GROUP BY vec_id", "img8", more=_CE))
def loss_cross_entropy_by_row(spark, d):
    return _ce(spark, d).groupBy("vec_id").agg(r(losses.cross_entropy(F.col("p"), F.col("t")), 4).alias("ce"))


@query("loss_instances", _nll(f"SELECT vec_id, {R(f'-ln(p + {_E})', 4)} AS nll FROM t WHERE y = c"))
def loss_instances(spark, d):
    return _targets(spark, d).where(losses.hit()).select("vec_id", r(-F.log(F.col("p") + losses.EPS), 4).alias("nll"))


@query("example_weights", with_views(f"SELECT vec_id, x, y, {R('1.0 + CASE WHEN dd < -0.1 THEN 2.0 * (-dd - 0.1) ELSE 0.0 END + CASE WHEN dd > 0.05 THEN 2.0 * (dd - 0.05) ELSE 0.0 END')} AS w FROM (SELECT vec_id, x, y, CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END - (value + 0.5) AS dd FROM img8)", "img8"))
def example_weights(spark, d):
    label = F.when(F.col("value") > 0, 1.0).otherwise(0.0)
    return images(spark, d).select("vec_id", "x", "y", r(losses.example_weights(label, F.col("value") + 0.5)).alias("w"))


_PRED = ", pred AS (SELECT vec_id, any_value(y) AS y, any_value(label) AS label, arg_max(c, ROW(round(p, 9), -c)) AS pred FROM t GROUP BY vec_id)"


def _pred(spark, d):
    best = F.max_by("c", F.struct(F.round("p", 9), -F.col("c")))
    return _targets(spark, d).groupBy("vec_id").agg(F.first("y").alias("y"), F.first("label").alias("label"), best.alias("pred"))


@query("metric_error_rate", _nll(f"SELECT {R('avg(CASE WHEN pred <> label THEN 1.0 ELSE 0.0 END)')} AS error FROM pred", _PRED))
def metric_error_rate(spark, d):
    return _out(_pred(spark, d).agg(losses.error_rate("pred", "label").alias("error")), 6)


@query("metric_error_rate_masked", _nll(f"SELECT {R('avg(CASE WHEN pred <> y THEN 1.0 ELSE 0.0 END) FILTER (WHERE y >= 0)')} AS error FROM pred", _PRED))
def metric_error_rate_masked(spark, d):
    return _out(_pred(spark, d).agg(losses.error_rate(labelled_only=True).alias("error")), 6)


@query("metric_affinity_error", with_views(f"SELECT {R('avg(e)', 6)} AS error FROM (SELECT head, avg(CASE WHEN pred <> y1 THEN 1.0 ELSE 0.0 END) AS e FROM (SELECT cube_id, head, z, x, y, any_value(y1) AS y1, arg_max(c, ROW(round(p, 9), -c)) AS pred FROM ap JOIN edge USING (cube_id, head, z, x, y) GROUP BY cube_id, head, z, x, y) GROUP BY head)", "seg8", more=f"{AFFINITY}, {_EDGES}"))
def metric_affinity_error(spark, d):
    t = _affinity_targets(spark, d)
    best = F.max_by("c", F.struct(F.round("p", 9), -F.col("c")))
    pred = t.groupBy("cube_id", "head", "d", "x", "y").agg(F.first("target").alias("target"), best.alias("pred"))
    return _out(pred.groupBy("head").agg(losses.error_rate("pred", "target").alias("e")).agg(F.avg("e").alias("error")), 6)


@query("metric_jaccard", f"SELECT {R('sum(CASE WHEN a < 0 AND y = 1 THEN 1 ELSE 0 END) * 1.0 / sum(CASE WHEN a < 0 OR y = 1 THEN 1 ELSE 0 END)')} AS jaccard FROM ({_BIN})")
def metric_jaccard(spark, d):
    return _out(_heads(spark, d).agg(losses.jaccard(F.col("a") < 0, F.col("y") == 1).alias("jaccard")), 6)


@query("metric_rmse", with_views(f"SELECT {R('sqrt(avg(power(value - 0.1, 2)))')} AS rmse FROM img8", "img8"))
def metric_rmse(spark, d):
    return _out(features(spark, d).agg(F.sqrt(losses.squared(F.col("value"), F.lit(0.1))).alias("rmse")), 6)


@query("evaluate_chunked", _nll(f"SELECT {R('sum(l * n) / sum(n)', 4)} AS nll FROM (SELECT avg(-ln(p + {_E})) AS l, count(*) AS n FROM t WHERE label = c GROUP BY vec_id // 64)".replace("{_E}", _E)))
def evaluate_chunked(spark, d):
    own = probabilities(spark, d).where("label = c").groupBy(F.expr("vec_id div 64").alias("chunk")).agg(F.avg(-F.log(F.col("p") + losses.EPS)).alias("l"), F.count("*").alias("n"))
    return _out(own.agg((F.sum(F.col("l") * F.col("n")) / F.sum("n")).alias("nll")))


@query("label_onehot", "SELECT vec_id, c, CAST(c = label AS BIGINT) AS hot FROM embeddings CROSS JOIN (SELECT unnest(range(10)) AS c)")
def label_onehot(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("c"))
    return e.select("vec_id", "c", (F.col("c") == F.col("label")).cast("long").alias("hot"))
