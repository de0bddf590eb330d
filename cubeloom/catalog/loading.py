"""Composed loaders, networks and prediction over whole planes."""

from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_rounded as R
from ..functions.keyed import sql_uniform as U
from ..operators import inference, nets
from ..plans import trainer
from ..plans.network import NetworkConfig
from ..registry import query
from ..sources import loaders
from ..sources.tables import images, table, volumes, voxel_classes, with_views
from ..sources.views import sequences, sql_weights, weights

_BYTES = "CAST(floor(least(greatest(value + 0.5, 0.0), 1.0) * 255.0) AS BIGINT)"
_CUBES = f"cu AS (SELECT cube_id, z, x, y, {_BYTES} / 255.0 AS value, CASE WHEN z BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN cls ELSE 0 END AS cls FROM cls8)"


def _cubes(spark, d):
    v = volumes(spark, d)
    whole = v.withColumn("value", F.floor(F.least(F.greatest(F.col("value") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255.0))
    inner = voxel_classes(v).where("z between 1 and 6 and x between 1 and 6 and y between 1 and 6").select("cube_id", *((F.col(a) - 1).alias(a) for a in "zxy"), "cls")
    return loaders.read_cubes(whole, inner, 8, 6, 1)


@query("load_cubes", with_views(f"SELECT cube_id, z, x, y, {R('value')} AS value, cls FROM cu", "cls8", more=_CUBES))
def load_cubes(spark, d):
    return _cubes(spark, d).withColumn("value", r(F.col("value")))


@query("load_arrays", f"SELECT vec_id AS cube_id, p // 16 AS z, p // 4 % 4 AS x, p % 4 AS y, {R('embedding[p + 1]')} AS value, CASE WHEN label % 2 = 0 THEN 0 WHEN embedding[p + 1] > 0 THEN 1 ELSE 0 END::BIGINT AS cls FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS p)")
def load_arrays(spark, d):
    """Every vector as a volume of 4 x 4 x 4, with labels where its own label is odd and none elsewhere."""
    sign = F.when(F.col("label") % 2 == 1, F.transform("embedding", lambda v: (v > 0).cast("int")))
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("data"), sign.alias("classes"))
    return loaders.cubes_of_arrays(e, "vec_id", (4, 4, 4), "data", "classes").withColumn("value", r(F.col("value")))


_SET = f"{_CUBES}, cr AS (SELECT cube_id, z, x - 1 AS x, y - 1 AS y, value, cls FROM cu WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6), ms AS (SELECT avg(a) AS m, avg(b) AS s FROM (SELECT avg(value) AS a, stddev_pop(value) AS b FROM cr GROUP BY cube_id))"


@query("load_cube_set", with_views(f"SELECT cube_id, z, x, y, {R('(value - m) / s')} AS value, cls, CASE WHEN cube_id IN (2, 5) THEN 'valid' ELSE 'train' END AS split FROM cr CROSS JOIN ms", "cls8", more=_SET))
def load_cube_set(spark, d):
    whole, _, _ = loaders.cube_set(_cubes(spark, d), 8, 6, [2, 5])
    return whole.withColumn("value", r(F.col("value")))


@query("load_cube_priorities", with_views("SELECT cube_id, count(*) FILTER (WHERE cls >= 0) AS prio FROM cr WHERE cube_id NOT IN (2, 5) GROUP BY cube_id", "cls8", more=_SET))
def load_cube_priorities(spark, d):
    return loaders.cube_set(_cubes(spark, d), 8, 6, [2, 5])[2]


_DIGITS = f"""ce AS (SELECT vec_id, vec_id % 3 AS split, x - 1 AS x, y - 1 AS y, value - avg(value) OVER (PARTITION BY vec_id % 3) AS value FROM img8 QUALIFY img8.x BETWEEN 1 AND 6 AND img8.y BETWEEN 1 AND 6),
cp AS (SELECT k // 2 AS dx, k % 2 AS dy, row_number() OVER (ORDER BY {U('digits', 'k')}, k) - 1 AS copy FROM (SELECT unnest(range(4)) AS k))"""


@query("load_digits", with_views(f"SELECT split, copy, vec_id, x - dx AS x, y - dy AS y, {R('value')} AS value FROM ce CROSS JOIN cp WHERE split = 0 AND copy < 3 AND x - dx BETWEEN 0 AND 4 AND y - dy BETWEEN 0 AND 4 UNION ALL SELECT split, 0, vec_id, x, y, {R('value')} FROM ce WHERE split <> 0 AND x <= 4 AND y <= 4", "img8", more=_DIGITS))
def load_digits(spark, d):
    split = images(spark, d).select("vec_id", (F.col("vec_id") % 3).alias("split"), "x", "y", "value")
    return loaders.digit_set(split, 8, 1, 2, 3, "digits").withColumn("value", r(F.col("value")))


@query("digit_batch", with_views(f"SELECT k % 32 AS slot, vec_id, x * 8 + y AS i, value FROM img8 JOIN (SELECT vec_id, row_number() OVER (ORDER BY {U('dbatch', '3', 'vec_id')}, vec_id) - 1 AS k FROM embeddings) USING (vec_id) WHERE k // 32 = 2", "img8"))
def digit_batch(spark, d):
    return loaders.digit_batch(images(spark, d).drop("label"), "vec_id", 32, 3, 2, 8, "dbatch")


@query("save_by_split", f"SELECT o_orderkey, CASE WHEN {U('split', 'o_orderkey')} < 0.2 THEN 'valid' ELSE 'train' END AS split FROM orders")
def save_by_split(spark, d):
    return loaders.saved_by_split(loaders.keyed_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, "split"), "orders-by-split").select("o_orderkey", "split")


@query("load_table_folds", f"SELECT o_orderkey AS key, CAST(o_custkey AS DOUBLE) AS f0, CAST(month(o_orderdate) AS DOUBLE) AS f1, {R('log10(o_totalprice / max(o_totalprice) OVER () * 9999.0 + 1.0)')} AS label, CASE WHEN ntile(3) OVER (ORDER BY o_orderkey) = 3 THEN 'valid' ELSE 'train' END AS split FROM orders")
def load_table_folds(spark, d):
    orders = table(spark, d, "orders").withColumn("month", F.month("o_orderdate"))
    out = loaders.fold_set(orders, "o_orderkey", ["o_custkey", "month"], "o_totalprice", log_target=True)
    return out.select("key", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"), r(F.col("label")[0]).alias("label"), "split")


_U_SETS = U("tunes", "user_id")
_SETS = f"fr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, CASE WHEN {_U_SETS} < 0.2 THEN 'valid' WHEN {_U_SETS} < 0.2 + 0.1 THEN 'test' ELSE 'train' END AS split FROM events)"
_PLACES = lambda split: f"ln AS (SELECT user_id, count(*) AS n FROM fr WHERE split = '{split}' GROUP BY user_id HAVING count(*) > 20)"
_WINDOW = f"SELECT slot, user_id, t - s AS k, value FROM (SELECT slot, user_id, CAST(floor({U('tunebt', '1', '0', 'user_id')} * (n - 20 - 1) + 0.5) AS BIGINT) AS s FROM ch) JOIN fr USING (user_id) WHERE t BETWEEN s AND s + 20"


@query("load_sequences", f"WITH {_SETS} SELECT user_id, t, value, split FROM fr")
def load_sequences(spark, d):
    return loaders.sequence_set(sequences(spark, d), "user_id", 0.2, 0.1, "tunes")


@query("sequence_batch_train", f"WITH {_SETS}, {_PLACES('train')}, ch AS (SELECT user_id, n, row_number() OVER (ORDER BY {U('tuneb', '1', 'user_id')}, user_id) - 1 AS slot FROM ln QUALIFY slot < 8) {_WINDOW}")
def sequence_batch_train(spark, d):
    return loaders.sequence_batch(load_sequences(spark, d), "user_id", "train", 8, 20, 1, 0, "tuneb")


@query("sequence_batch_valid", f"WITH {_SETS}, {_PLACES('valid')}, ch AS (SELECT user_id, n, row_number() OVER (ORDER BY user_id) - 1 AS slot FROM ln QUALIFY slot < 4) {_WINDOW}")
def sequence_batch_valid(spark, d):
    return loaders.sequence_batch(load_sequences(spark, d), "user_id", "valid", 4, 20, 1, 0, "tuneb")


@query("priority_reset", "SELECT DISTINCT user_id, 0.0::DOUBLE AS prio, 1::BIGINT AS visits FROM events")
def priority_reset(spark, d):
    return loaders.reset_priorities(table(spark, d, "events"), "user_id")


@loaders.register_source("embedding-digits", (1, 8, 8), 10)
def digits(spark, path):
    return table(spark, path, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda v: r(v.cast("double"), 4)).alias("features"), F.col("label").cast("long").alias("label"))


@query("user_source", with_views("SELECT vec_id AS key, label, x * 8 + y AS i, value FROM img8", "img8"))
def user_source(spark, d):
    return loaders.source("embedding-digits", spark, d).select("key", "label", F.posexplode("features").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


_MIRROR = lambda t: f"CASE WHEN {t} < 0 THEN -({t}) - 1 WHEN {t} > 7 THEN 15 - ({t}) ELSE {t} END"
_PADDED = f"""{sql_weights('pw', 'plane', {'kx': 3, 'ky': 3}, 0.5)},
po AS (SELECT g.x, g.y, kx, ky, w, {_MIRROR('g.x + 1 - kx')} AS sx, {_MIRROR('g.y + 1 - ky')} AS sy FROM (SELECT a.x, b.x AS y FROM (SELECT unnest(range(8)) AS x) a CROSS JOIN (SELECT unnest(range(8)) AS x) b) g CROSS JOIN pw)"""


@query("predict_dense_padded", with_views(f"SELECT i.vec_id, po.x, po.y, CAST(floor({R('0.5 + 0.5 * tanh(sum(i.value * w))')} * 255.0) AS BIGINT) AS p FROM po JOIN img8 i ON i.x = po.sx AND i.y = po.sy GROUP BY i.vec_id, po.x, po.y", "img8", more=_PADDED))
def predict_dense_padded(spark, d):
    w = weights(spark, "plane", {"kx": 3, "ky": 3}, 0.5).withColumns({"f": F.lit(0).cast("long"), "ch": F.lit(0).cast("long")})
    b = spark.range(1).select(F.col("id").alias("f"), F.lit(0.0).alias("b"))
    z = inference.dense(images(spark, d).drop("label"), "vec_id", 8, 3, w, b, tile=3, mirrored=True)
    return z.select("vec_id", "x", "y", F.floor(r(0.5 + 0.5 * F.tanh("z")) * 255.0).cast("long").alias("p"))


_NET = NetworkConfig(mode="img-scalar", n_lab=10, filters=[3], pool=[2], n_filters=[4], mlp=[16], dropout=[0.0, 0.1])


@query("gradient_conv_pool")
def gradient_conv_pool(spark, d):
    """The gradient of a network with a convolution, a pool and a hidden layer, by weight."""
    net = trainer.built(_NET)
    _, g, _ = nets.gradient(digits(spark, d), net, net.initial(1))
    return spark.createDataFrame([(k, round(v, 9)) for k, v in enumerate(g.tolist())], "k long, g double")


@query("train_conv_epochs")
def train_conv_epochs(spark, d):
    """The log of a training run of that network with evaluation, falling rates and dropout."""
    e = digits(spark, d)
    run = trainer.Trainer(trainer.built(_NET), e.where("key % 5 <> 0"), e.where("key % 5 = 0"), n_batches=2, rate=0.2, decay=0.9, decay_every=2)
    return run.run(6, evaluate_every=3).select("step", *(F.round(c, 9).alias(c) for c in ("loss", "rate", "valid_loss", "valid_error")))
