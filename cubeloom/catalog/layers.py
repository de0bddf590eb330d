"""Forward passes of layers."""

from pyspark.sql import functions as F

from ..functions.keyed import normal
from ..functions.keyed import rounded as r
from ..functions.keyed import sql_normal as N
from ..functions.keyed import sql_rounded as R
from ..operators import kernels, layers
from ..registry import query
from ..sources.tables import images, table, task_parts, volumes, with_views
from ..sources.views import FEATURES, biases, features, sequences, sql_biases, sql_weights, weights

_W1, _B1 = sql_weights("w1", "mlp1", {"i": 64, "o": 16}, 0.1581), sql_biases("b1", "mlp1b", "o", 16)
_W2, _B2 = sql_weights("w2", "mlp2", {"i": 16, "o": 10}, 0.2774), sql_biases("b2", "mlp2b", "o", 10)
_H1 = "h1 AS (SELECT vec_id, label, o, tanh(sum(value * w) + any_value(b)) AS h, sum(value * w) + any_value(b) AS z FROM feat JOIN w1 USING (i) JOIN b1 USING (o) GROUP BY vec_id, label, o)"
_Z2 = "z2 AS (SELECT h1.vec_id, h1.label, w2.o, sum(h * w) + any_value(b) AS z FROM h1 JOIN w2 ON h1.o = w2.i JOIN b2 ON b2.o = w2.o GROUP BY h1.vec_id, h1.label, w2.o)"
_P2 = "p2 AS (SELECT vec_id, label, o AS c, exp(z - max(z) OVER (PARTITION BY vec_id)) / sum(exp(z)) OVER (PARTITION BY vec_id) * exp(max(z) OVER (PARTITION BY vec_id)) AS p FROM z2)"
MLP = ", ".join((FEATURES, _W1, _B1, _W2, _B2, _H1, _Z2, _P2))


def hidden(spark, d):
    return layers.dense(features(spark, d), weights(spark, "mlp1", {"i": 64, "o": 16}, 0.1581), biases(spark, "mlp1b", "o", 16), ["vec_id", "label"], "tanh")


def probabilities(spark, d):
    """vec_id, label, c, z, p of the two-layer network."""
    z = layers.dense(layers.as_input(hidden(spark, d), ["vec_id", "label"]), weights(spark, "mlp2", {"i": 16, "o": 10}, 0.2774), biases(spark, "mlp2b", "o", 10), ["vec_id", "label"])
    return layers.softmax(z.withColumnRenamed("o", "c"), ["vec_id"]).select("vec_id", "label", "c", "z", "p")


@query("forward_dense", with_views(f"SELECT vec_id, o, {R('z', 8)} AS z, {R('h')} AS h FROM h1", "img8", more=", ".join((FEATURES, _W1, _B1, _H1))))
def forward_dense(spark, d):
    return hidden(spark, d).select("vec_id", "o", r(F.col("z"), 8).alias("z"), r(F.col("h")).alias("h"))


@query("activations", with_views(f"SELECT vec_id, i, {R('tanh(value)')} AS tanh, {R('greatest(value, 0.0)')} AS relu, {R('abs(value)')} AS abs, {R('1.0 / (1.0 + exp(-value))')} AS sigmoid, {R('value')} AS linear FROM feat", "img8", more=FEATURES))
def activations(spark, d):
    return features(spark, d).select("vec_id", "i", *(r(layers.activation(F.col("value"), a)).alias(a) for a in ("tanh", "relu", "abs", "sigmoid", "linear")))


@query("maxout", with_views("SELECT vec_id, i // 4 AS ch, max(value) AS value FROM feat GROUP BY vec_id, i // 4", "img8", more=FEATURES))
def maxout(spark, d):
    return layers.maxout(features(spark, d).withColumnRenamed("i", "ch"), ["vec_id"], 4)


C2 = {"f": 3, "ch": 1, "kx": 3, "ky": 3}
CONV2 = f"{sql_weights('cw', 'conv2', C2, 0.5)}, {sql_biases('cb', 'conv2b', 'f', 3)}, c2 AS (SELECT vec_id, f, x - 2 + kx AS x, y - 2 + ky AS y, sum(value * w) + any_value(b) AS z FROM img8 CROSS JOIN cw JOIN cb USING (f) WHERE x - 2 + kx BETWEEN 0 AND 5 AND y - 2 + ky BETWEEN 0 AND 5 GROUP BY ALL)"


def conv2(spark, d):
    x = images(spark, d).withColumn("ch", F.lit(0).cast("long"))
    return layers.conv(x, weights(spark, "conv2", C2, 0.5), biases(spark, "conv2b", "f", 3), ["vec_id"], {"x": 8, "y": 8}, {"x": 3, "y": 3})


# A true convolution: output x adds value[x + 2 - k] * w[k].
@query("forward_conv2d", with_views(f"SELECT vec_id, f, x, y, {R('z', 8)} AS z FROM c2", "img8", more=CONV2))
def forward_conv2d(spark, d):
    return conv2(spark, d).withColumn("z", r(F.col("z"), 8))


C3 = {"f": 2, "ch": 1, "kz": 2, "kx": 3, "ky": 3}
CONV3 = f"{sql_weights('vw', 'conv3', C3, 0.4)}, {sql_biases('vb', 'conv3b', 'f', 2)}, c3 AS (SELECT cube_id, f, z - 1 + kz AS z, x - 2 + kx AS x, y - 2 + ky AS y, sum(value * w) + any_value(b) AS v FROM vol8 CROSS JOIN vw JOIN vb USING (f) WHERE z - 1 + kz BETWEEN 0 AND 6 AND x - 2 + kx BETWEEN 0 AND 5 AND y - 2 + ky BETWEEN 0 AND 5 GROUP BY ALL)"


def conv3(spark, d):
    """cube_id, f, z, x, y, v."""
    x = volumes(spark, d).withColumn("ch", F.lit(0).cast("long")).withColumnRenamed("z", "w0")
    x = x.withColumnRenamed("w0", "d")
    w = weights(spark, "conv3", C3, 0.4).withColumnRenamed("kz", "kd")
    out = layers.conv(x, w, biases(spark, "conv3b", "f", 2), ["cube_id"], {"d": 8, "x": 8, "y": 8}, {"d": 2, "x": 3, "y": 3})
    return out.withColumnRenamed("z", "v").withColumnRenamed("d", "z")


@query("forward_conv3d", with_views(f"SELECT cube_id, f, z, x, y, {R('v', 8)} AS v FROM c3", "vol8", more=CONV3))
def forward_conv3d(spark, d):
    return conv3(spark, d).withColumn("v", r(F.col("v"), 8))


@query("maxpool2d", with_views("SELECT vec_id, x // 2 AS x, y // 2 AS y, max(value) AS value FROM img8 GROUP BY ALL", "img8"))
def maxpool2d(spark, d):
    return layers.pooled(images(spark, d), ["vec_id"], {"x": 2, "y": 2}, "value")


@query("maxpool3d", with_views("SELECT cube_id, z // 2 AS z, x // 2 AS x, y // 2 AS y, max(value) AS value FROM vol8 GROUP BY ALL", "vol8"))
def maxpool3d(spark, d):
    return layers.pooled(volumes(spark, d), ["cube_id"], {"z": 2, "x": 2, "y": 2}, "value")


@query("maxabs_pool", with_views("SELECT vec_id, x // 2 AS x, y // 2 AS y, CASE WHEN max(value) >= -min(value) THEN max(value) ELSE min(value) END AS value FROM img8 GROUP BY ALL", "img8"))
def maxabs_pool(spark, d):
    return layers.pooled(images(spark, d), ["vec_id"], {"x": 2, "y": 2}, "value", signed=True)


FRAGMENTS = "fr AS (SELECT vec_id, ox, oy, (x - ox) // 2 AS x, (y - oy) // 2 AS y, max(value) AS value FROM img8 CROSS JOIN (SELECT unnest(range(2)) AS ox) CROSS JOIN (SELECT unnest(range(2)) AS oy) WHERE x >= ox AND y >= oy AND (x - ox) // 2 < 3 AND (y - oy) // 2 < 3 GROUP BY ALL)"


@query("fragment_pool", with_views("SELECT * FROM fr", "img8", more=FRAGMENTS))
def fragment_pool(spark, d):
    return layers.fragments(images(spark, d).drop("label"), ["vec_id"], {"x": 2, "y": 2}, {"x": 8, "y": 8})


@query("fragments_to_dense", with_views("SELECT vec_id, x * 2 + ox AS x, y * 2 + oy AS y, value FROM fr", "img8", more=FRAGMENTS))
def fragments_to_dense(spark, d):
    return layers.defragmented(fragment_pool(spark, d), {"x": 2, "y": 2}).select("vec_id", "x", "y", "value")


@query("softmax_probs", with_views(f"SELECT vec_id, c, {R('p', 4)} AS p FROM p2", "img8", more=MLP))
def softmax_probs(spark, d):
    return probabilities(spark, d).select("vec_id", "c", r(F.col("p"), 4).alias("p"))


@query("argmax_prediction", with_views("SELECT vec_id, arg_max(c, ROW(round(p, 9), -c)) AS pred FROM p2 GROUP BY vec_id", "img8", more=MLP))
def argmax_prediction(spark, d):
    return layers.argmax(probabilities(spark, d), ["vec_id"], "c")


_MLP_SQL = with_views(f"SELECT vec_id, any_value(label) AS label, arg_max(c, ROW(round(p, 9), -c)) AS pred, {R('max(p)', 4)} AS p FROM p2 GROUP BY vec_id", "img8", more=MLP)


@query("forward_mlp_softmax_arrow", _MLP_SQL)
def forward_mlp_softmax_arrow(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    par = lambda name, n_in, n_out, scale, act: (kernels.weights_array(weights(spark, name, {"i": n_in, "o": n_out}, scale), {"i": n_in, "o": n_out}), kernels.weights_array(biases(spark, f"{name}b", "o", n_out), {"o": n_out}, "b"), act)
    out = kernels.mlp_probabilities(e, "vec_id", "embedding", [par("mlp1", 64, 16, 0.1581, "tanh"), par("mlp2", 16, 10, 0.2774, "linear")])
    return out.withColumn("p", r(F.col("p"), 4))


@query("forward_mlp_softmax", _MLP_SQL)
def forward_mlp_softmax(spark, d):
    p = probabilities(spark, d)
    best = F.max_by("c", F.struct(F.round("p", 9), -F.col("c")))
    return p.groupBy("vec_id").agg(F.first("label").alias("label"), best.alias("pred"), r(F.max("p"), 4).alias("p"))


_CONV_POOL_SQL = with_views(f"SELECT vec_id, f, x // 2 AS x, y // 2 AS y, {R('tanh(max(z))')} AS h FROM c2 GROUP BY ALL", "img8", more=CONV2)


@query("forward_conv_pool_arrow", _CONV_POOL_SQL)
def forward_conv_pool_arrow(spark, d):
    w = kernels.weights_array(weights(spark, "conv2", C2, 0.5), C2)[:, 0]
    b = kernels.weights_array(biases(spark, "conv2b", "f", 3), {"f": 3}, "b")
    return kernels.conv_pool(table(spark, d, "embeddings"), "vec_id", "embedding", 8, w, b, 2, "tanh").withColumn("h", r(F.col("h")))


@query("forward_conv_pool", _CONV_POOL_SQL)
def forward_conv_pool(spark, d):
    p = layers.pooled(conv2(spark, d), ["vec_id", "f"], {"x": 2, "y": 2}, "z")
    return p.select("vec_id", "f", "x", "y", r(layers.activation(F.col("z"), "tanh")).alias("h"))


_RNN = {"w_in": [0.5, -0.3], "w_hid": [[0.2, 0.1], [-0.1, 0.3]], "bias": [0.01, -0.02], "start": [0.0, 0.0]}


_RNN_SQL = f"WITH RECURSIVE q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value / 100.0 AS v FROM events), h AS (SELECT user_id, CAST(-1 AS BIGINT) AS t, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT DISTINCT user_id FROM q) UNION ALL SELECT h.user_id, q.t, tanh(q.v * 0.5 + (a * 0.2 + b * -0.1) + 0.01), tanh(q.v * -0.3 + (a * 0.1 + b * 0.3) - 0.02) FROM h JOIN q ON q.user_id = h.user_id AND q.t = h.t + 1) SELECT user_id, {R('arg_max(a, t)', 4)} AS h0, {R('arg_max(b, t)', 4)} AS h1 FROM h GROUP BY user_id"


@query("forward_rnn", _RNN_SQL)
def forward_rnn(spark, d):
    h = layers.recurrent(sequences(spark, d).withColumn("value", F.col("value") / 100.0), "user_id", **_RNN)
    return h.select("user_id", r(F.col("h")[0], 4).alias("h0"), r(F.col("h")[1], 4).alias("h1"))


@query("forward_rnn_streamed", _RNN_SQL)
def forward_rnn_streamed(spark, d):
    """The same with a state that goes along sorted rows, whatever a sequence's length."""
    h = layers.recurrent_streamed(sequences(spark, d).withColumn("value", F.col("value") / 100.0), "user_id", [_RNN["w_in"]], _RNN["w_hid"], _RNN["bias"], _RNN["start"])
    return h.select("user_id", r(F.col("h")[0], 4).alias("h0"), r(F.col("h")[1], 4).alias("h1"))


@query("autoencoder_reconstruct", with_views(f"SELECT vec_id, w1.i, {R('sum(h * w)', 5)} AS value FROM h1 JOIN w1 USING (o) GROUP BY vec_id, w1.i", "img8", more=", ".join((FEATURES, _W1, _B1, _H1))))
def autoencoder_reconstruct(spark, d):
    w = weights(spark, "mlp1", {"i": 64, "o": 16}, 0.1581)
    tied = w.select(F.col("o").alias("i"), F.col("i").alias("o"), "w")
    zero = spark.range(64).select(F.col("id").alias("o"), F.lit(0.0).alias("b"))
    back = layers.dense(layers.as_input(hidden(spark, d), ["vec_id"]), tied, zero, ["vec_id"])
    return back.select("vec_id", F.col("o").alias("i"), r(F.col("z"), 5).alias("value"))


#: Weights of the 64 inputs, by their place among three.
_REPEATED = {"w_in": [([0.5, -0.3], [0.4, 0.2], [-0.6, 0.1])[i % 3] for i in range(64)], "w_hid": [[0.2, 0.1], [-0.1, 0.3]], "bias": [0.01, -0.02], "start": [0.1, -0.1]}


@query(
    "forward_rnn_repeated",
    with_views(
        f"SELECT vec_id, {R('a')} AS h0, {R('b')} AS h1 FROM h WHERE t = 5",
        "img8",
        more="g AS (SELECT vec_id, sum(value * CASE (x * 8 + y) % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.4 ELSE -0.6 END) + 0.01 AS u, sum(value * CASE (x * 8 + y) % 3 WHEN 0 THEN -0.3 WHEN 1 THEN 0.2 ELSE 0.1 END) - 0.02 AS v FROM img8 GROUP BY vec_id), h AS (SELECT vec_id, 0 AS t, 0.1::DOUBLE AS a, -0.1::DOUBLE AS b FROM g UNION ALL SELECT vec_id, t + 1, tanh(u + a * 0.2 + b * -0.1), tanh(v + a * 0.1 + b * 0.3) FROM h JOIN g USING (vec_id) WHERE t < 5)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def forward_rnn_repeated(spark, d):
    first = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("features"))
    h = layers.recurrent_repeated(first, "vec_id", "features", **_REPEATED, iterations=5)
    return h.select("vec_id", r(F.col("h")[0]).alias("h0"), r(F.col("h")[1]).alias("h1"))


@query("autoencoder_noisy", with_views(f"SELECT vec_id, aw.o AS i, {R('tanh(sum((h + 0.3::DOUBLE * ' + N('aenoise', 'vec_id', 'h1.o') + ') * w))', 5)} AS value FROM h1 JOIN aw ON aw.i = h1.o GROUP BY vec_id, aw.o", "img8", more=", ".join((FEATURES, _W1, _B1, _H1, sql_weights("aw", "untied", {"i": 16, "o": 64}, 0.1581)))))
def autoencoder_noisy(spark, d):
    """A reconstructor with weights of its own, whose input has normal noise."""
    noisy = hidden(spark, d).withColumn("h", F.col("h") + 0.3 * normal("aenoise", F.col("vec_id"), F.col("o")))
    zero = spark.range(64).select(F.col("id").alias("o"), F.lit(0.0).alias("b"))
    back = layers.dense(layers.as_input(noisy, ["vec_id"]), weights(spark, "untied", {"i": 16, "o": 64}, 0.1581), zero, ["vec_id"], "tanh")
    return back.select("vec_id", F.col("o").alias("i"), r(F.col("h"), 5).alias("value"))


@query("weight_sharing", with_views(f"SELECT vec_id, half, o, {R('sum(value * w)', 8)} AS z FROM (SELECT vec_id, i // 32 AS half, i % 32 AS i, value FROM feat) JOIN sw USING (i) GROUP BY vec_id, half, o", "img8", more=f"{FEATURES}, {sql_weights('sw', 'shared', {'i': 32, 'o': 4}, 0.3)}"))
def weight_sharing(spark, d):
    halves = features(spark, d).select("vec_id", F.expr("i div 32").alias("half"), (F.col("i") % 32).alias("i"), "value")
    zero = spark.range(4).select(F.col("id").alias("o"), F.lit(0.0).alias("b"))
    return layers.dense(halves, weights(spark, "shared", {"i": 32, "o": 4}, 0.3), zero, ["vec_id", "half"]).select("vec_id", "half", "o", r(F.col("z"), 8).alias("z"))


AFFINITY = f"{sql_weights('aw', 'aff', {'head': 3, 'c': 2, 'kx': 2, 'ky': 2}, 0.5)}, az AS (SELECT cube_id, head, c, z, x - 1 + kx AS x, y - 1 + ky AS y, sum(value * w) AS v FROM vol8 CROSS JOIN aw WHERE x - 1 + kx BETWEEN 0 AND 6 AND y - 1 + ky BETWEEN 0 AND 6 GROUP BY ALL), ap AS (SELECT cube_id, head, c, z, x, y, exp(v) / sum(exp(v)) OVER (PARTITION BY cube_id, head, z, x, y) AS p FROM az)"


def affinity_rows(spark, d):
    """About how many rows affinity has: six for each voxel."""
    return table(spark, d, "embeddings").count() * 64 * 6


def affinity(spark, d):
    """cube_id, head, c, d (the z axis), x, y, p: three two-class heads on one weight table."""
    w = weights(spark, "aff", {"head": 3, "c": 2, "kx": 2, "ky": 2}, 0.5).select((F.col("head") * 2 + F.col("c")).alias("f"), F.lit(0).cast("long").alias("ch"), "kx", "ky", "w")
    zero = spark.range(6).select(F.col("id").alias("f"), F.lit(0.0).alias("b"))
    # Slices stay in their task through the sums and the softmax.
    x = volumes(spark, d).withColumnRenamed("z", "d").withColumn("ch", F.lit(0).cast("long")).repartition(task_parts(spark, affinity_rows(spark, d)), "cube_id", "d")
    z = layers.conv(x, w, zero, ["cube_id", "d"], {"x": 8, "y": 8}, {"x": 2, "y": 2})
    heads = z.select("cube_id", F.expr("f div 2").alias("head"), (F.col("f") % 2).alias("c"), "d", "x", "y", "z")
    return layers.softmax(heads, ["cube_id", "head", "d", "x", "y"])


@query("affinity_heads", with_views(f"SELECT cube_id, head, c, z, x, y, {R('p', 4)} AS p FROM ap", "vol8", more=AFFINITY))
def affinity_heads(spark, d):
    return affinity(spark, d).select("cube_id", "head", "c", F.col("d").alias("z"), "x", "y", r(F.col("p"), 4).alias("p"))


_HEADS = f"{sql_weights('aw', 'aff3', {'head': 3, 'c': 2, 'kz': 2, 'kx': 2, 'ky': 2}, 0.5)}, az AS (SELECT cube_id, head, c, z - 1 + kz AS z, x - 1 + kx AS x, y - 1 + ky AS y, sum(value * w) AS v FROM vol8 CROSS JOIN aw WHERE z - 1 + kz BETWEEN 0 AND 6 AND x - 1 + kx BETWEEN 0 AND 6 AND y - 1 + ky BETWEEN 0 AND 6 AND cube_id IN (SELECT cube_id FROM vol8 GROUP BY cube_id HAVING count(*) = 512) GROUP BY ALL), ap AS (SELECT cube_id, head, c, z, x, y, exp(v) / sum(exp(v)) OVER (PARTITION BY cube_id, head, z, x, y) AS p FROM az)"


@query("affinity_heads_3d", with_views(f"SELECT cube_id, head, c, z, x, y, {R('p', 4)} AS p FROM ap", "vol8", more=_HEADS))
def affinity_heads_3d(spark, d):
    """Three two-class heads of 3-D filters on one weight table, for whole cubes."""
    w = weights(spark, "aff3", {"head": 3, "c": 2, "kz": 2, "kx": 2, "ky": 2}, 0.5).select((F.col("head") * 2 + F.col("c")).alias("f"), F.lit(0).cast("long").alias("ch"), "kz", "kx", "ky", "w")
    zero = spark.range(6).select(F.col("id").alias("f"), F.lit(0.0).alias("b"))
    v = volumes(spark, d)
    whole = v.groupBy("cube_id").count().where("count = 512").select("cube_id")
    x = v.join(whole, "cube_id", "left_semi").withColumn("ch", F.lit(0).cast("long"))
    out = layers.conv(x, w, zero, ["cube_id"], {"z": 8, "x": 8, "y": 8}, {"z": 2, "x": 2, "y": 2}).toDF("cube_id", "f", "d", "x", "y", "z")
    heads = out.select("cube_id", F.expr("f div 2").alias("head"), (F.col("f") % 2).alias("c"), "d", "x", "y", "z")
    p = layers.softmax(heads, ["cube_id", "head", "d", "x", "y"])
    return p.select("cube_id", "head", "c", F.col("d").alias("z"), "x", "y", r(F.col("p"), 4).alias("p"))


@query("layer_activations", with_views(f"SELECT 'hidden' AS layer, count(*) AS n, {R('avg(h)', 4)} AS mean, {R('stddev_pop(h)', 4)} AS std FROM h1 UNION ALL SELECT 'output', count(*), {R('avg(z)', 4)}, {R('stddev_pop(z)', 4)} FROM z2", "img8", more=MLP))
def layer_activations(spark, d):
    stats = lambda df, name, c: df.agg(F.count("*").alias("n"), r(F.avg(c), 4).alias("mean"), r(F.stddev_pop(c), 4).alias("std")).select(F.lit(name).alias("layer"), "n", "mean", "std")
    return stats(hidden(spark, d), "hidden", "h").unionByName(stats(probabilities(spark, d), "output", "z"))
