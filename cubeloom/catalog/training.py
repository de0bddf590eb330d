"""Gradients, update rules and training loops."""

import numpy as np
from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_rounded as R
from ..functions.keyed import sql_uniform as U
from ..functions.keyed import uniform
from ..operators import kernels, layers, nets, optimise
from ..plans import trainer
from ..plans.network import NetworkConfig
from ..registry import query
from ..sources.tables import table, training_log, with_views
from ..sources.views import FEATURES, biases, features, sql_biases, sql_weights, weights
from .layers import MLP, hidden, probabilities

_E = "1e-6::DOUBLE"
_SW, _SB = sql_weights("sw", "sm", {"i": 64, "o": 10}, 0.2), sql_biases("sb", "smb", "o", 10)
SOFT = ", ".join(
    (
        FEATURES,
        _SW,
        _SB,
        "sz AS (SELECT vec_id, label, o AS c, sum(value * w) + any_value(b) AS z FROM feat JOIN sw USING (i) JOIN sb USING (o) GROUP BY vec_id, label, o)",
        "sp AS (SELECT vec_id, label, c, z, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM sz)",
        f"sd AS (SELECT a.vec_id, a.c, (a.p - CASE WHEN a.c = a.label THEN 1.0 ELSE 0.0 END) * (o.p / (o.p + {_E})) / (SELECT count(*) FROM embeddings) AS delta FROM sp a JOIN sp o ON a.vec_id = o.vec_id AND o.c = o.label)",
        "sg AS (SELECT i, c, sum(value * delta) AS g FROM feat JOIN sd USING (vec_id) GROUP BY i, c)",
    )
)


def _weights(spark):
    return weights(spark, "sm", {"i": 64, "o": 10}, 0.2)


def soft(spark, d):
    """vec_id, label, c, z, p of a softmax layer."""
    z = layers.dense(features(spark, d), _weights(spark), biases(spark, "smb", "o", 10), ["vec_id", "label"]).withColumnRenamed("o", "c")
    return layers.softmax(z, ["vec_id"])


def _delta(spark, d):
    return optimise.softmax_delta(soft(spark, d), "vec_id", F.lit(table(spark, d, "embeddings").count()))


def gradient(spark, d):
    """(i, c, g) by the kernels: partitions' sums of packed slopes. Its relational form is outer_sum of _delta, as in gradient_dense."""
    net = nets.Net((64,), [nets.Layer("dense", 64, 10, "linear")], 10)
    w = np.concatenate((kernels.weights_array(_weights(spark), {"i": 64, "o": 10}).ravel(), kernels.weights_array(biases(spark, "smb", "o", 10), {"o": 10}, "b")))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda v: r(v.cast("double"), 4)).alias("features"), F.col("label").cast("long").alias("label"))
    _, g, _ = nets.gradient(rows, net, w)
    return spark.createDataFrame([(i, c, float(v)) for (i, c), v in np.ndenumerate(g[:640].reshape(64, 10))], "i long, c long, g double")


_MAXOUT = ", ".join(
    (
        FEATURES,
        sql_weights("xw", "maxw", {"i": 64, "o": 8}, 0.5),
        sql_biases("xb", "maxb", "o", 8),
        sql_weights("xv", "maxv", {"m": 4}, 0.5),
        sql_biases("xc", "maxc", "q", 1),
        "xz AS (SELECT vec_id, label, o, sum(value * w) + any_value(b) AS z FROM feat JOIN xw USING (i) JOIN xb USING (o) GROUP BY vec_id, label, o)",
        "xh AS MATERIALIZED (SELECT vec_id, label, o // 2 AS m, max(z) AS h, arg_max(o, z) AS o FROM xz GROUP BY vec_id, label, o // 2)",
        "xy AS MATERIALIZED (SELECT vec_id, sum(h * w) + (SELECT b FROM xc) AS z, any_value(label) AS label FROM xh JOIN xv USING (m) GROUP BY vec_id)",
    )
)


def _maxout(spark, d):
    """(examples, network, weights) of a regression of the labels by eight units, the larger of each two, and a linear output."""
    net = nets.Net((64,), [nets.Layer("dense", 64, 8, "maxout 2"), nets.Layer("dense", 4, 1, "linear")], 1, "regression")
    flat = lambda table, dims, value="w": kernels.weights_array(table, dims, value).ravel()
    w = [flat(weights(spark, "maxw", {"i": 64, "o": 8}, 0.5), {"i": 64, "o": 8}), flat(biases(spark, "maxb", "o", 8), {"o": 8}, "b")]
    w += [flat(weights(spark, "maxv", {"m": 4}, 0.5), {"m": 4}), flat(biases(spark, "maxc", "q", 1), {"q": 1}, "b")]
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda v: r(v.cast("double"), 4)).alias("features"), F.col("label").cast("double").alias("label"))
    return rows, net, np.concatenate(w)


@query("forward_maxout_net", with_views(f"SELECT vec_id, {R('z')} AS z FROM xy", "img8", more=_MAXOUT))
def forward_maxout_net(spark, d):
    return nets.outputs(*_maxout(spark, d), probabilities=False).select(F.col("key").alias("vec_id"), r(F.col("p")).alias("z"))


@query(
    "gradient_maxout",
    with_views(
        f"SELECT 0::BIGINT AS layer, f.i, xw.o, {R('sum(CASE WHEN xh.o = xw.o THEN 2.0 * (xy.z - xy.label) * xv.w * f.value ELSE 0.0 END) / (SELECT count(*) FROM embeddings)')} AS g "
        "FROM feat f JOIN xw USING (i) JOIN xh ON xh.vec_id = f.vec_id AND xh.m = xw.o // 2 JOIN xv ON xv.m = xh.m JOIN xy ON xy.vec_id = f.vec_id GROUP BY f.i, xw.o "
        f"UNION ALL SELECT 1, m, 0, {R('avg(2.0 * (xy.z - xy.label) * h)')} FROM xh JOIN xy USING (vec_id) GROUP BY m",
        "img8",
        more=_MAXOUT,
    ),
)
def gradient_maxout(spark, d):
    """The gradient by every weight (biases aside) of that network's squared error: a unit takes part where it is the larger one."""
    _, g, _ = nets.gradient(*_maxout(spark, d))
    rows = [(0, i, o, float(v)) for (i, o), v in np.ndenumerate(g[:512].reshape(64, 8))] + [(1, m, 0, float(v)) for m, v in enumerate(g[520:524])]
    return spark.createDataFrame(rows, "layer long, i long, o long, g double").withColumn("g", r(F.col("g")))


@query("gradient_softmax_nll", with_views(f"SELECT vec_id, c, {R('delta', 7)} AS delta FROM sd", "img8", more=SOFT))
def gradient_softmax_nll(spark, d):
    return _delta(spark, d).withColumn("delta", r(F.col("delta"), 7))


_BACK = ", ".join(
    (
        f"d2 AS (SELECT a.vec_id, a.c, (a.p - CASE WHEN a.c = a.label THEN 1.0 ELSE 0.0 END) * (o.p / (o.p + {_E})) / (SELECT count(*) FROM embeddings) AS delta FROM p2 a JOIN p2 o ON a.vec_id = o.vec_id AND o.c = o.label)",
        "d1 AS (SELECT d2.vec_id, w2.i AS o, sum(delta * w) * (1.0 - any_value(h) * any_value(h)) AS delta FROM d2 JOIN w2 ON d2.c = w2.o JOIN h1 ON h1.vec_id = d2.vec_id AND h1.o = w2.i GROUP BY d2.vec_id, w2.i)",
    )
)


@query("gradient_dense", with_views(f"SELECT i, d1.o, {R('sum(value * delta)')} AS g FROM feat JOIN d1 USING (vec_id) GROUP BY i, d1.o", "img8", more=f"{MLP}, {_BACK}"))
def gradient_dense(spark, d):
    top = optimise.softmax_delta(probabilities(spark, d), "vec_id", F.lit(table(spark, d, "embeddings").count()))
    low = optimise.backward_tanh(top, weights(spark, "mlp2", {"i": 16, "o": 10}, 0.2774), hidden(spark, d), "vec_id")
    g = optimise.outer_sum(features(spark, d), low, "vec_id")
    return g.select("i", F.col("c").alias("o"), r(F.col("g")).alias("g"))


def _state(spark, d):
    """i, c, w, g and keyed states a, b."""
    w = _weights(spark).withColumnRenamed("o", "c")
    state = w.withColumns({k: r((2.0 * uniform(f"state{k}", F.col("i"), F.col("c")) - 1.0) * 0.01) for k in "ab"})
    return state.join(gradient(spark, d), ["i", "c"])


_STATE = f"{SOFT}, st AS (SELECT sw.i, sw.o AS c, w, g, " + ", ".join(f"round((2.0 * {U(f'state{k}', 'sw.i', 'sw.o')} - 1.0) * 0.01, 6) + 0.0 AS {k}" for k in "ab") + " FROM sw JOIN sg ON sg.i = sw.i AND sg.c = sw.o)"


@query("train_sgd_step", with_views(f"SELECT i, c, {R('w - 0.1 * (g + 0.9 * a) - 0.1 * 0.001 * w')} AS w, {R('g + 0.9 * a')} AS v FROM st", "img8", more=_STATE))
def train_sgd_step(spark, d):
    w, v = optimise.sgd(F.col("w"), F.col("g"), F.col("a"), 0.1, 0.9, 0.001)
    return _state(spark, d).select("i", "c", r(w).alias("w"), r(v).alias("v"))


_TWO_STEPS = ", ".join(
    (
        SOFT,
        "u1 AS MATERIALIZED (SELECT sw.i, sw.o AS c, w - 0.1 * g - 0.1 * 0.001 * w AS w, g AS v FROM sw JOIN sg ON sg.i = sw.i AND sg.c = sw.o)",
        "ub AS MATERIALIZED (SELECT sb.o AS c, b - 0.1 * g - 0.1 * 0.001 * b AS b FROM sb JOIN (SELECT c, sum(delta) AS g FROM sd GROUP BY c) d ON d.c = sb.o)",
        "uz AS (SELECT vec_id, label, c, sum(value * w) + any_value(b) AS z FROM feat JOIN u1 USING (i) JOIN ub USING (c) GROUP BY vec_id, label, c)",
        "up AS (SELECT vec_id, label, c, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS p FROM uz)",
        "ul AS (SELECT *, sum(CASE WHEN c = label THEN p END) OVER (PARTITION BY vec_id) AS own FROM up)",
        f"ud AS MATERIALIZED (SELECT vec_id, c, (p - CASE WHEN c = label THEN 1.0 ELSE 0.0 END) * (own / (own + {_E})) / (SELECT count(*) FROM embeddings) AS delta FROM ul)",
        "ug AS (SELECT i, c, sum(value * delta) AS g FROM feat JOIN ud USING (vec_id) GROUP BY i, c)",
    )
)


@query("trainer_two_steps", with_views(f"SELECT i, c, {R('w - 0.05 * (g + 0.9 * v) - 0.05 * 0.001 * w')} AS w FROM u1 JOIN ug USING (i, c)", "img8", more=_TWO_STEPS))
def trainer_two_steps(spark, d):
    """The weights after a trainer's two steps with momentum, weight decay and a rate that its schedule halves, begun anew after a step that is thrown away."""
    net = nets.Net((64,), [nets.Layer("dense", 64, 10, "linear")], 10)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda v: r(v.cast("double"), 4)).alias("features"), F.col("label").cast("long").alias("label"))
    t = trainer.Trainer(net, e, rate=0.1, momentum=0.9, weight_decay=0.001, schedule={1: 0.05})
    t.training_step()
    t.reset()
    t.w = np.concatenate((kernels.weights_array(_weights(spark), {"i": 64, "o": 10}).ravel(), kernels.weights_array(biases(spark, "smb", "o", 10), {"o": 10}, "b")))
    for _ in range(2):
        t.training_step()
    return spark.createDataFrame([(i, c, float(v)) for (i, c), v in np.ndenumerate(t.w[:640].reshape(64, 10))], "i long, c long, w double").withColumn("w", r(F.col("w")))


_M, _V = "(0.9 * a + 0.1 * g)", "(0.999 * abs(b) + 0.001 * g * g)"


@query("train_adam_step", with_views(f"SELECT i, c, {R(f'w - 0.01 * sqrt(1.0 - power(0.999, 3)) / (1.0 - power(0.9, 3)) * {_M} / (sqrt({_V}) + 1e-8::DOUBLE)')} AS w FROM st", "img8", more=_STATE))
def train_adam_step(spark, d):
    w, _, _ = optimise.adam(F.col("w"), F.col("g"), F.col("a"), F.abs("b"), 3, 0.01, 0.9, 0.999, 1e-8)
    return _state(spark, d).select("i", "c", r(w).alias("w"))


@query("train_rprop_step", with_views(f"SELECT i, c, {R('w - s * g / (abs(g) + 1e-6::DOUBLE) - 0.0001 * w')} AS w, {R('least(greatest(CASE WHEN g * a < -1e-9 THEN s * 0.5 WHEN g * a > 1e-11 THEN s * 1.2 ELSE s END, 1e-7), 2e-3)', 9)} AS step FROM (SELECT *, abs(b) / 10.0 AS s FROM st)", "img8", more=_STATE))
def train_rprop_step(spark, d):
    w, s = optimise.rprop(F.col("w"), F.col("g"), F.col("a"), F.abs("b") / 10.0, 0.2, 0.5, 0.0001)
    return _state(spark, d).select("i", "c", r(w).alias("w"), r(s, 9).alias("step"))


_SEARCH = "gz AS (SELECT vec_id, c, sum(value * g) AS gz FROM feat JOIN sg USING (i) GROUP BY vec_id, c), tr AS (SELECT k, power(0.5, k) * 8.0 AS t FROM (SELECT unnest(range(8)) AS k)), lz AS (SELECT k, t, vec_id, label, c, z - t * gz AS z FROM sp JOIN gz USING (vec_id, c) CROSS JOIN tr), lp AS (SELECT k, t, vec_id, label, c, exp(z) / sum(exp(z)) OVER (PARTITION BY k, vec_id) AS p FROM lz)"


@query("cg_line_search", with_views(f"SELECT k, {R('t')} AS t, {R(f'avg(-ln(p + {_E}))', 4)} AS loss FROM lp WHERE c = label GROUP BY k, t", "img8", more=f"{SOFT}, {_SEARCH}"))
def cg_line_search(spark, d):
    """The loss at all trial steps along the negative gradient, in one pass: the linear output moves by t times its own slope."""
    g = gradient(spark, d)
    slope = features(spark, d).join(F.broadcast(g), "i").groupBy("vec_id", "c").agg(F.sum(F.col("value") * F.col("g")).alias("gz"))
    trials = spark.range(8).select(F.col("id").alias("k"), (F.pow(F.lit(0.5), F.col("id")) * 8.0).alias("t"))
    moved = soft(spark, d).drop("p").join(slope, ["vec_id", "c"]).crossJoin(F.broadcast(trials)).withColumn("z", F.col("z") - F.col("t") * F.col("gz"))
    p = layers.softmax(moved, ["k", "vec_id"]).where("c = label")
    return p.groupBy("k", "t").agg(r(F.avg(-F.log(F.col("p") + optimise.EPS)), 4).alias("loss")).select("k", r(F.col("t")).alias("t"), "loss")


@query("lr_schedule", with_views(f"SELECT i AS step, {R('CASE WHEN i >= 5000 THEN 0.003 * power(0.9, i // 1000 - 5 + 1) WHEN i >= 2500 THEN 0.02 * power(0.9, i // 1000 - 2) ELSE 0.01 * power(0.9, i // 1000 + 1) END', 9)} AS rate FROM train_log", "train_log"))
def lr_schedule(spark, d):
    """The rate at each step of the log."""
    return training_log(spark, d).select(F.col("i").alias("step"), r(optimise.rate_at(F.col("i"), 0.01, 0.9, 1000, {2500: 0.02, 5000: 0.003}), 9).alias("rate"))


def _examples(spark, d):
    return table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("long").alias("label"))


@query("train_cg_steps")
def train_cg_steps(spark, d):
    _, log = optimise.conjugate_gradient(optimise.loss_and_gradient(_examples(spark, d), 64, 10), np.zeros((65, 10)), 3)
    return spark.createDataFrame([(i, round(a, 6), round(t, 6), round(c, 6)) for i, (a, t, c) in enumerate(log)], "step long, loss double, t double, coefficient double")


@query("train_lbfgs_step")
def train_lbfgs_step(spark, d):
    _, log = optimise.lbfgs(optimise.loss_and_gradient(_examples(spark, d), 64, 10), np.zeros((65, 10)), 3)
    return spark.createDataFrame([(i, round(a, 6)) for i, a in enumerate(log)], "step long, loss double")


@query("train_mlp_epochs")
def train_mlp_epochs(spark, d):
    """Momentum descent of a network with a hidden layer over keyed mini-batches; the loss over all examples after each epoch."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("long").alias("label"))
    run = trainer.Trainer(trainer.built(NetworkConfig(mode="vect-scalar", n_lab=10, side=8, mlp=[16])), e, e, n_batches=2, rate=0.1)
    for _ in range(3):
        run.run(2, evaluate_every=2)
    return spark.createDataFrame([(i, round(loss, 6), round(error, 6)) for i, (_, loss, error) in enumerate(run.history)], "epoch long, loss double, error double")
