"""Training logs as time series, and statistics of parameters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_rounded as R
from ..operators import monitor
from ..registry import query
from ..sources.tables import images, running_sum, table, training_log, volumes, voxel_classes, with_views
from ..sources.views import sequences, sql_weights, weights

_SEQ = "q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, abs(value) / 100.0 AS nll FROM events)"


@query("ema_timeline", f"WITH RECURSIVE {_SEQ}, e AS (SELECT user_id, CAST(-1 AS BIGINT) AS t, 0.65::DOUBLE AS ema FROM (SELECT DISTINCT user_id FROM q) UNION ALL SELECT e.user_id, q.t, 0.995 * e.ema + 0.005 * q.nll FROM e JOIN q ON q.user_id = e.user_id AND q.t = e.t + 1) SELECT user_id, {R('arg_max(ema, t)')} AS ema FROM e GROUP BY user_id")
def ema_timeline(spark, d):
    seq = sequences(spark, d).withColumn("value", F.abs("value") / 100.0)
    return monitor.last_ema(seq, "user_id", 0.995, 0.65).select("user_id", r(F.col("ema")).alias("ema"))


@query("sma_timeline", f"WITH {_SEQ} SELECT user_id, t, {R('avg(nll) OVER (PARTITION BY user_id ORDER BY t ROWS 9 PRECEDING)')} AS sma FROM q")
def sma_timeline(spark, d):
    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(-9, 0)
    return sequences(spark, d).select("user_id", "t", r(F.avg(F.abs("value") / 100.0).over(w)).alias("sma"))


@query("batch_prevalence", f"SELECT vec_id // 50 AS batch, {R('avg(label)')} AS mean_label FROM embeddings GROUP BY vec_id // 50")
def batch_prevalence(spark, d):
    return table(spark, d, "embeddings").groupBy(F.expr("vec_id div 50").alias("batch")).agg(r(F.avg("label")).alias("mean_label"))


@query("history_every_n", with_views("SELECT i, nll FROM train_log WHERE i % 100 = 0", "train_log"))
def history_every_n(spark, d):
    return training_log(spark, d).where("i % 100 = 0").select("i", "nll")


@query("divergence_guard", "SELECT user_id, bool_or(isnan(v) OR isinf(v)) AS diverged FROM (SELECT user_id, CASE WHEN event_id % 997 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events) GROUP BY user_id")
def divergence_guard(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 997 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return e.groupBy("user_id").agg(monitor.diverged(F.col("v")).alias("diverged"))


@query("decimate_timeline", with_views("SELECT i, nll FROM train_log WHERE i % greatest((SELECT count(*) FROM train_log) // 2000, 1) = 0", "train_log"))
def decimate_timeline(spark, d):
    return monitor.decimated(training_log(spark, d), "i", 2000).select("i", "nll")


@query("timeline_summary", with_views(f"SELECT {R('max(i) / 60.0')} AS minutes, {R('avg(nll) FILTER (WHERE i >= n - 30)')} AS last_mean, {R('3.0 * avg(nll)')} AS cap, {R('avg(nll) - 2.0 * stddev_pop(nll)')} AS low, {R('avg(nll) + 2.0 * stddev_pop(nll)')} AS high FROM train_log CROSS JOIN (SELECT count(*) AS n FROM train_log)", "train_log"))
def timeline_summary(spark, d):
    return monitor.summary(training_log(spark, d))


_TICKS = "n AS (SELECT max(i) AS n FROM train_log WHERE i % 7 = 0), u AS (SELECT n, CAST(pow(10, floor(log10(greatest(n // 5, 1)))) AS BIGINT) AS u FROM n), c AS (SELECT i, sum(nll) OVER (ORDER BY i) AS t FROM train_log)"
_TICKS_SQL = with_views(f"SELECT k AS step, {R('a.t + (b.t - a.t) * (k - a.i) / 7.0')} AS minutes FROM (SELECT unnest(range(0, n, greatest(CAST(round_even(n / (5.0 * u), 0) AS BIGINT), 1) * u)) AS k FROM u) JOIN c a ON a.i = k // 7 * 7 JOIN c b ON b.i = a.i + 7", "train_log", more=_TICKS)


@query("step_ticks_interp", _TICKS_SQL)
@query("step_ticks_interp_all", _TICKS_SQL)
def step_ticks_interp(spark, d):
    """The time at ticks over the whole log."""
    log = running_sum(training_log(spark, d), "i", "nll", "t").where("i % 7 = 0")
    last = log.agg(F.max("i")).first()[0] or 0
    ticks = spark.range(0, last, monitor.tick_spacing(last)).withColumnRenamed("id", "step")
    return monitor.interpolated(log, ticks, "i", "t", "step").select("step", r(F.col("t")).alias("minutes"))


@query("param_stats", with_views(f"SELECT label AS layer, count(*) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)', 4)} AS std, {R('avg(abs(value))', 8)} AS mean_abs, {R('median(abs(value))', 8)} AS median_abs FROM img8 GROUP BY label", "img8"))
def param_stats(spark, d):
    """Of the embeddings' values, a layer for each label."""
    return monitor.parameter_stats(images(spark, d).select(F.col("label").alias("layer"), F.col("value").alias("w")), "layer", "w")


@query("histogram_100", f"SELECT least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 100.0) AS BIGINT), 99) AS bin, count(*) AS n FROM lineitem CROSS JOIN (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
def histogram_100(spark, d):
    return monitor.histogram(table(spark, d, "lineitem"), "l_extendedprice", 100)


@query("target_overlay", with_views(f"SELECT cube_id, z, x, y, {R('value - CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN cls ELSE 0 END')} AS overlay FROM cls8", "cls8"))
def target_overlay(spark, d):
    v = volumes(spark, d)
    inner = voxel_classes(v).where("x between 2 and 5 and y between 2 and 5").drop("value")
    return v.join(inner, ["cube_id", "z", "x", "y"], "left").select("cube_id", "z", "x", "y", r(F.col("value") - F.coalesce("cls", F.lit(0))).alias("overlay"))


# Each pixel's models in one list, of which pairs are unnested.
_PAIRS = with_views("SELECT a.m AS m1, b.m AS m2, img, x, y, least(a.v, b.v) AS r, a.v AS g, b.v AS b FROM (SELECT img, x, y, a, unnest(l) AS b FROM (SELECT img, x, y, l, unnest(l) AS a FROM (SELECT vec_id // 4 AS img, x, y, list({'m': vec_id % 4, 'v': value}) AS l FROM img8 GROUP BY vec_id // 4, x, y))) WHERE a.m < b.m", "img8")


@query("pairwise_prediction_diff", _PAIRS)
@query("pairwise_prediction_diff_all", _PAIRS)
def pairwise_prediction_diff(spark, d):
    p = images(spark, d).select((F.col("vec_id") % 4).alias("m"), F.expr("vec_id div 4").alias("img"), "x", "y", "value")
    return monitor.pairwise(p, "m", ["img", "x", "y"])


# An image's models in one list, of which pairs are unnested; a pair's second image is a list of its rows, read at the pixel that the first one's stands for.
_SIDED = """mi AS (SELECT vec_id % 4 AS m, vec_id // 4 AS img, 8 - 2 * ((vec_id % 4) % 2) - (vec_id % 4) // 2 AS n, x, y, value FROM img8 WHERE x < 8 - 2 * ((vec_id % 4) % 2) - (vec_id % 4) // 2 AND y < 8 - 2 * ((vec_id % 4) % 2) - (vec_id % 4) // 2),
ml AS (SELECT img, list({'m': m, 'n': n, 'p': p}) AS l FROM (SELECT img, m, n, list(value ORDER BY x, y) AS p FROM mi GROUP BY img, m, n) GROUP BY img),
mp AS (SELECT img, a, b, least(a.n, b.n) AS n FROM (SELECT img, a, unnest(l) AS b FROM (SELECT img, l, unnest(l) AS a FROM ml)) WHERE a.m < b.m),
mx AS (SELECT img, a, b, n, x, unnest(range(n)) AS y FROM (SELECT img, a, b, n, unnest(range(n)) AS x FROM mp)),
mv AS (SELECT a.m AS m1, b.m AS m2, img, x, y, a.p[(x + (a.n - n) // 2) * a.n + y + (a.n - n) // 2 + 1] AS g, b.p[(x + (b.n - n) // 2) * b.n + y + (b.n - n) // 2 + 1] AS b FROM mx)"""


@query("pairwise_prediction_cropped", with_views("SELECT m1, m2, img, x, y, least(g, b) AS r, g, b FROM mv", "img8", more=_SIDED))
def pairwise_prediction_cropped(spark, d):
    """Models 0 to 3 with images of side 8, 6, 7 and 5."""
    m = F.col("vec_id") % 4
    p = images(spark, d).select(m.alias("m"), F.expr("vec_id div 4").alias("img"), (8 - 2 * (m % 2) - F.expr("(vec_id % 4) div 2")).alias("n"), "x", "y", "value").where("x < n and y < n")
    return monitor.pairwise_cropped(p, "m", "n", ["img"])


@query("model_cost", "SELECT CAST(p_partkey AS BIGINT) AS layer, CAST(1 + p_size % 7 AS BIGINT) * p_size * (1 + p_size % 3) * (1 + p_size % 3) * (1 + p_partkey % 40) * 50 AS mults, CAST(1 + p_size % 7 AS BIGINT) * p_size * (1 + p_size % 3) * (1 + p_size % 3) + p_size AS params FROM part")
def model_cost(spark, d):
    """Of a layer for each part, whose channels, maps, filter and positions hang on it."""
    size = F.col("p_size").cast("long")
    layers = table(spark, d, "part").select(F.col("p_partkey").alias("layer"), (1 + size % 7).alias("n_in"), size.alias("n_out"), ((1 + size % 3) * (1 + size % 3)).alias("filter"), (1 + F.col("p_partkey") % 40).alias("positions"))
    return monitor.cost(layers, 50)


@query("format_units", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN n >= 1e12 THEN 'T' WHEN n >= 1e9 THEN 'G' WHEN n >= 1e6 THEN 'M' ELSE 'k' END AS unit, CASE WHEN s > 4000 THEN 'h' WHEN s > 300 THEN 'm' ELSE 's' END AS time_unit FROM (SELECT *, l_extendedprice * l_quantity * l_partkey AS n, l_extendedprice / 10.0 AS s FROM lineitem)")
def format_units(spark, d):
    li = table(spark, d, "lineitem")
    n, s = F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_partkey"), F.col("l_extendedprice") / 10.0
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), monitor.unit(n).alias("unit"), monitor.time_unit(s).alias("time_unit"))


@query("suggest_key", "SELECT n_name, arg_min(r_name, ROW(levenshtein(n_name, r_name), r_name)) AS suggestion, CAST(min(levenshtein(n_name, r_name)) AS BIGINT) AS distance FROM nation CROSS JOIN region GROUP BY n_name")
def suggest_key(spark, d):
    known = table(spark, d, "region").select(F.col("r_name").alias("known"))
    return monitor.suggestions(table(spark, d, "nation").select(F.col("n_name")), "n_name", known)
