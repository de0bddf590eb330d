"""Architecture, initial parameters and parameter tables."""

from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_normal as N
from ..functions.keyed import sql_rounded as R
from ..functions.keyed import sql_uniform as U
from ..functions.keyed import uniform
from ..operators import parameters
from ..plans import architecture as arch
from ..registry import query
from ..sources.tables import images, table, volumes, with_views, written
from ..sources.views import sequences

DIGITS = arch.chain((3, 3), (2, 2))
CUBES = arch.chain((4, 3, 3, 3, 2), (2, 2, 1, 1, 1))
DEEP = arch.chain((6, 5, 4), (2, 2, 2), (True, True, False))


def _sizes(layers: list, source: str) -> str:
    """SQL for (input, out) of the inputs of source that fit."""
    n, ok = "input", []
    for x in layers:
        out = f"({n} - {x.filter - 1})"
        ok.append(f"{out} > 0")
        if x.pool > 1:
            ok.append(f"{out} % {x.pool} = {1 if x.fragment else 0}")
        n = f"({out} // {x.pool})"
    ok.append(f"{n} > 0")
    return f"SELECT input, {n} AS out FROM ({source}) WHERE {' AND '.join(ok)}"


#: Sizes that are asked for: the part keys of all line items.
_DESIRED = "SELECT DISTINCT l_partkey AS desired FROM lineitem"
_RANGE = "SELECT unnest(range(2, 200)) AS input"


def _desired(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("desired")).distinct()


@query("arch_valid_inputs", _sizes(DEEP, "SELECT DISTINCT l_partkey AS input FROM lineitem"))
def arch_valid_inputs(spark, d):
    return _desired(spark, d).select(F.col("desired").alias("input"), arch.output_size(F.col("desired"), DEEP).alias("out")).where("out is not null")


@query("arch_receptive_fields", "SELECT p_partkey, CAST(1 AS BIGINT) AS layer, CAST(q1 + f1 - 1 AS BIGINT) AS field, CAST(q1 AS BIGINT) AS stride, CAST(f1 - 1 AS BIGINT) AS overlap FROM (SELECT p_partkey, 1 + p_size % 5 AS f1, 1 + p_size % 2 AS q1 FROM part) UNION ALL SELECT p_partkey, 2, (q2 + f2 - 1) * q1 + f1 - 1, q1 * q2, (q2 + f2 - 1) * q1 + f1 - 1 - q1 * q2 FROM (SELECT p_partkey, 1 + p_size % 5 AS f1, 1 + p_size % 2 AS q1, 1 + p_partkey % 3 AS f2, 1 + p_partkey % 2 AS q2 FROM part)")
def arch_receptive_fields(spark, d):
    """Two layers whose filters and pools hang on the part."""
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    chain = [arch.Layer(1 + size % 5, 1 + size % 2), arch.Layer(1 + key % 3, 1 + key % 2)]
    layers = [F.struct(F.lit(k).cast("long").alias("layer"), f.alias("field"), s.alias("stride"), (f - s).alias("overlap")) for k, (f, s) in enumerate(zip(arch.fields(chain), arch.strides(chain), strict=True), 1)]
    return table(spark, d, "part").select("p_partkey", F.explode(F.array(*layers)).alias("l")).select("p_partkey", "l.*")


_CHOSEN = f"chosen AS (SELECT desired, coalesce(max(CASE WHEN input <= desired THEN input END), min(input)) AS input FROM ({_DESIRED}) CROSS JOIN ({_sizes(CUBES, _RANGE)}) GROUP BY desired)"


def _chosen(spark, d):
    return arch.selected(arch.valid_inputs(spark, CUBES, 200), _desired(spark, d))


@query("arch_select_input", f"WITH {_CHOSEN} SELECT desired, input FROM chosen")
def arch_select_input(spark, d):
    return _chosen(spark, d).select("desired", "input")


@query("arch_multi_dim", " UNION ALL ".join(f"SELECT '{a}' AS dim, desired, max(input) AS input, arg_max(out, input) AS out FROM ({_DESIRED}) JOIN ({_sizes(layers, _RANGE)}) ON input <= desired GROUP BY desired" for a, layers in (("x", DIGITS), ("y", CUBES), ("z", DEEP))))
def arch_multi_dim(spark, d):
    out = None
    for a, layers in (("x", DIGITS), ("y", CUBES), ("z", DEEP)):
        met = _desired(spark, d).join(F.broadcast(arch.valid_inputs(spark, layers, 200)), F.col("input") <= F.col("desired"))  # at most 198 sizes
        one = met.groupBy("desired").agg(F.max("input").alias("input"), F.max_by("out", "input").alias("out")).select(F.lit(a).alias("dim"), "desired", "input", "out")
        out = one if out is None else out.unionByName(one)
    return out


@query("arch_border_input", f"WITH {_CHOSEN} SELECT desired, 'crop' AS mode, input FROM chosen UNION ALL SELECT desired, 'mirror', CASE WHEN input <> desired THEN input + 4 ELSE input END FROM chosen UNION ALL SELECT desired, 'reject', CASE WHEN input = desired THEN input END FROM chosen")
def arch_border_input(spark, d):
    chosen = _chosen(spark, d)
    modes = [arch.bordered(chosen, 4, m) for m in ("crop", "mirror", "reject")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


# A layer with a row of eight weights for each customer.
_LOOKUP = "(SELECT c_custkey AS i, o, n FROM customer CROSS JOIN (SELECT unnest(range(8)) AS o) CROSS JOIN (SELECT count(*) AS n FROM customer))"
_S = "sqrt(2.0::DOUBLE / (n + 8))"


def _lookup(spark, d, seed, kind="uniform"):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("i"))
    return parameters.glorot_rows(rows, rows.count(), 8, seed, kind)


@query("init_glorot_uniform", f"SELECT i, o, {R(f'(2.0 * {U("gu", "i", "o")} - 1.0) * {_S}')} AS w FROM {_LOOKUP}")
def init_glorot_uniform(spark, d):
    return _lookup(spark, d, "gu").withColumn("w", r(F.col("w")))


@query("init_glorot_normal", f"SELECT i, o, {R(f'{N("gn", "i", "o")} * {_S}', 5)} AS w FROM {_LOOKUP}")
def init_glorot_normal(spark, d):
    return _lookup(spark, d, "gn", "normal").withColumn("w", r(F.col("w"), 5))


@query("init_rnn_spectral")
def init_rnn_spectral(spark, d):
    """Mean values by label and by the last digit of the row's id, as a square weight of largest singular value 1."""
    w = images(spark, d).groupBy(F.col("label").alias("i"), (F.col("vec_id") % 10).alias("o")).agg(F.avg("value").alias("w"))
    return parameters.spectral(w, 10).withColumn("w", r(F.col("w")))


@query("init_bias_by_activation", f"SELECT o, act, CASE act WHEN 'relu' THEN 1.0::DOUBLE WHEN 'sigmoid' THEN 0.5::DOUBLE ELSE {R('(2.0 * ' + U('bias', 'o') + ' - 1.0) * 1e-6::DOUBLE', 12)} END AS b FROM (SELECT c_custkey AS o FROM customer) CROSS JOIN (SELECT unnest(['relu', 'sigmoid', 'tanh']) AS act)")
def init_bias_by_activation(spark, d):
    units, out = table(spark, d, "customer").select(F.col("c_custkey").alias("o")), None
    for a in ("relu", "sigmoid", "tanh"):
        one = units.select("o", F.lit(a).alias("act"), r(parameters.bias(a, "bias", F.col("o")), 12).alias("b"))
        out = one if out is None else out.unionByName(one)
    return out


_PI = "pi()"


def _gabor(cells: str, size: int, angle: str, modes: str, offset: str, by: str) -> str:
    half = (size - 1) // 2 if size % 2 else size // 2
    step = repr(2.0 * half / (size - 1))
    return (
        f"gab AS (SELECT {by}, x, y, g / sum(g * g) OVER (PARTITION BY {by}) AS value FROM (SELECT {by}, x, y, w - avg(w) OVER (PARTITION BY {by}) AS g FROM (SELECT {by}, x, y, exp(-0.5 * (u * u + v * v) / (0.35::DOUBLE * 0.35::DOUBLE)) * cos(2.0 * {_PI} * (modes / {_PI} * 1.6 * v + shift)) AS w FROM "
        f"(SELECT {by}, x, y, modes, shift, px * cos(theta) + py * sin(theta) AS u, -px * sin(theta) + py * cos(theta) AS v FROM (SELECT {by}, x, y, CAST({modes} AS DOUBLE) AS modes, {angle} / 180.0 * {_PI} AS theta, {offset} / 180.0 * {_PI} AS shift, (x * {step}::DOUBLE - {half}) / {half + 1}.0 AS px, (y * {step}::DOUBLE - {half}) / {half + 1}.0 AS py FROM {cells})))))"
    )


def _cells(n: int, size: int) -> str:
    return f"(SELECT f, x, y FROM (SELECT unnest(range({n})) AS f) CROSS JOIN (SELECT unnest(range({size})) AS x) CROSS JOIN (SELECT unnest(range({size})) AS y))"


def _responses(spark, d, filters, *by):
    """What filters (by, x, y, value) of an image's extent give on each image."""
    on = [c for c in ("x", "y", "ch") if c != "ch" or c in by]
    met = images(spark, d).withColumn("ch", F.col("vec_id") % 3).join(F.broadcast(filters.withColumnRenamed("value", "g")), on)
    return met.groupBy("vec_id", *by).agg(r(F.sum(F.col("value") * F.col("g")), 4).alias("response"))


_RESPONSE = R("sum(i.value * g.value)", 4)


@query("gabor_filter", with_views(f"SELECT vec_id, {_RESPONSE} AS response FROM img8 i JOIN gab g ON i.x = g.x AND i.y = g.y GROUP BY vec_id", "img8", more=_gabor(_cells(1, 8), 8, "30.0", "1", "45.0", "f")))
def gabor_filter(spark, d):
    cells = parameters.grid(spark, f=1, x=8, y=8)
    return _responses(spark, d, parameters.gabor(cells, 8, F.lit(30.0), F.lit(1.0), F.lit(45.0), ["f"]).select("x", "y", "value"))


_BANK = lambda n, size: _gabor(_cells(2 * n, size), size, f"CASE WHEN f < {n} THEN f * {360.0 / n} ELSE (f - {n}) * {180.0 / n} END", f"CASE WHEN f < {n} THEN 1 ELSE 2 END", f"CASE WHEN f < {n} THEN 45.0 ELSE 0.0 END", "f")


@query("gabor_bank", with_views(f"SELECT vec_id, f, {_RESPONSE} AS response FROM img8 i JOIN gab g ON i.x = g.x AND i.y = g.y GROUP BY vec_id, f", "img8", more=_BANK(4, 8)))
def gabor_bank(spark, d):
    return _responses(spark, d, parameters.gabor_bank(spark, 8, 4).select("f", "x", "y", "value"), "f")


_BLOB = lambda size: f"blob AS (SELECT x, y, g / sum(g * g) OVER () AS value FROM (SELECT x, y, exp(-0.5 * (power(x * {4.0 / (size - 1)!r}::DOUBLE - 2.0, 2) + power(y * {4.0 / (size - 1)!r}::DOUBLE - 2.0, 2))) AS g FROM (SELECT unnest(range({size})) AS x) CROSS JOIN (SELECT unnest(range({size})) AS y)))"


@query("gaussian_blob", with_views(f"SELECT vec_id, {_RESPONSE} AS response FROM img8 i JOIN blob g ON i.x = g.x AND i.y = g.y GROUP BY vec_id", "img8", more=_BLOB(8)))
def gaussian_blob(spark, d):
    return _responses(spark, d, parameters.blob(spark, 8))


@query("gabor_init", with_views(f"SELECT vec_id, f, ch, {_RESPONSE} AS response FROM (SELECT *, vec_id % 3 AS ch FROM img8) i JOIN (SELECT f, x, y, value / 10.0 AS value FROM gab UNION ALL SELECT 6, x, y, value / 10.0 FROM blob UNION ALL SELECT 7, x, y, 0.02 * {N('gnoise', 'x', 'y')} FROM blob) g ON i.x = g.x AND i.y = g.y GROUP BY vec_id, f, ch", "img8", more=f"{_BANK(3, 8)}, {_BLOB(8)}"))
def gabor_init(spark, d):
    """Eight filters of three channels; an image is of the channel of its id modulo 3."""
    return _responses(spark, d, parameters.gabor_filters(spark, 8, 8, 3, "gnoise").withColumnRenamed("w", "value"), "f", "ch")


# Stored parameters: each embedding is a layer of 8 x 8 weights.


def _params(spark, d):
    return images(spark, d).select(F.col("vec_id").alias("layer"), F.lit("W").alias("param"), F.col("x").alias("i"), F.col("y").alias("o"), F.col("value").alias("w"))


@query("weights_roundtrip", with_views("SELECT vec_id AS layer, 'W' AS param, x AS i, y AS o, value AS w FROM img8", "img8"))
def weights_roundtrip(spark, d):
    return written(_params(spark, d), "weights")


@query("weights_infer_shapes", "SELECT user_id AS layer, 'W' AS param, count(*) AS d0, 1::BIGINT AS d1 FROM events GROUP BY user_id")
def weights_infer_shapes(spark, d):
    """Of layers with a row for each event of a user."""
    rows = sequences(spark, d).select(F.col("user_id").alias("layer"), F.lit("W").alias("param"), F.col("t").alias("i"), F.lit(0).cast("long").alias("o"), F.col("value").alias("w"))
    return parameters.shapes(written(rows, "weights"))


@query("weights_adaptive_load", with_views(f"SELECT g.f, 0::BIGINT AS ch, g.x, g.y, coalesce(s.value, {R('(2.0 * ' + U('fill', 'g.f', 'g.ch', 'g.x', 'g.y') + ' - 1.0) * 0.02')}) AS w FROM (SELECT f, 0 AS ch, x, y, n FROM (SELECT vec_id + k * n AS f, n FROM embeddings CROSS JOIN (SELECT unnest(range(2)) AS k) CROSS JOIN (SELECT count(*) AS n FROM embeddings)) CROSS JOIN (SELECT unnest(range(9)) AS x) CROSS JOIN (SELECT unnest(range(5)) AS y)) g LEFT JOIN img8 s ON s.vec_id = g.f % n AND s.x = g.x AND s.y = g.y", "img8"))
def weights_adaptive_load(spark, d):
    """Twice as many filters of 9 x 5 from the saved ones of 8 x 8."""
    ids = table(spark, d, "embeddings").select("vec_id")
    n = ids.count()
    saved = images(spark, d).select(F.col("vec_id").alias("f"), F.lit(0).cast("long").alias("ch"), "x", "y", F.col("value").alias("w"))
    target = ids.select(F.explode(F.array(F.col("vec_id"), F.col("vec_id") + n)).alias("f")).crossJoin(F.broadcast(parameters.grid(spark, ch=1, x=9, y=5)))  # 45 cells
    fill = r((2.0 * uniform("fill", *(F.col(c) for c in ("f", "ch", "x", "y"))) - 1.0) * 0.02)
    return parameters.adapted(saved, target, n, fill)


# Saved filters of two channels: pairs of embeddings. More or fewer maps, with more or fewer channels.
_WANTS = [(2, 3), (2, 1), (-1, 3), (-1, 1)]
_SAVED = "nf AS (SELECT count(*) // 2 AS n FROM embeddings), s AS (SELECT vec_id // 2 AS f, vec_id % 2 AS ch, x, y, value AS w FROM img8 WHERE vec_id // 2 < (SELECT n FROM nf))"


def _axis(name: str, n: int) -> str:
    return f"(SELECT unnest(range({n})) AS {name})"


def _refit_sql(case: int, more: int, n_ch: int) -> str:
    at = ("g.f", "g.ch", "g.x", "g.y")
    ch = "g.ch % 2" if n_ch > 2 else f"g.ch + {0 if more > 0 else (2 - n_ch) // 2}"
    jitter = f" + 1e-4::DOUBLE * {U('refitj', *at)}" if n_ch > 2 and more <= 0 else ""
    grid = f"(SELECT n, unnest(range(n + {more})) AS f FROM nf) CROSS JOIN {_axis('ch', n_ch)} CROSS JOIN {_axis('x', 9)} CROSS JOIN {_axis('y', 5)}"
    return f"SELECT CAST({case} AS BIGINT) AS fit, g.f, g.ch, g.x, g.y, {R(f'coalesce(s.w{jitter}, 0.02::DOUBLE * {N("refit", *at)})')} AS w FROM (SELECT * FROM {grid}) g LEFT JOIN s ON s.f = g.f % n AND s.ch = {ch} AND s.x = g.x AND s.y = g.y"


@query("weights_refit", with_views(" UNION ALL ".join(_refit_sql(k, *w) for k, w in enumerate(_WANTS)), "img8", more=_SAVED))
def weights_refit(spark, d):
    n, out = table(spark, d, "embeddings").count() // 2, None
    saved = images(spark, d).select(F.expr("vec_id div 2").alias("f"), (F.col("vec_id") % 2).alias("ch"), "x", "y", F.col("value").alias("w")).where(F.col("f") < n)
    for k, (more, ch) in enumerate(_WANTS):
        one = parameters.refitted(saved, parameters.grid(spark, f=n + more, ch=ch, x=9, y=5), {"f": n, "ch": 2}, {"f": n + more, "ch": ch}, "refit")
        one = one.select(F.lit(k).cast("long").alias("fit"), "f", "ch", "x", "y", r(F.col("w")).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


# Saved filters of three axes: the volumes.
_SAVED_3D = "s AS MATERIALIZED (SELECT cube_id AS f, z, 0::BIGINT AS ch, x, y, value AS w FROM vol8), d AS (SELECT stddev_pop(w) AS std FROM s), nv AS (SELECT count(DISTINCT f) AS n FROM s)"
_WANTS_3D = [(1, {"z": 10, "ch": 1, "x": 9, "y": 6}), (0, {"z": 4, "ch": 2, "x": 6, "y": 10})]


def _refit_3d_sql(case: int, more: int, n: dict[str, int]) -> str:
    shift = {a: (8 - n[a]) // 2 if n[a] < 8 else -((n[a] - 8) // 2) for a in ("z", "x", "y")}
    same = " AND ".join(f"s.{a} = g.{a} + ({k})" for a, k in shift.items())
    return f"SELECT CAST({case} AS BIGINT) AS fit, g.f, g.z, g.ch, g.x, g.y, {R(f'coalesce(s.w, (d.std + 1e-9::DOUBLE) * {N("refit3", "g.f", "g.z", "g.ch", "g.x", "g.y")})')} AS w FROM (SELECT * FROM (SELECT unnest(range(n + {more})) AS f FROM nv) CROSS JOIN {' CROSS JOIN '.join(_axis(*e) for e in n.items())}) g LEFT JOIN s ON s.f = g.f AND s.ch = g.ch AND {same} CROSS JOIN d"


@query("weights_refit_3d", with_views(" UNION ALL ".join(_refit_3d_sql(k, *w) for k, w in enumerate(_WANTS_3D)), "vol8", more=_SAVED_3D))
def weights_refit_3d(spark, d):
    saved, out = volumes(spark, d).select(F.col("cube_id").alias("f"), "z", F.lit(0).cast("long").alias("ch"), "x", "y", F.col("value").alias("w")), None
    n = saved.select("f").distinct().count()
    for k, (more, wants) in enumerate(_WANTS_3D):
        one = parameters.refitted_3d(saved, parameters.grid(spark, f=n + more, **wants), {"z": 8, "x": 8, "y": 8}, wants, "refit3")
        one = one.select(F.lit(k).cast("long").alias("fit"), "f", "z", "ch", "x", "y", r(F.col("w")).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


@query("bias_refit", f"WITH s AS (SELECT vec_id AS o, {R('list_sum(list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 4)))', 4)} AS b FROM embeddings), ns AS (SELECT count(*) AS n FROM s) SELECT k AS n, g.o, s.b FROM (SELECT k, n, unnest(range(k)) AS o FROM (SELECT n, unnest([n // 2, 2 * n + 1]) AS k FROM ns)) g JOIN s ON s.o = g.o % n")
def bias_refit(spark, d):
    """Half as many biases, and more than twice as many, from one for each embedding (its sum)."""
    total = F.aggregate(F.transform("embedding", lambda v: F.round(v.cast("double"), 4)), F.lit(0.0), lambda a, v: a + v)
    saved = table(spark, d, "embeddings").select(F.col("vec_id").alias("o"), r(total, 4).alias("b"))
    n = saved.count()
    fit = lambda k: parameters.refitted_bias(saved, parameters.grid(spark, o=k), n).select(F.lit(k).cast("long").alias("n"), "o", "b")
    return fit(n // 2).unionByName(fit(2 * n + 1))
