"""Batches, splits, draws and patches."""

from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_rounded as R
from ..functions.keyed import sql_uniform as U
from ..functions.keyed import uniform
from ..operators import augment, sampling
from ..registry import query
from ..sources.tables import images, indexed, table, voxel_classes, volumes, with_views, written
from ..sources.views import cube_info, sequences
from ..streaming import priority

_SHUFFLE = f"SELECT epoch, (k // 32) AS batch, k % 32 AS slot, vec_id FROM (SELECT e.epoch, vec_id, row_number() OVER (PARTITION BY e.epoch ORDER BY {U('shuffle', 'e.epoch', 'vec_id')}, vec_id) - 1 AS k, count(*) OVER (PARTITION BY e.epoch) AS n FROM embeddings CROSS JOIN (SELECT unnest(range(2)) AS epoch) e) WHERE k < n // 32 * 32"


@query("sample_shuffled_batches", _SHUFFLE)
def sample_shuffled_batches(spark, d):
    return sampling.shuffled_batches(table(spark, d, "embeddings"), "vec_id", 32, spark.range(2).withColumnRenamed("id", "epoch"), "shuffle")


@query("valid_prefix_batch", "SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings ORDER BY vec_id LIMIT 50")
def valid_prefix_batch(spark, d):
    return sampling.first_rows(table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label")), "vec_id", 50)


@query("example_subset", f"SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY {U('subset', 'vec_id')}, vec_id) AS k, count(*) OVER () AS n FROM embeddings) WHERE k <= floor(n * 0.3)")
def example_subset(spark, d):
    return sampling.subset(table(spark, d, "embeddings").select("vec_id"), "vec_id", 0.3, "subset").select("vec_id")


@query("kfold_split", "SELECT vec_id, ntile(3) OVER (ORDER BY vec_id) AS fold FROM embeddings")
def kfold_split(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    return sampling.folds(indexed(e, "vec_id", "i"), "i", F.lit(e.count()), 3).select("vec_id", "fold")


@query("random_holdout", f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {U('holdout', 'o_orderkey')}, o_orderkey) <= 1000 THEN 'valid' ELSE 'train' END AS split FROM orders")
def random_holdout(spark, d):
    return sampling.holdout(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000, "holdout")


@query("balanced_batch", f"SELECT label * 4 + s AS slot, label, vec_id FROM (SELECT CAST(label AS BIGINT) AS label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {U('balance', 'vec_id')}, vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings) CROSS JOIN (SELECT unnest(range(4)) AS s) WHERE k = (3 * 4 + s) % n")
def balanced_batch(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return sampling.balanced(e, "vec_id", "label", 42, 10, 3, "balance")


@query("priority_topk", "SELECT vec_id, p FROM (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) + 0.0 AS p FROM embeddings) ORDER BY p DESC, vec_id LIMIT 20")
def priority_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", r(F.col("embedding")[0].cast("double"), 4).alias("p"))
    return sampling.by_priority(e, "p", "vec_id", 20)


_PRIORITY = f"SELECT user_id, {R('avg(abs(value)) / (1 + 0.017 * count(*)) - 0.004 * (1000 - max(event_id % 1000))')} AS prio FROM events GROUP BY user_id"


@query("priority_update", _PRIORITY)
def priority_update(spark, d):
    seen = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.abs("value")).alias("nll"), F.count("*").alias("visits"), F.max(F.col("event_id") % 1000).alias("last"))
    return seen.select("user_id", r(sampling.updated_priority(F.col("nll"), F.col("visits"), F.lit(1000), F.col("last"))).alias("prio"))


@query("priority_update_stream", _PRIORITY)
def priority_update_stream(spark, d):
    stream = priority.priorities(priority.loss_stream(spark, f"{d}/events.parquet"), 1000)
    return priority.drained(stream, "priorities").select("user_id", r(F.col("prio")).alias("prio"))


@query("priority_kept_stream", _PRIORITY)
def priority_kept_stream(spark, d):
    """The same from states by example, of which a micro-batch touches those of its own events alone."""
    losses = priority.loss_stream(spark, f"{d}/events.parquet", "ts").select("user_id", (F.col("event_id") % 1000).alias("visit"), F.col("value").alias("loss"), "ts")
    return priority.kept_priorities(losses, "user_id", 1000).current().select("user_id", r(F.col("prio")).alias("prio"))


CDF = "prio AS (SELECT cube_id, count(*) FILTER (WHERE cls >= 0) AS prio FROM cls8 GROUP BY cube_id), cdf AS (SELECT cube_id, (sum(prio) OVER (ORDER BY cube_id) - prio) / sum(prio) OVER () AS lo, sum(prio) OVER (ORDER BY cube_id) / sum(prio) OVER () AS hi FROM prio)"


def cdf(spark, d):
    prio = voxel_classes(volumes(spark, d)).groupBy("cube_id").agg(F.count(F.when(F.col("cls") >= 0, 1)).alias("prio"))
    return sampling.priority_cdf(prio, "cube_id", "prio")


@query("cube_priority_cdf", with_views(f"SELECT cube_id, {R('lo')} AS lo, {R('hi')} AS hi FROM cdf", "cls8", more=CDF))
def cube_priority_cdf(spark, d):
    return cdf(spark, d).select("cube_id", r(F.col("lo")).alias("lo"), r(F.col("hi")).alias("hi"))


@query("weighted_cube_draw", with_views(f"SELECT draw, cube_id FROM (SELECT draw, {U('draw', 'draw')} AS u FROM (SELECT unnest(range(200)) AS draw)) JOIN cdf ON u >= lo AND u < hi", "cls8", more=CDF))
def weighted_cube_draw(spark, d):
    draws = spark.range(200).select(F.col("id").alias("draw"), uniform("draw", F.col("id")).alias("u"))
    return sampling.drawn_from(draws, cdf(spark, d)).select("draw", "cube_id")


@query("uniform_cube_draw", f"SELECT draw, CAST(floor({U('udraw', 'draw')} * (SELECT count(DISTINCT vec_id // 8) FROM embeddings)) AS BIGINT) AS cube_id FROM (SELECT unnest(range(200)) AS draw)")
def uniform_cube_draw(spark, d):
    n = table(spark, d, "embeddings").agg(F.countDistinct(F.expr("vec_id div 8")).alias("n"))
    return spark.range(200).crossJoin(F.broadcast(n)).select(F.col("id").alias("draw"), F.floor(uniform("udraw", F.col("id")) * F.col("n")).alias("cube_id"))


_CORNER = lambda seed, key, span: f"CAST(floor({U(seed, key)} * {span}) AS BIGINT)"


@query("cut_patches_2d", with_views(f"SELECT o.vec_id, x - ox AS x, y - oy AS y, value FROM (SELECT vec_id, {_CORNER('cutx', 'vec_id', 3)} AS ox, {_CORNER('cuty', 'vec_id', 3)} AS oy FROM embeddings) o JOIN img8 i USING (vec_id) WHERE x BETWEEN ox AND ox + 4 AND y BETWEEN oy AND oy + 4", "img8"))
def cut_patches_2d(spark, d):
    draws = sampling.patch_offsets(table(spark, d, "embeddings").select("vec_id"), {"x": (8, 5), "y": (8, 5)}, "cut", ["vec_id"])
    return sampling.cut(draws, images(spark, d).drop("label"), {"x": 5, "y": 5}, ["vec_id"])


@query("cut_patches_3d", with_views(f"SELECT o.cube_id, z - oz AS z, x - ox AS x, y - oy AS y, value, cls FROM (SELECT cube_id, {_CORNER('cut3z', 'cube_id', 4)} AS oz, {_CORNER('cut3x', 'cube_id', 4)} AS ox, {_CORNER('cut3y', 'cube_id', 4)} AS oy FROM (SELECT DISTINCT cube_id FROM vol8)) o JOIN cls8 v USING (cube_id) WHERE z BETWEEN oz AND oz + 3 AND x BETWEEN ox AND ox + 3 AND y BETWEEN oy AND oy + 3", "vol8", "cls8"))
def cut_patches_3d(spark, d):
    v = voxel_classes(volumes(spark, d))
    draws = sampling.patch_offsets(v.select("cube_id").distinct(), {a: (8, 4) for a in ("z", "x", "y")}, "cut3", ["cube_id"])
    return sampling.cut(draws, v, {a: 4 for a in ("z", "x", "y")}, ["cube_id"]).select("cube_id", "z", "x", "y", "value", "cls")


_BATCH = f"""o AS (SELECT draw, cube_id, {_CORNER('bz', 'draw', 4)} AS oz, {_CORNER('bx', 'draw', 4)} AS ox, {_CORNER('by', 'draw', 4)} AS oy FROM (SELECT draw, {U('bdraw', 'draw')} AS u FROM (SELECT unnest(range(60)) AS draw)) JOIN cdf ON u >= lo AND u < hi),
p AS (SELECT draw, cube_id, z - oz AS z, x - ox AS x, y - oy AS y, value, cls FROM o JOIN cls8 USING (cube_id) WHERE z BETWEEN oz AND oz + 3 AND x BETWEEN ox AND ox + 3 AND y BETWEEN oy AND oy + 3),
ok AS (SELECT draw FROM p GROUP BY draw HAVING avg(CASE WHEN cls < 0 THEN 1.0 ELSE 0.0 END) <= 0.1),
s AS (SELECT draw, row_number() OVER (ORDER BY draw) - 1 AS slot FROM ok)"""


@query("image_batch_pipeline", with_views(f"SELECT slot, cube_id, z, CASE WHEN {U('bflipx', 'draw')} < 0.5 THEN 3 - x ELSE x END AS x, y, {R('power(least(greatest((value + 0.5) * (1.0 + 0.3 * (' + U('bgreya', 'draw') + ' - 0.5)) + 0.3 * (' + U('bgreyc', 'draw') + ' - 0.5), 0.0), 1.0), power(2.0, 2.0 * ' + U('bgreyg', 'draw') + ' - 1.0))', 4)} AS value, cls FROM p JOIN s USING (draw) WHERE slot < 16", "cls8", more=CDF + ", " + _BATCH))
def image_batch_pipeline(spark, d):
    v = voxel_classes(volumes(spark, d))
    shares, n = cdf(spark, d), 60
    while True:
        draws = spark.range(n).select(F.col("id").alias("draw"), uniform("bdraw", F.col("id")).alias("u"))
        chosen = sampling.drawn_from(draws, shares).select("draw", "cube_id")
        corners = sampling.patch_offsets(chosen, {a: (8, 4) for a in ("z", "x", "y")}, "b", ["draw"])
        patches = sampling.cut(corners, v, {a: 4 for a in ("z", "x", "y")}, ["cube_id"])
        ok = patches.groupBy("draw").agg(F.avg((F.col("cls") < 0).cast("double")).alias("share")).where("share <= 0.1")
        slots = written(indexed(ok.select("draw"), "draw", "slot").where("slot < 16"), "slots")
        if (found := slots.count()) == 16:  # draws keep their numbers, so more of them only fill the rest of the batch
            break
        if not found and n > 10_000:
            raise ValueError(f"{n} draws gave no patch with enough labels")
        n *= 4
    met = patches.join(F.broadcast(slots), "draw")  # 16 rows
    x = F.when(uniform("bflipx", F.col("draw")) < 0.5, 3 - F.col("x")).otherwise(F.col("x"))
    return met.select("slot", "cube_id", "z", x.alias("x"), "y", r(augment.grey(F.col("value") + 0.5, "bgrey", F.col("draw")), 4).alias("value"), "cls")


@query("sequence_windows", f"WITH q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events), s AS (SELECT user_id, CAST(floor({U('seq', 'user_id')} * (count(*) - 20 - 1) + 0.5) AS BIGINT) AS s FROM events GROUP BY user_id HAVING count(*) > 20) SELECT user_id, t - s AS k, value, target FROM q JOIN s USING (user_id) WHERE t >= s AND t < s + 20")
def sequence_windows(spark, d):
    return sampling.sequence_windows(sequences(spark, d), "user_id", 20, "seq")


@query("lazy_mask_attach", f"WITH i AS (SELECT cube_id, cls, CAST({U('lab', 'cube_id', 'cls')} < 0.8 AS BIGINT) AS labeled, CAST({U('np', 'cube_id', 'cls')} < 0.1 AS BIGINT) AS not_present FROM (SELECT DISTINCT vec_id // 8 AS cube_id FROM embeddings) CROSS JOIN (SELECT unnest(range(2)) AS cls)) SELECT vec_id, cls, labeled, not_present FROM embeddings JOIN i ON vec_id // 8 = cube_id")
def lazy_mask_attach(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 8").alias("cube_id"))
    return e.join(cube_info(spark, d), "cube_id").select("vec_id", "cls", "labeled", "not_present")
