"""Sources, sinks and reshaping."""

from pyspark.sql import functions as F

from ..functions.keyed import rounded as r
from ..functions.keyed import sql_rounded as R
from ..functions.keyed import sql_uniform as U
from ..functions.keyed import uniform
from ..operators import reshape
from ..operators.layers import flattened
from ..registry import query
from ..sources.tables import images, indexed, table, training_log, voxel_classes, volumes, with_views, written


@query("scan_projection", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 25")
def scan_projection(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 25").select("l_orderkey", "l_quantity")


@query("sink_roundtrip", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def sink_roundtrip(spark, d):
    back = written(table(spark, d, "nation"), "nation", compression="lz4")
    return back.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query("scan_cube_label_join", with_views("SELECT cube_id, z, x, y, value, cls FROM cls8", "cls8"))
def scan_cube_label_join(spark, d):
    v = volumes(spark, d)
    return v.join(voxel_classes(v).drop("value"), ["cube_id", "z", "x", "y"])


@query("scan_mixed_table", "SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer")
def scan_mixed_table(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal")


@query("log_roundtrip", with_views("SELECT i, nll FROM train_log", "train_log"))
def log_roundtrip(spark, d):
    log = training_log(spark, d).select("i", "nll")
    path = written(log.where("i % 2 = 0"), "log").inputFiles()[0].rpartition("/")[0]
    return written(log.where("i % 2 = 1"), "log", mode="append", path=path)


@query("log_schema_upgrade", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, event_id, value FROM events")
def log_schema_upgrade(spark, d):
    return indexed(table(spark, d, "events").select("event_id", "value"), "event_id", "i").select("i", "event_id", "value")


@query("natural_sort", "SELECT c_custkey, string_agg(CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END, '' ORDER BY k) AS sort_key FROM (SELECT c_custkey, unnest(regexp_extract_all(c_name, '([0-9]+|[^0-9]+)')) AS p, generate_subscripts(regexp_extract_all(c_name, '([0-9]+|[^0-9]+)'), 1) AS k FROM customer) GROUP BY c_custkey")
def natural_sort(spark, d):
    return table(spark, d, "customer").select("c_custkey", reshape.natural_key(F.col("c_name")).alias("sort_key")).orderBy("sort_key")


@query("scale_uint8", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {R('CAST(l_quantity AS BIGINT) / 255.0')} AS scaled FROM lineitem")
def scale_uint8(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("scaled"))
    return reshape.scaled(li, "scaled").withColumn("scaled", r(F.col("scaled")))


@query("label_range_check", "SELECT CAST(max(label) AS BIGINT) AS max_label, max(label) <= 32767 AS fits FROM embeddings")
def label_range_check(spark, d):
    return reshape.class_range(table(spark, d, "embeddings"), "label")


@query("infer_n_lab", "SELECT count(DISTINCT label) AS n_lab FROM embeddings")
def infer_n_lab(spark, d):
    return table(spark, d, "embeddings").agg(F.countDistinct("label").alias("n_lab"))


@query("center_by_split", with_views(f"SELECT vec_id, x, y, {R('value - avg(value) OVER (PARTITION BY vec_id % 3)')} AS value FROM img8", "img8"))
def center_by_split(spark, d):
    split = images(spark, d).withColumn("split", F.col("vec_id") % 3)
    return reshape.centred(split, "value", "split").select("vec_id", "x", "y", r(F.col("value")).alias("value"))


@query("vector_to_image", with_views("SELECT vec_id, x, y, value FROM img8", "img8"))
def vector_to_image(spark, d):
    return images(spark, d).select("vec_id", "x", "y", "value")


@query("target_log_scale", f"SELECT o_orderkey, {R('log10(o_totalprice / max(o_totalprice) OVER () * 9999.0 + 1.0)')} AS target FROM orders")
def target_log_scale(spark, d):
    return reshape.log_scaled(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "target").select("o_orderkey", r(F.col("target")).alias("target"))


@query("standardise_cubes", with_views(f"SELECT cube_id, z, x, y, {R('(value - m) / s')} AS value FROM vol8 CROSS JOIN (SELECT avg(a) AS m, avg(b) AS s FROM (SELECT avg(value) AS a, stddev_pop(value) AS b FROM vol8 GROUP BY cube_id))", "vol8"))
def standardise_cubes(spark, d):
    return reshape.standardised(volumes(spark, d), "value", "cube_id").withColumn("value", r(F.col("value")))


@query("normalise_mixed", f"SELECT c_custkey, {R('(dense_rank() OVER (ORDER BY c_mktsegment) - 1) / (SELECT count(DISTINCT c_mktsegment) - 1 FROM customer)')} AS segment, {R('c_acctbal / max(c_acctbal) OVER ()')} AS balance FROM customer")
def normalise_mixed(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    both = reshape.max_scaled(reshape.rank_scaled(c, "c_mktsegment", "segment"), "c_acctbal", "balance")
    return both.select("c_custkey", r(F.col("segment")).alias("segment"), r(F.col("balance")).alias("balance"))


@query("strip_border", with_views("SELECT vec_id, x - 1 AS x, y - 1 AS y, value FROM img8 WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6", "img8"))
def strip_border(spark, d):
    return reshape.stripped(images(spark, d), 1, 8).select("vec_id", "x", "y", "value")


@query("strip_cubes", with_views("SELECT cube_id, z, x, y, value, CASE WHEN z BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN cls ELSE 0 END AS cls FROM cls8", "cls8"))
def strip_cubes(spark, d):
    v = volumes(spark, d)
    inner = reshape.stripped(voxel_classes(v).drop("value"), 1, 8, ("z", "x", "y"))
    return reshape.strip_cubes(v, inner, 8, 6, 1).select("cube_id", "z", "x", "y", "value", "cls")


@query("border_crop", with_views("SELECT vec_id, x - 1 AS x, y - 1 AS y, value FROM img8 WHERE x BETWEEN 1 AND 5 AND y BETWEEN 1 AND 5", "img8"))
def border_crop(spark, d):
    return reshape.border_cropped(images(spark, d), 8, 5).select("vec_id", "x", "y", "value")


_GRID11 = "g AS (SELECT tx, ty, tx - 2 AS x, ty - 2 AS y FROM (SELECT unnest(range(11)) AS tx) CROSS JOIN (SELECT unnest(range(11)) AS ty)), ids AS (SELECT DISTINCT vec_id FROM img8)"


@query("border_zero_pad", with_views("SELECT i.vec_id, tx AS x, ty AS y, coalesce(m.value, 0.0) AS value FROM ids i CROSS JOIN g LEFT JOIN img8 m ON m.vec_id = i.vec_id AND m.x = g.x AND m.y = g.y", "img8", more=_GRID11))
def border_zero_pad(spark, d):
    return reshape.border_padded(images(spark, d), "vec_id", 8, 11)


@query("border_mirror", with_views("SELECT m.vec_id, tx AS x, ty AS y, m.value FROM g JOIN img8 m ON m.x = CASE WHEN g.x < 0 THEN -g.x - 1 WHEN g.x >= 8 THEN 15 - g.x ELSE g.x END AND m.y = CASE WHEN g.y < 0 THEN -g.y - 1 WHEN g.y >= 8 THEN 15 - g.y ELSE g.y END", "img8", more=_GRID11))
def border_mirror(spark, d):
    return reshape.border_padded(images(spark, d), "vec_id", 8, 11, mirror=True)


@query("downsample_xy", with_views(f"SELECT cube_id, z, x // 3 AS x, y // 3 AS y, {R('avg(value)')} AS value, CAST(floor(sum(cls) / 9.0) AS BIGINT) AS cls FROM cls8 WHERE x < 6 AND y < 6 GROUP BY ALL", "cls8"))
def downsample_xy(spark, d):
    return reshape.downsampled(voxel_classes(volumes(spark, d)), 3, 8).withColumn("value", r(F.col("value")))


@query("strided_labels", with_views("SELECT cube_id, z, x // 2 AS x, y // 2 AS y, cls FROM cls8 WHERE x % 2 = 0 AND y % 2 = 0", "cls8"))
def strided_labels(spark, d):
    return reshape.strided(voxel_classes(volumes(spark, d)), {"x": 2, "y": 2}).select("cube_id", "z", "x", "y", "cls")


@query("transpose_axes", with_views("SELECT cube_id, x AS z, y AS x, z AS y, value FROM vol8", "vol8"))
def transpose_axes(spark, d):
    return reshape.transposed(volumes(spark, d), {"z": "x", "x": "y", "y": "z"}).select("cube_id", "z", "x", "y", "value")


_SHAPES = "shapes AS (SELECT cube_id, 8 AS s0, 4 + cube_id % 8 AS s1, 3 + cube_id % 11 AS s2 FROM (SELECT DISTINCT vec_id // 8 AS cube_id FROM embeddings))"


@query("valid_transposes", f"WITH {_SHAPES} SELECT cube_id, CAST(t AS BIGINT) AS t FROM (SELECT cube_id, 0 AS t, s0 AS a, s1 AS b FROM shapes UNION ALL SELECT cube_id, 1, s2, s0 FROM shapes UNION ALL SELECT cube_id, 2, s1, s2 FROM shapes) WHERE a >= 6 AND b >= 5")
def valid_transposes(spark, d):
    cubes = table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("cube_id")).distinct()
    shapes = cubes.select("cube_id", F.lit(8).cast("long").alias("s0"), (4 + F.col("cube_id") % 8).alias("s1"), (3 + F.col("cube_id") % 11).alias("s2"))
    return reshape.valid_transposes(spark, shapes, (6, 5)).select("cube_id", "t")


@query("ignore_threshold_filter", with_views(f"SELECT s.cube_id, {R('share')} AS share FROM (SELECT cube_id, avg(CASE WHEN cls < 0 THEN 1.0 ELSE 0.0 END) AS share FROM cls8 GROUP BY cube_id) s WHERE share <= 0.04 OR cube_id % 10 = 3", "cls8"))
def ignore_threshold_filter(spark, d):
    v = voxel_classes(volumes(spark, d))
    known = v.select("cube_id").distinct().withColumn("not_present", (F.col("cube_id") % 10 == 3).cast("int"))
    return reshape.enough_labelled(v, "cube_id", 0.04, known).withColumn("share", r(F.col("share")))


@query("flatten_features", with_views("SELECT vec_id, list(value ORDER BY x, y)[3] AS third, len(list(value ORDER BY x, y)) AS n FROM img8 GROUP BY vec_id", "img8"))
def flatten_features(spark, d):
    return flattened(images(spark, d), "vec_id", ["x", "y"]).select("vec_id", F.element_at("features", 3).alias("third"), F.size("features").cast("long").alias("n"))


_KEPT = f"kept AS (SELECT i FROM (SELECT i, row_number() OVER (ORDER BY {U('features', 'i')}, i) AS r FROM (SELECT unnest(range(64)) AS i)) WHERE r <= 16)"


@query("feature_subset", with_views("SELECT vec_id, i, value FROM (SELECT vec_id, x * 8 + y AS i, value FROM img8) JOIN kept USING (i)", "img8", more=_KEPT))
def feature_subset(spark, d):
    long = images(spark, d).select("vec_id", (F.col("x") * 8 + F.col("y")).alias("i"), "value")
    return reshape.feature_subset(long, 0.25, 64, lambda i: uniform("features", i)).select("vec_id", "i", "value")


@query("quantise_uint8", with_views("SELECT vec_id, x, y, CAST(floor(least(greatest(value + 0.5, 0.0), 1.0) * 255.0) AS BIGINT) AS q FROM img8", "img8"))
def quantise_uint8(spark, d):
    p = F.least(F.greatest(F.col("value") + 0.5, F.lit(0.0)), F.lit(1.0))
    return images(spark, d).select("vec_id", "x", "y", reshape.quantised(p).alias("q"))


@query("mosaic_layout", with_views(f"SELECT CAST((vec_id // a) * 9 + x AS BIGINT) AS row, CAST((vec_id % a) * 9 + y AS BIGINT) AS col, {R('(value - lo) / (hi - lo)')} AS value FROM img8 JOIN (SELECT vec_id, min(value) AS lo, max(value) + 1e-8 AS hi FROM img8 GROUP BY vec_id) USING (vec_id) CROSS JOIN (SELECT CAST(floor(sqrt(count(*) * 1.7)) AS BIGINT) AS a FROM embeddings)", "img8"))
def mosaic_layout(spark, d):
    n = table(spark, d, "embeddings").count()
    return reshape.mosaic(images(spark, d), "vec_id", F.lit(n), 8, 1, 1.7).withColumn("value", r(F.col("value")))
