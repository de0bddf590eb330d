"""Tables, the array views made from them, and round trips through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    if not path and not _local:
        _local.append(tempfile.mkdtemp(prefix="cubeloom-"))
    return (path or _local[0]).rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def written(df: DataFrame, label: str, mode: str = "errorifexists", path: str | None = None, by: str | None = None, **options: str) -> DataFrame:
    """df written as Parquet (in folders by a column) and read back: the sink, and the way to cut a long lineage."""
    path = path or f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as 8x8 images, one row a pixel: vec_id, label, x, y, value."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("p", "v"))
    return e.select("vec_id", "label", F.expr("p div 8").alias("x"), (F.col("p") % 8).cast("long").alias("y"), (F.round(F.col("v").cast("double"), 4) + 0.0).alias("value"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight consecutive images as a cube: cube_id, z, x, y, value."""
    return images(spark, sf_dir).select(F.expr("vec_id div 8").alias("cube_id"), (F.col("vec_id") % 8).alias("z"), "x", "y", "value")


def voxel_classes(volume: DataFrame) -> DataFrame:
    """cls: 1 for positive values, 0 for others, -1 (unlabelled) near zero."""
    return volume.withColumn("cls", F.when(F.abs("value") < 0.01, -1).when(F.col("value") > 0, 1).otherwise(0).cast("long"))


def voxel_segments(volume: DataFrame) -> DataFrame:
    """seg: 0 outside, else a number by quadrant."""
    return volume.withColumn("seg", F.when(F.col("value") <= 0, F.lit(0)).otherwise(F.expr("1 + (x div 4) * 2 + y div 4")).cast("long"))


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss for each event: i (from 0 in order of event_id), user_id, event_id, t, nll."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.abs("value") / 100.0).alias("nll"))
    return indexed(e, "event_id", "i")


#: Rows that one task numbers or sums up in order; how many quantiles are looked for at most.
RANGE_ROWS, QUANTILES = 1_000_000, 256


def task_parts(spark: SparkSession, rows: int) -> int:
    """Partitions of so many rows: those of the session, and more where a task would get more than RANGE_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges(rows))


def indexed(df: DataFrame, key: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with name, the rows' number from 0 in order of a unique numeric key.

    Rows are dealt by key ranges of about range_rows; a row's number is its place in its range after the totals of the ranges before.
    """
    dealt = _dealt(df, key, range_rows)
    totals = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = totals.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key)).cast("long") - 1
    return dealt.withColumn("__place", place).join(before, "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__before", "__place")


def running_sum(df: DataFrame, key: str, value: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with name, the sum of value up to each row in order of a unique numeric key, dealt by ranges as in indexed."""
    dealt = _dealt(df, key, range_rows)
    totals = dealt.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = totals.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(key)), F.lit(0))
    return dealt.withColumn("__inside", inside).join(before, "__range").withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")


def ranges(n: int, range_rows: int = RANGE_ROWS) -> int:
    """How many ranges n rows are dealt to."""
    return max(1, -(-n // range_rows))


def _dealt(df: DataFrame, key: str, range_rows: int) -> DataFrame:
    """df with __range, a row's range of the key: quantiles (found as constants, so a second scan deals alike), each cut into equal widths where more are wanted."""
    n = ranges(df.count(), range_rows)
    if n == 1:
        return df.withColumn("__range", F.lit(0))
    parts = min(n, QUANTILES)
    cuts = sorted(set(df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.1 / parts)))

    def place(lo: int, hi: int) -> Column:
        """How many of cuts[lo:hi] are at most the key, after lo: a search tree of conditions."""
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(F.col(key) < cuts[middle], place(lo, middle)).otherwise(place(middle + 1, hi))

    width = -(-n // parts)
    if width == 1:
        return df.withColumn("__range", place(0, len(cuts)))
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    edges = F.array(*(F.lit(float(c)) for c in (ends["lo"], *cuts, ends["hi"])))
    out = df.withColumn("__q", place(0, len(cuts)))
    share = (F.col(key) - edges[F.col("__q")]) / F.nullif(edges[F.col("__q") + 1] - edges[F.col("__q")], F.lit(0.0))
    sub = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * width), F.lit(width - 1))
    return out.withColumn("__range", F.col("__q") * width + sub).drop("__q")


#: The views' SQL twins, as common table expressions.
SQL = {
    "img8": "img8 AS MATERIALIZED (SELECT vec_id, CAST(label AS BIGINT) AS label, p // 8 AS x, p % 8 AS y, round(CAST(embedding[p + 1] AS DOUBLE), 4) + 0.0 AS value FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS p))",
    "vol8": "vol8 AS (SELECT vec_id // 8 AS cube_id, vec_id % 8 AS z, x, y, value FROM img8)",
    "cls8": "cls8 AS (SELECT *, CAST(CASE WHEN abs(value) < 0.01 THEN -1 WHEN value > 0 THEN 1 ELSE 0 END AS BIGINT) AS cls FROM vol8)",
    "seg8": "seg8 AS (SELECT *, CAST(CASE WHEN value <= 0 THEN 0 ELSE 1 + (x // 4) * 2 + y // 4 END AS BIGINT) AS seg FROM vol8)",
    "train_log": "train_log AS (SELECT user_id, event_id, abs(value) / 100.0 AS nll, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)",
}


def with_views(body: str, *names: str, more: str = "") -> str:
    """body after the views it names (and those they need)."""
    needs = {"vol8": ("img8",), "cls8": ("img8", "vol8"), "seg8": ("img8", "vol8")}
    order: list[str] = []
    for n in names:
        order += [x for x in (*needs.get(n, ()), n) if x not in order]
    ctes = [SQL[n] for n in order] + ([more] if more else [])
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
