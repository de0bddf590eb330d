"""Arrays read slab by slab, logs of older layouts, and priorities kept by a stream in many micro-batches."""

import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cubeloom.operators.sampling import updated_priority
from cubeloom.sources import logs, slabs
from cubeloom.streaming import priority


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    arrays = {"a": rng.normal(size=(7, 3, 4)), "b": rng.integers(0, 9, (5, 6)).astype(np.int16), "c": rng.normal(size=9).astype(np.float32), "d": np.asfortranarray(rng.normal(size=(4, 2, 3)))}
    np.save(tmp_path / "a.npy", arrays["a"])
    np.save(tmp_path / "d.npy", arrays["d"])
    np.savez(tmp_path / "plain.npz", b=arrays["b"], e=arrays["d"])
    np.savez_compressed(tmp_path / "packed.npz", c=arrays["c"])
    return tmp_path, arrays | {"e": arrays["d"]}


@pytest.mark.parametrize("slab", [1, 2, 100])
def test_slabs_are_the_arrays(spark, folder, monkeypatch, slab):
    monkeypatch.setattr(slabs, "PARTITION_BYTES", 100)
    path, arrays = folder
    found = slabs.slabs(spark, str(path), slab).collect()
    for name, a in arrays.items():
        rows = sorted((r for r in found if r["name"] == name), key=lambda r: r["z"])
        assert [r["z"] for r in rows] == list(range(0, len(a), slab)) and sum(r["nz"] for r in rows) == len(a)
        assert all(r["shape"] == list(a.shape) and len(r["values"]) == r["nz"] * r["nx"] * r["ny"] for r in rows)
        assert np.allclose(np.concatenate([r["values"] for r in rows]), np.ascontiguousarray(a).ravel())


@pytest.mark.parametrize(("condition", "slab", "lo", "hi"), [("z >= 3", 1, 3, 7), ("z = 2", 1, 2, 3), ("z > 1 and z < 5", 2, 2, 5), ("z <= 4", 2, 0, 5), ("z > 90", 1, 91, 7), ("z < 4", 3, 0, 4)])
def test_filters_reach_the_files(spark, folder, condition, slab, lo, hi):
    path, arrays = folder
    df = slabs.slabs(spark, f"{path}/a.npy", slab).where(condition)
    assert sorted(r["z"] for r in df.collect()) == [z for z in range(0, 7, slab) if lo <= z < hi]
    reader = slabs.SlabReader({"path": f"{path}/a.npy", "slab": str(slab)})
    ops = {">=": slabs.GreaterThanOrEqual, "=": slabs.EqualTo, ">": slabs.GreaterThan, "<": slabs.LessThan, "<=": slabs.LessThanOrEqual}
    list(reader.pushFilters([ops[c.split()[1]](("z",), int(c.split()[2])) for c in condition.split(" and ")]))
    read = [z for p in reader.partitions() for b in reader.read(p) for z in b.column(2).to_pylist()]
    assert set(read) >= {z for z in range(0, 7, slab) if lo <= z < hi} and len(read) <= len(range(0, 7, slab)) and (lo >= 3 or condition != "z >= 3" or len(read) == 4)


def test_a_folder_without_arrays(spark, tmp_path):
    assert slabs.slabs(spark, str(tmp_path)).count() == 0


def test_logs_of_three_kinds_and_two_layouts(spark, tmp_path):
    rng = np.random.default_rng(2)
    widths = {"timeline": 5, "history": 7, "errors": 4}
    made = {(run, kind): rng.normal(size=(n, w - old)).round(3) for kind, w in widths.items() for run, n, old in (("new", 6, 0), ("old", 4, 1))}
    for (run, kind), a in made.items():
        a[:, 0] = np.arange(len(a)) * 10 if run == "new" else a[:, 0]
        np.save(tmp_path / f"{run}.{'ErrorTimeline' if (run, kind) == ('old', 'errors') else kind}.npy", a)
    for kind, names in logs.COLUMNS.items():
        found = logs.read_logs(spark, str(tmp_path), kind).orderBy("run", "row").collect()
        assert len(found) == 10
        for r in found:
            a = made[r["run"], kind][r["row"]]
            assert r["step"] == (r["row"] if r["run"] == "old" else a[0]) and np.allclose([r[n] for n in names[1:]], a if r["run"] == "old" else a[1:])
    np.save(tmp_path / "odd.errors.npy", np.zeros((2, 9)))
    with pytest.raises(PySparkException, match="odd.errors.npy: rows of 9"):
        logs.read_logs(spark, str(tmp_path), "errors").collect()
    with pytest.raises(ValueError, match="kind"):
        logs.read_logs(spark, str(tmp_path), "weights")


START = datetime.datetime(2024, 1, 1)


def losses_in_files(spark, path, n_files, rows):
    """Files of rows (user_id, visit, loss, minutes) as a stream, one a micro-batch."""
    for k in range(n_files):
        some = [(u, v, x, START + datetime.timedelta(minutes=m)) for i, (u, v, x, m) in enumerate(rows) if i * n_files // len(rows) == k]
        spark.createDataFrame(some, "user_id long, visit long, loss double, ts timestamp").coalesce(1).write.parquet(f"{path}/f{k:02}")
    schema = spark.read.parquet(f"{path}/f00").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_many_small_batches_are_one_large_one(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(12)) if i % 3 else 7, i, float(rng.normal()), i) for i in range(120)]
    changes = priority.kept_priorities(losses_in_files(spark, tmp_path, 6, rows), "user_id", 200, fold=4)
    got = {r["user_id"]: r["prio"] for r in changes.current().collect()}
    for u in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == u]
        assert np.isclose(got[u], updated_priority(np.mean([abs(r[2]) for r in own]), len(own), 200, max(r[1] for r in own)))
    assert len(got) == len({r[0] for r in rows}) and changes.folded == 3 and changes.batches == [4, 5]
    last = spark.read.parquet(f"{changes.path}/changes-5")
    assert {r["user_id"] for r in last.collect()} == {r[0] for r in rows[100:]} and last.count() == len({r[0] for r in rows[100:]})


def test_examples_without_visits_are_forgotten(spark, tmp_path):
    rows = [(1, 0, 1.0, 0), (2, 1, 1.0, 0), (2, 2, 1.0, 50), (3, 3, 1.0, 60), (3, 4, 1.0, 130), (2, 5, 3.0, 131)]
    changes = priority.kept_priorities(losses_in_files(spark, tmp_path, 6, rows), "user_id", 10, forget="60 minutes")
    got = {r["user_id"]: r["prio"] for r in changes.current().collect()}
    assert 1 not in got and {2, 3} <= got.keys()
    assert np.isclose(got[2], updated_priority(3.0, 1, 10, 5))  # it came back, with nothing remembered
    assert {r["user_id"] for r in changes.latest().where(~F.col("live")).collect()} == {1}


def test_long_sequences_carry_their_state_along(spark):
    from cubeloom.operators import layers

    rng = np.random.default_rng(4)
    w_in, w_hid, bias, start = rng.normal(size=(2, 3)), rng.normal(size=(3, 3)) * 0.3, [0.1, 0.0, -0.1], [0.0, 0.2, 0.0]
    values = rng.normal(size=(40_000, 2))
    rows = spark.range(40_000).select(F.when(F.col("id") % 20 == 0, F.col("id") % 7).otherwise(99).alias("k"), F.col("id").alias("t"), F.col("id").alias("i"))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values.tolist())], "i long, value array<double>")
    df = rows.join(table, "i").repartition(11).unionByName(spark.createDataFrame([(None, 1, 0, [1.0, None])], "k long, t long, i long, value array<double>"))
    got = {r["k"]: (r["h"], r["steps"]) for r in layers.recurrent_streamed(df, "k", w_in.tolist(), w_hid.tolist(), bias, start, 3).collect()}
    expected, n = {}, {}
    for i in range(40_000):
        k = i % 7 if i % 20 == 0 else 99
        expected[k] = np.tanh(values[i] @ w_in + expected.get(k, np.array(start)) @ w_hid + bias)
        n[k] = n.get(k, 0) + 1
    expected[None], n[None] = np.tanh(np.array([1.0, 0.0]) @ w_in + np.array(start) @ w_hid + bias), 1
    assert got.keys() == expected.keys() and all(np.allclose(got[k][0], h) and got[k][1] == n[k] for k, h in expected.items())
    assert layers.recurrent_streamed(df.limit(0), "k", w_in.tolist(), w_hid.tolist(), bias, start).count() == 0
