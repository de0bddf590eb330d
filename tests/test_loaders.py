"""Loaders, sources of one's own, refused plans and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from cubeloom.__main__ import main
from cubeloom.plans import settings, trainer
from cubeloom.plans.network import Network, NetworkConfig
from cubeloom.sources import loaders

DATA = "/root/testdata/sf0.001"


def test_cubes_are_checked(spark):
    v = spark.range(8).select(F.lit(1).cast("long").alias("cube_id"), *((F.col("id").bitwiseAND(1 << k) / (1 << k)).cast("long").alias(a) for k, a in enumerate("zxy")), (F.col("id") * 30).alias("value"))
    label = v.select("cube_id", "z", "x", "y", F.lit(40_000).alias("cls"))
    with pytest.raises(ValueError, match="16 bits"):
        loaders.read_cubes(v, label, 2, 2, 0)
    got = loaders.read_cubes(v, label.limit(0), 2, 2, 0).collect()
    assert {r["cls"] for r in got} == {0} and max(r["value"] for r in got) == 210 / 255
    whole, n_lab, prio = loaders.cube_set(loaders.read_cubes(v, label.withColumn("cls", F.lit(3)), 2, 2, 0), 2, 2, [])
    assert n_lab == 4 and prio.first()["prio"] == 8 and abs(whole.agg(F.avg("value")).first()[0]) < 1e-9


def test_sources_of_ones_own(spark):
    loaders.register_source("bad", (1,), 2)(lambda s, p: s.range(3))
    with pytest.raises(ValueError, match="features"):
        loaders.source("bad", spark, "")
    with pytest.raises(KeyError, match="no source"):
        loaders.source("none", spark, "")


def test_a_split_reads_its_folder(spark):
    df = loaders.saved_by_split(loaders.keyed_split(spark.range(1000), "id", 0.3, "s"), "split-test")
    valid = df.where("split = 'valid'")
    assert 200 < valid.count() < 400 and "PartitionFilters: [isnotnull(split" in valid._jdf.queryExecution().toString()


def test_arrays_as_cubes(spark):
    df = spark.createDataFrame([(1, [float(v) for v in range(12)], list(range(12))), (2, [0.5] * 12, None), (3, None, None)], "id long, data array<double>, lab array<int>")
    got = loaders.cubes_of_arrays(df, "id", (2, 3, 2), label="lab").collect()
    assert sorted((r["z"] * 6 + r["x"] * 2 + r["y"], r["value"], r["cls"]) for r in got if r["cube_id"] == 1) == [(k, float(k), k) for k in range(12)]
    assert {(r["z"], r["x"], r["y"]) for r in got if r["cube_id"] == 2} == {(z, x, y) for z in range(2) for x in range(3) for y in range(2)} and {r["cls"] for r in got if r["cube_id"] == 2} == {0}
    assert {r["cls"] for r in loaders.cubes_of_arrays(df, "id", (2, 3, 2)).collect()} == {0} and loaders.cubes_of_arrays(df.limit(0), "id", (2, 3, 2)).collect() == []
    with pytest.raises(Exception, match="has not 8 values"):
        loaders.cubes_of_arrays(df, "id", (2, 2, 2)).collect()


def test_a_schedule_sets_rates(spark):
    net = trainer.built(NetworkConfig(mode="vect-scalar", n_lab=2, side=1, channels=2, mlp=[2]))
    e = spark.createDataFrame([(1, [0.0, 1.0], 1)], "key long, features array<double>, label long")
    t = trainer.Trainer(net, e, rate=1.0, decay=0.5, decay_every=10, schedule={25: 8.0, 12: 4.0})
    rates = []
    for t.steps in (0, 9, 10, 11, 12, 19, 20, 24, 25, 30):
        rates.append(t.rate)
    assert rates == [1, 1, 0.5, 0.5, 4, 4, 2, 2, 8, 4]
    assert trainer.Trainer.of(net, e, settings.TrainingSettings.parsed({"schedule": [[3, 0.5]]})).schedule == {3: 0.5}


def test_folds_of_a_table(spark):
    df = spark.createDataFrame([(10 * i, float(i), 2 * i, 99.0) for i in range(1, 9)], "id long, a double, b long, key double")
    sets = [loaders.fold_set(df, "id", ["a", "b"], "b", 3, k).collect() for k in range(3)]
    assert [sorted(r["key"] for r in s if r["split"] == "valid") for s in sets] == [[10, 20, 30], [40, 50, 60], [70, 80]]
    assert all(r["features"] == [r["key"] / 10, r["key"] / 5] and r["label"] == [r["key"] / 5] for r in sets[0])
    assert loaders.fold_set(df, "id", ["a"], "b", log_target=True).where("key = 80").first()["label"] == [4.0]
    assert loaders.fold_set(df.limit(0), "id", ["a"], "b").collect() == []
    with pytest.raises(ValueError, match="use_fold"):
        loaders.fold_set(df, "id", ["a"], "b", 3, 3)


def test_sequences_in_three_sets(spark):
    lengths = {k: 3 + 7 * (k % 5) for k in range(200)}  # 3, 10, 17, 24, 31
    frames = spark.createDataFrame([(k, t, [float(k), float(t)]) for k, n in lengths.items() for t in range(n)], "song long, t long, notes array<double>")
    sets = loaders.sequence_set(frames, "song", 0.2, 0.2, "s")
    of = {r["song"]: r["split"] for r in sets.select("song", "split").distinct().collect()}
    assert len(of) == 200 and {s: 20 < list(of.values()).count(s) < 60 for s in ("valid", "test")} == {"valid": True, "test": True}
    seen = []
    for batch in range(100):
        rows = loaders.sequence_batch(sets, "song", "train", 32, 10, 0, batch, "b").collect()
        if not rows:
            break
        songs = {r["song"] for r in rows}
        seen += songs
        assert len(songs) == 32 and len(rows) == 32 * 11 and {r["slot"] for r in rows} == set(range(32))
        for s in songs:
            window = sorted((r["k"], r["notes"]) for r in rows if r["song"] == s)
            assert [k for k, _ in window] == list(range(11)) and all(n[0] == s and n[1] == window[0][1][1] + k for k, n in window) and window[-1][1][1] < lengths[s]
    fit = [k for k, n in lengths.items() if n > 10 and of[k] == "train"]
    assert len(seen) == len(set(seen)) == len(fit) // 32 * 32 and set(seen) <= set(fit)
    first = {r["song"] for r in loaders.sequence_batch(sets, "song", "valid", 5, 10, 0, 0, "b").collect()}
    assert sorted(first) == sorted(k for k, n in lengths.items() if n > 10 and of[k] == "valid")[:5]
    assert loaders.sequence_batch(sets.limit(0), "song", "test", 5, 10, 0, 0, "b").collect() == []


@pytest.mark.parametrize("values", [{"mode": "img-img"}, {"mode": "vect-scalar", "rnn": 3}, {"mlp": [3], "dropout": [0.5]}, {"mlp": [3], "target": "regression"}])
def test_relational_networks_refuse_what_they_lack(spark, values):
    with pytest.raises(ValueError, match="trainer.built"):
        Network(spark, NetworkConfig(**values))


def test_command_line(spark, tmp_path, capsys):
    main(["list"])
    assert "load_cubes" in capsys.readouterr().out
    main(["query", "scan_projection", DATA, "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    (tmp_path / "net.json").write_text(json.dumps({"mode": "img-scalar", "mlp": [4]}))
    main(["train", str(tmp_path / "net.json"), "embedding-digits", DATA, "--steps", "2", "--save", str(tmp_path / "w")])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 64 * 4 + 4 + 4 * 10 + 10
    with pytest.raises(SystemExit):
        main(["query", "nothing", DATA])


def test_settings_of_a_file_over_defaults(tmp_path):
    file = lambda name, values: (tmp_path / name).write_text(json.dumps(values)) and str(tmp_path / name)
    defaults = file("defaults.json", {"network": {"n_lab": 3, "side": 4}, "training": {"rate": 1, "steps": 7}})
    own = file("own.json", {"network": {"mode": "vect-scalar", "mlp": [5], "side": 2}, "training": {"steps": 2}})
    network, training = settings.read_settings(own, defaults)
    assert network == {"mode": "vect-scalar", "mlp": [5], "side": 2, "n_lab": 3} and training == {"rate": 1, "steps": 2}
    assert settings.TrainingSettings.parsed(training).rate == 1 and NetworkConfig.parsed(network).n_lab == 3
    with pytest.warns(UserWarning, match="n_lab, side, filters, pool, n_filters"):
        assert settings.read_settings(file("flat.json", {"mode": "img-scalar", "mlp": [4]})) == ({"mode": "img-scalar", "mlp": [4]}, {})
    with pytest.raises(KeyError, match="did you mean 'training'"):
        settings.read_settings(file("odd.json", {"network": {}, "trainin": {}}))
    with pytest.raises(ValueError, match="object"):
        settings.read_settings(file("list.json", [1]))


@pytest.mark.parametrize("values", [{"steps": "3"}, {"steps": True}, {"rate": None}, {"steps": 0}, {"mode": "Newton"}, {"evaluate_every": 2}, {"save_every": 1}, {"valid_share": 1.0}, {"schedule": [[1]]}, {"schedule": [[1.5, 1]]}, {"most_seconds": "long"}, {"overwrite": 1}])
def test_wrong_settings_are_refused(values):
    with pytest.raises(ValueError, match=next(iter(values))):
        settings.TrainingSettings.parsed(values)


@pytest.mark.parametrize("values", [{"filters": 3}, {"filters": ["3"]}, {"mode": 1}, {"lazy_labels": 1}, {"dropout": [None]}, {"side": 8.5}])
def test_network_values_of_other_types_are_refused(values):
    with pytest.raises(ValueError, match=next(iter(values))):
        NetworkConfig.parsed({"mlp": [4], **values})
    with pytest.raises(KeyError, match="did you mean 'filters'"):
        NetworkConfig.parsed({"filter": [3]})


def test_training_by_settings_with_a_source_of_ones_own(spark, tmp_path, monkeypatch):
    (tmp_path / "own_source.py").write_text(
        "from pyspark.sql import functions as F\nfrom cubeloom.sources.loaders import register_source\n\n\n"
        "@register_source('own-pairs', (2,), 2)\ndef pairs(spark, path):\n    return spark.range(40).select(F.col('id').alias('key'), F.array((F.col('id') % 2).cast('double'), F.lit(1.0)).alias('features'), (F.col('id') % 2).alias('label'))\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "net.json").write_text(json.dumps({"network": {"mode": "vect-scalar", "n_lab": 2, "side": 1, "channels": 2, "mlp": [4], "activation": "maxout 2"}, "training": {"steps": 4, "valid_share": 0.25, "evaluate_every": 2, "save_every": 4}}))
    run = ["train", str(tmp_path / "net.json"), "own-pairs", "none", "--module", "own_source", "--save", str(tmp_path / "w")]
    main([*run, "--steps", "4"])
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2 * 4 + 4 + 2 * 2 + 2 and (tmp_path / "w.steps").exists()
    with pytest.raises(FileExistsError):
        main(run)
    whole = loaders.source("own-pairs", spark, "")
    t = trainer.Trainer.of(trainer.built(NetworkConfig(mode="vect-scalar", n_lab=2, side=1, channels=2, mlp=[4])), whole, settings.TrainingSettings(valid_share=0.25, steps=4, evaluate_every=2))
    log = t.run_by(settings.TrainingSettings(valid_share=0.25, steps=4, evaluate_every=2)).orderBy("step").collect()
    assert [r["valid_loss"] is None for r in log] == [True, False, True, False] and log[3]["loss"] < log[0]["loss"]
    ids = lambda df: {r["key"] for r in df.collect()}
    assert ids(t.valid).isdisjoint(ids(t.batches)) and ids(t.valid) | ids(t.batches) == set(range(40)) and t.valid.count() > 2
