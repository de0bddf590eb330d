"""A training run: a checked configuration becomes a network, examples become stored mini-batches, and steps are logged, judged and saved."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from ..operators import nets, optimise
from ..operators.batches import Stream
from ..operators.search import Search
from ..sources.loaders import keyed_split
from ..sources.tables import exists, written
from . import architecture
from .network import NetworkConfig
from .settings import OPTIMISERS, TrainingSettings


def built(config: NetworkConfig, target: str | Callable | None = None, side: int | tuple[int, ...] | None = None, steps: int = 1) -> nets.Net:
    """The network of a configuration: convolutions over images or volumes, or a recurrent layer over steps rows, then dense layers, then a linear output
    (one for each pixel in img-img, a pair for each axis for affinities). target replaces the configured one by another or by a function of one's own;
    side takes a larger input with the same weights. With lazy_labels, examples have a column masks (nets.Net).
    """
    c = config
    target = target or c.target
    if not callable(target) and target not in nets.TARGETS:
        raise ValueError(f"target must be one of {', '.join(nets.TARGETS)}")
    if target in ("affinity", "malis") and c.dims != 3:
        raise ValueError("affinity targets need a network over volumes (dims 3)")
    rates = iter(c.dropout or [0.0] * (len(c.filters) + len(c.mlp) + bool(c.rnn)))
    acts = iter(a.lower() for a in c.activations())
    layers: list[nets.Layer] = []
    extent = c.extent() if side is None else nets.per_axis(side, c.dims)
    channels = c.channels
    shape: tuple[int, ...] = (channels, *extent)
    as_tuple = lambda v: v if isinstance(v, int) else tuple(v)
    for f, p, n in zip(c.filters, c.pool, c.n_filters, strict=True):
        layers.append(nets.Layer("conv", channels, n, next(acts), as_tuple(f), as_tuple(p), next(rates), c.dims, c.pooling))
        extent = tuple((e - a + 1) // b for e, a, b in zip(extent, layers[-1].extent, layers[-1].pools, strict=True))
        channels = layers[-1].maps
    if c.mode == "img-img":
        n_out = 2 * c.dims if target in ("affinity", "malis") else c.n_lab
        return nets.Net(shape, [*layers, nets.Layer("conv", channels, n_out, "linear", dims=c.dims)], c.n_lab, target, lazy=c.lazy_labels)
    n_in = channels * math.prod(extent)
    if c.mode == "vect-scalar":
        n_in = math.prod(c.extent()) * c.channels
        shape = (steps, n_in) if c.rnn else (n_in,)
    if c.rnn:
        layers.append(nets.Layer("rnn", n_in, c.rnn, next(acts), rate=next(rates)))
        n_in = c.rnn
    for n in c.mlp:
        layers.append(nets.Layer("dense", n_in, n, next(acts), rate=next(rates)))
        n_in = layers[-1].maps
    return nets.Net(shape, [*layers, nets.Layer("dense", n_in, c.n_lab, "linear")], c.n_lab, target)


class Trainer:
    """Steps over examples (key and net.columns) dealt to keyed mini-batches, or over the batches of a stream (operators.batches.Stream). Batches of a table are written once,
    in order of their numbers, so a step reads its own alone.

    valid: examples for evaluation. bounds: (low, high) of the weights for LBFGS. Rates fall by decay every decay_every steps; schedule: rates set anew
    after so many steps, which fall from there on. The state (weights, moments, log) is small and stays on the driver.
    """

    def __init__(self, net: nets.Net, examples: DataFrame | Stream, valid: DataFrame | None = None, n_batches: int = 1, rate: float = 0.1, momentum: float = 0.9, weight_decay: float = 0.0, decay: float = 1.0, decay_every: int = 1000, seed: int = 0, bounds: tuple | None = None, schedule: dict[int, float] | None = None) -> None:
        self.stream = examples if isinstance(examples, Stream) else None
        if self.stream:
            self.spark, self.batches = examples.volumes.cubes.sparkSession, None
        else:
            self.spark = examples.sparkSession
            dealt = examples.select("key", *net.columns).withColumn("batch", F.floor(uniform(f"batch{seed}", F.col("key")) * n_batches).cast("int"))
            # Files hold ranges of batches, and row groups' ends keep a step from reading others.
            self.batches = written(dealt.repartitionByRange("batch", "key").sortWithinPartitions("batch"), "batches") if n_batches > 1 else dealt
        self.net, self.valid, self.n_batches, self.seed, self.bounds = net, valid, n_batches, seed, bounds
        self.judged: DataFrame | None = None
        self.schedule = dict(sorted((schedule or {}).items()))
        self.settings = {"rate": rate, "momentum": momentum, "weight_decay": weight_decay, "decay": decay, "decay_every": decay_every}
        self.reset()

    @classmethod
    def of(cls, net: nets.Net, examples: DataFrame, settings: TrainingSettings) -> Trainer:
        """A trainer by settings, which sets aside their share of the examples."""
        split = keyed_split(examples, "key", settings.valid_share, f"valid{settings.seed}")
        valid = split.where("split = 'valid'").drop("split") if settings.valid_share else None
        own = {k: getattr(settings, k) for k in ("n_batches", "rate", "momentum", "weight_decay", "decay", "decay_every", "seed")}
        return cls(net, split.where("split = 'train'").drop("split"), valid, schedule={int(k): r for k, r in settings.schedule}, **own)

    def run_by(self, settings: TrainingSettings) -> DataFrame:
        """run by settings, and the weights saved where they say."""
        if settings.save and not settings.overwrite and exists(self.spark, settings.save):
            raise FileExistsError(f"{settings.save} exists; overwrite is not set")
        most = math.inf if settings.most_seconds is None else settings.most_seconds
        log = self.run(settings.steps, settings.mode, settings.evaluate_every, settings.save_every, f"{settings.save}.steps" if settings.save else None, most)
        if settings.save:
            self.save(settings.save)
        return log

    def reset(self) -> None:
        """Weights as at first, no moments, an empty log."""
        self.w, self.state, self.log, self.history, self.steps = self.net.initial(self.seed), {}, [], [], 0

    def batch(self, step: int) -> DataFrame:
        """The mini-batch of a step: in each epoch all of them, in a drawn order; of a stream, the next one."""
        if self.stream:
            return self.stream.batch(step)
        if self.n_batches == 1:
            return self.batches
        order = np.random.default_rng((self.seed, step // self.n_batches)).permutation(self.n_batches)
        return self.batches.where(F.col("batch") == int(order[step % self.n_batches]))

    @property
    def rate(self) -> float:
        s = self.settings
        at, rate = max(((k, r) for k, r in self.schedule.items() if k <= self.steps), default=(0, s["rate"]))
        return rate * s["decay"] ** (self.steps // s["decay_every"] - at // s["decay_every"])

    def training_step(self, mode: str = "SGD") -> float:
        """One step by an optimiser's rule; the loss before it (after it for CG and LBFGS)."""
        if mode not in OPTIMISERS:
            raise ValueError(f"mode must be one of {', '.join(OPTIMISERS)}")
        batch, s, k = self.batch(self.steps), self.settings, self.steps + 1
        if mode in ("CG", "LBFGS"):
            search = self.state.setdefault(mode, Search(mode, **({"low": self.bounds[0], "high": self.bounds[1]} if self.bounds and mode == "LBFGS" else {})))
            at, along = (lambda w: nets.gradient(batch, self.net, w, k)[:2]), (lambda ws, ds: nets.along(batch, self.net, ws, ds, k))
            # Passes are used again where a step reads the same examples with the same units dropped.
            same = "all" if self.n_batches == 1 and not self.stream and not any(x.rate for x in self.net.layers) else self.steps
            self.w, loss = search.step(at, along, self.w, same)
        else:
            loss, g, _ = nets.gradient(batch, self.net, self.w, k)
            held = self.state.setdefault(mode, [np.zeros_like(g), np.full_like(g, 1e-3) if mode == "RPROP" else np.zeros_like(g)])
            if mode == "SGD":
                self.w, held[0] = optimise.sgd(self.w, g, held[0], self.rate, s["momentum"], s["weight_decay"])
            elif mode == "Adam":
                self.w, held[0], held[1] = optimise.adam(self.w, g, *held, k, self.rate, 0.9, 0.999, 1e-8)
            else:
                self.w, held[1] = optimise.rprop(self.w, g, *held, 0.2, 0.5, s["weight_decay"])
                held[0] = g
        self.steps += 1
        self.log.append((self.steps, float(loss), self.rate))
        return float(loss)

    def evaluate(self, examples: DataFrame | None = None) -> tuple[float, float]:
        """(loss, error) without dropout, over all of examples (the validation set); not a number without one. The error is the share of wrong labelled
        outputs, for regression the root of the mean square."""
        if examples is None and self.valid is None:
            return math.nan, math.nan
        if examples is None:  # read several times, in each evaluation: written once
            if self.judged is None:
                self.judged = written(self.valid.select("key", *self.net.columns), "valid")
            examples = self.judged
        loss, _, _ = nets.gradient(examples, self.net, self.w)
        if self.net.target == "regression" or callable(self.net.target):
            return loss, math.sqrt(loss) if self.net.target == "regression" else math.nan
        p = nets.outputs(examples, self.net, self.w)
        if self.net.target == "nll_mutiple_binary":
            label = examples.select("key", F.posexplode("label").alias("c", "y"))
            wrong = p.join(label, ["key", "c"]).agg(F.avg(((F.col("p") < 0.5).cast("int") != F.col("y")).cast("double")).alias("e")).first()["e"]
            return loss, wrong
        best = p.groupBy("key", "pos").agg(F.max_by("c", F.struct(F.round("p", 9), -F.col("c"))).alias("pred"))
        is_list = examples.schema["label"].dataType.typeName() == "array"
        label = examples.select("key", F.posexplode("label").alias("pos", "y")) if is_list else examples.select("key", F.lit(0).alias("pos"), F.col("label").alias("y"))
        return loss, best.join(label, ["key", "pos"]).where("y >= 0").agg(F.avg((F.col("pred") != F.col("y")).cast("double")).alias("e")).first()["e"]

    def run(self, steps: int, mode: str = "SGD", evaluate_every: int = 0, save_every: int = 0, path: str | None = None, most_seconds: float = math.inf) -> DataFrame:
        """Up to so many steps (fewer where time runs out or a loss is no number); the log as (step, loss, rate, valid_loss, valid_error)."""
        began = time.time()
        for _ in range(steps):
            loss = self.training_step(mode)
            if not math.isfinite(loss) or time.time() - began > most_seconds:
                break
            if evaluate_every and self.steps % evaluate_every == 0:
                self.history.append((self.steps, *self.evaluate()))
            if save_every and path and self.steps % save_every == 0:
                self.save(f"{path}/step={self.steps}")
        return self.logged()

    def logged(self) -> DataFrame:
        judged = {s: (a, b) for s, a, b in self.history}
        rows = [(s, loss, rate, *judged.get(s, (None, None))) for s, loss, rate in self.log]
        return self.spark.createDataFrame(rows, "step long, loss double, rate double, valid_loss double, valid_error double")

    def save(self, path: str) -> str:
        """The network and its weights as one table (saved_network)."""
        return saved_network(self.spark, self.net, self.w, path)

    def load(self, path: str, adapt: bool = False, n_layers: int | None = None) -> None:
        """Weights that save wrote. Those of a network of other layers are an error, or (adapt) are fitted to this one's, its first n_layers alone if that is set."""
        net, w = loaded_network(self.spark, path)
        if adapt:
            self.w = adapted_weights(net, w, self.net, self.w, n_layers)
        elif len(w) != self.net.n_weights or net.sizes != self.net.sizes:
            raise ValueError(f"{path} has {len(w)} weights, the network {self.net.n_weights}; or their layers differ")
        else:
            self.w = w
        self.state = {}


LAYER = "k long, w double, layer int, kind string, n_in int, n_out int, act string, size array<int>, pool array<int>, rate double, dims int, pooling string, shape array<int>, n_lab int, target string"


def saved_network(spark, net: nets.Net, w: np.ndarray, path: str) -> str:
    """One row for each weight (k, w), with all of its layer and of the network: what a network can be built again from."""
    rows, k = [], 0
    for i, (x, arrays) in enumerate(zip(net.layers, net.unpacked(w), strict=True)):
        size, pool = (list(x.extent), list(x.pools)) if x.kind == "conv" else ([1], [1])
        about = (i, x.kind, x.n_in, x.n_out, x.act, size, pool, x.rate, x.dims, x.pooling, list(net.shape), net.n_lab, net.target if isinstance(net.target, str) else "own")
        for v in np.concatenate([a.ravel() for a in arrays]).tolist():
            rows.append((k, v, *about))
            k += 1
    spark.createDataFrame(rows, LAYER).write.mode("overwrite").parquet(path)
    return path


def loaded_network(spark, path: str, extent: tuple[int, ...] | None = None) -> tuple[nets.Net, np.ndarray]:
    """(network, weights) of saved_network; extent: another input for a network of convolutions, of which the largest that fits is taken, axis by axis."""
    table = spark.read.parquet(path)
    rows = table.drop("k", "w").distinct().orderBy("layer").collect()  # a row a layer
    if not rows:
        raise ValueError(f"{path} has no network")
    layers = []
    for r in rows:
        conv = {"size": tuple(r["size"]), "pool": tuple(r["pool"]), "dims": r["dims"], "pooling": r["pooling"]} if r["kind"] == "conv" else {}
        layers.append(nets.Layer(r["kind"], r["n_in"], r["n_out"], r["act"], rate=r["rate"], **conv))
    target = rows[0]["target"]
    net = nets.Net(tuple(rows[0]["shape"]), layers, rows[0]["n_lab"], "nll" if target == "own" else target)
    if extent is not None:
        net = net.at(fitting(net, extent))
    return net, np.array([r["w"] for r in table.select("k", "w").orderBy("k").collect()])  # as many as weights


def fitting(net: nets.Net, extent: tuple[int, ...]) -> tuple[int, ...]:
    """The largest input of a network of convolutions within an extent that its pools divide; an error where there is none."""
    out = []
    for k, n in enumerate(extent):
        chain = architecture.chain(tuple(x.extent[k] for x in net._conv()), tuple(x.pools[k] for x in net._conv()))
        valid = [m for m in range(net.field[k], n + 1) if architecture.extents(m, chain) is not None]
        if not valid:
            raise ValueError(f"no input of {n} or fewer fits the layers")
        out.append(architecture.choose(valid, n))
    return tuple(out)


def adapted_weights(had: nets.Net, old: np.ndarray, net: nets.Net, w: np.ndarray, n_layers: int | None = None) -> np.ndarray:
    """w with the weights of another network, layer by layer of the same kind: maps and channels from the first again where more are wanted, the first where fewer; filters
    put in the middle of larger ones, or cropped to their middle. What is new of a filter keeps its value in w; layers of other kinds or axes stay as they are."""
    out = []
    most = len(net.layers) if n_layers is None else n_layers
    for i, (x, arrays) in enumerate(zip(net.layers, net.unpacked(w), strict=True)):
        same = i < min(most, len(had.layers)) and (had.layers[i].kind, had.layers[i].dims) == (x.kind, x.dims)
        before = had.unpacked(old)[i] if same else arrays
        for a, b in zip(arrays, before, strict=True):
            new = a.copy()
            maps = min(2, a.ndim) if x.kind == "conv" else a.ndim
            for k in range(maps):
                b = np.take(b, np.arange(a.shape[k]) % b.shape[k], axis=k)
            into, of = [slice(None)] * maps, [slice(None)] * maps
            for n, m in zip(a.shape[maps:], b.shape[maps:], strict=True):
                lo, n_same = abs(n - m) // 2, min(n, m)
                into.append(slice(lo, lo + n_same) if n > m else slice(None))
                of.append(slice(lo, lo + n_same) if m > n else slice(None))
            new[tuple(into)] = b[tuple(of)]
            out.append(new.ravel())
    return np.concatenate(out)


def for_prediction(trainer: Trainer, config: NetworkConfig, side: int | tuple[int, ...]) -> nets.Net:
    """The trained network of convolutions over a larger input, to be run with the same weights."""
    if config.mode != "img-img":
        raise ValueError("only img-img networks take another input size")
    net = built(config, trainer.net.target, side)
    if net.n_weights != trainer.net.n_weights:
        raise ValueError("the weights do not fit")
    return net


def profiled(spark, config: NetworkConfig, sides: list[int], path: str | None = None, rows: int = 8) -> DataFrame:
    """(side, pixels, seconds, mpix_per_s) of a forward pass over rows images of each side that fits the network; written as tab-separated text to path."""
    out = []
    for side in sides:
        try:
            net = built(NetworkConfig(**{**config.__dict__, "side": side}))
        except ValueError:
            continue
        x = np.random.default_rng(0).normal(size=(rows, config.channels * side * side))
        examples = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "key long, features array<double>")
        began = time.time()
        nets.outputs(examples, net, net.initial()).write.format("noop").mode("overwrite").save()
        took = time.time() - began
        out.append((side, rows * side * side, took, rows * side * side / took / 1e6))
    table = spark.createDataFrame(out, "side long, pixels long, seconds double, mpix_per_s double")
    if path:
        table.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)  # a row for each side
    return table
