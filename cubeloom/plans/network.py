"""Layer plans: a checked description of a network that builds its forward pass, loss and error as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from ..operators import layers as ops
from ..operators import losses
from ..operators.nets import maxout_factor
from ..operators.parameters import bias, glorot_scale, grid
from . import architecture
from .settings import checked_values

# Names that users type in configurations.
MODES = ("img-img", "img-scalar", "vect-scalar")
TARGETS = ("nll", "regression", "nll_mutiple_binary", "nll_weak", "affinity", "malis")
ACTIVATIONS = ("tanh", "relu", "abs", "sigmoid", "linear")


@dataclass
class NetworkConfig:
    """What a training run needs to know of its network; wrong combinations are errors when it is made.

    activation: one for all layers but the last, or a list with one for each (maxout k keeps the largest of k adjacent units). dims: axes of an example of img-img and img-scalar networks. side, and each entry of filters and pool, is a number for all axes or a list with one for each (z, x, y).
    """

    mode: str = "img-scalar"
    n_lab: int = 10
    channels: int = 1
    side: int | list[int] = 8
    filters: list[int | list[int]] = field(default_factory=list)
    pool: list[int | list[int]] = field(default_factory=list)
    n_filters: list[int] = field(default_factory=list)
    mlp: list[int] = field(default_factory=list)
    rnn: int = 0
    activation: str | list[str] = "tanh"
    pooling: str = "max"
    dropout: list[float] = field(default_factory=list)
    target: str = "nll"
    lazy_labels: bool = False
    dims: int = 2

    def axis(self, value: int | list[int], k: int) -> int:
        return value if isinstance(value, int) else value[k]

    def activations(self) -> list[str]:
        """One for each layer but the last: convolutions, recurrent, dense."""
        n = len(self.filters) + len(self.mlp) + bool(self.rnn)
        return [self.activation] * max(n, 1) if isinstance(self.activation, str) else list(self.activation)

    def extent(self) -> tuple[int, ...]:
        return tuple(self.axis(self.side, k) for k in range(self.dims))

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.mode in MODES, f"mode must be one of {', '.join(MODES)}")
        need(self.target in TARGETS, f"target must be one of {', '.join(TARGETS)}")
        need(all(a.lower() in ACTIVATIONS or a.lower().startswith("maxout") and maxout_factor(a.lower()) for a in self.activations()), f"activation must be one of {', '.join(ACTIVATIONS)}, or maxout and a number of 2 or more")
        need(self.pooling in ("max", "maxabs"), "pooling must be max or maxabs")
        need(len(self.filters) == len(self.pool) == len(self.n_filters), "filters, pool and n_filters must have one entry for each layer")
        need(self.mode != "img-img" or not self.mlp, "img-img networks have no dense layers")
        need(self.mode != "img-scalar" or bool(self.mlp), "img-scalar networks need a dense layer")
        need(self.mode != "vect-scalar" or not self.filters, "vect-scalar networks have no convolutions")
        need(not self.rnn or self.mode == "vect-scalar", "recurrent layers need vect-scalar")
        need(not self.lazy_labels or self.mode == "img-img", "lazy labels need img-img")
        n = len(self.filters) + len(self.mlp) + bool(self.rnn)
        need(isinstance(self.activation, str) or len(self.activation) == n, "activation is a name or has one for each layer")
        widths = [*self.n_filters, *([self.rnn] if self.rnn else []), *self.mlp]
        need(all(w % maxout_factor(a.lower()) == 0 for w, a in zip(widths, self.activations(), strict=False)), "maxout needs layers whose units can be dealt to groups of its number")
        need(not self.rnn or maxout_factor(self.activations()[0].lower()) == 1, "recurrent layers have no maxout")
        need(len(self.dropout) in (0, n), "dropout is empty or has one rate for each layer")
        need(self.dims in (2, 3), "dims must be 2 or 3")
        need(all(isinstance(v, int) or len(v) == self.dims for v in (self.side, *self.filters, *self.pool)), "side, filters and pools are numbers, or have one for each axis")
        need(self.target not in ("affinity", "malis") or self.mode == "img-img", "affinity targets need img-img")
        for k in range(self.dims if self.filters else 0):
            chain = architecture.chain(tuple(self.axis(f, k) for f in self.filters), tuple(self.axis(p, k) for p in self.pool))
            need(architecture.extents(self.axis(self.side, k), chain) is not None, "the input's size does not fit the layers")

    @classmethod
    def parsed(cls, values: dict) -> NetworkConfig:
        """From a flat dict; an unknown key is an error that names the nearest known one, a value of another type one that names the key."""
        return cls(**checked_values(cls, values))


class Network:
    """Layers over examples (key, label, value and x, y or i) in relational form: convolutions and dense layers with a softmax. Parameters are keyed draws
    until tables are given for them. Networks of all kinds, and their training, are in trainer.py.

    parameters: {name: DataFrame} with names conv<k>, conv<k>_b, dense<k>, dense<k>_b.
    """

    def __init__(self, spark, config: NetworkConfig, seed: str = "net", parameters: dict[str, DataFrame] | None = None) -> None:
        given = [name for name, ok in (("dims 3", config.dims == 2), ("pooling maxabs", config.pooling == "max"), ("activation by layer", isinstance(config.activation, str)), ("maxout", not str(config.activation).lower().startswith("maxout")), ("mode img-img", config.mode != "img-img"), ("rnn", not config.rnn), ("dropout", not any(config.dropout)), (f"target {config.target}", config.target == "nll"), ("lazy_labels", not config.lazy_labels)) if not ok]
        if given:
            raise ValueError(f"{', '.join(given)}: not in relational form; trainer.built makes such networks")
        self.spark, self.config, self.seed = spark, config, seed
        self.parameters = dict(parameters or {})

    def _dense(self, name: str, n_in: int, n_out: int, act: str) -> tuple[DataFrame, DataFrame]:
        draw = 2.0 * uniform(f"{self.seed}:{name}", F.col("i"), F.col("o")) - 1.0
        w = self.parameters.setdefault(name, grid(self.spark, i=n_in, o=n_out).withColumn("w", draw * glorot_scale(n_in, n_out)))
        b = self.parameters.setdefault(f"{name}_b", grid(self.spark, o=n_out).withColumn("b", bias(act, f"{self.seed}:{name}_b", F.col("o"))))
        return w, b

    def _conv(self, name: str, n_in: int, n_out: int, size: int, act: str) -> tuple[DataFrame, DataFrame]:
        draw = 2.0 * uniform(f"{self.seed}:{name}", *(F.col(c) for c in ("f", "ch", "kx", "ky"))) - 1.0
        cells = grid(self.spark, f=n_out, ch=n_in, kx=size, ky=size)
        w = self.parameters.setdefault(name, cells.withColumn("w", draw * glorot_scale(n_in * size * size, n_out * size * size)))
        b = self.parameters.setdefault(f"{name}_b", grid(self.spark, f=n_out).withColumn("b", bias(act, f"{self.seed}:{name}_b", F.col("f"))))
        return w, b

    def activities(self, examples: DataFrame, key: str) -> dict[str, DataFrame]:
        """Every layer's output by name; the last is output (key, o, z, h), with the linear z."""
        c, out = self.config, {}
        labels = [key, "label"]
        if c.filters:
            x, side, channels = examples if "ch" in examples.columns else examples.withColumn("ch", F.lit(0).cast("long")), c.side, c.channels
            for k, (f, p, n) in enumerate(zip(c.filters, c.pool, c.n_filters, strict=True)):
                w, b = self._conv(f"conv{k}", channels, n, f, c.activation)
                z = ops.conv(x, w, b, labels, {"x": side, "y": side}, {"x": f, "y": f})
                side = (side - f + 1) // p
                z = ops.pooled(z, [*labels, "f"], {"x": p, "y": p}, "z") if p > 1 else z
                out[f"conv{k}"] = x = z.select(*labels, F.col("f").alias("ch"), "x", "y", ops.activation(F.col("z"), c.activation).alias("value"))
                channels = n
            flat = x.select(*labels, ((F.col("ch") * side + F.col("x")) * side + F.col("y")).alias("i"), "value")
            n_in = channels * side * side
        else:
            flat, n_in = examples.select(*labels, "i", "value"), c.side * c.side * c.channels
        for k, n in enumerate(c.mlp):
            w, b = self._dense(f"dense{k}", n_in, n, c.activation)
            out[f"dense{k}"] = h = ops.dense(flat, w, b, labels, c.activation)
            flat, n_in = ops.as_input(h, labels), n
        w, b = self._dense("output", n_in, c.n_lab, "linear")
        out["output"] = ops.dense(flat, w, b, labels)
        return out

    def probabilities(self, examples: DataFrame, key: str) -> DataFrame:
        """key, label, c, p."""
        z = self.activities(examples, key)["output"].withColumnRenamed("o", "c")
        return ops.softmax(z, [key]).select(key, "label", "c", "p")

    def loss(self, examples: DataFrame, key: str) -> DataFrame:
        return losses.nll(self.probabilities(examples, key).withColumnRenamed("label", "y"))

    def error(self, examples: DataFrame, key: str) -> DataFrame:
        p = self.probabilities(examples, key)
        best = F.max_by("c", F.struct(F.round("p", 9), -F.col("c")))
        return p.groupBy(key).agg(F.first("label").alias("y"), best.alias("pred")).agg(losses.error_rate().alias("error"))
