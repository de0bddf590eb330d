"""Networks over dense rows and their gradients, in NumPy on Arrow batches.

A row holds an example's values as one array. A partition runs its rows through the layers and back, and sums losses and gradients; only
these sums (as many as there are weights) are added up over partitions. Weights are one flat vector that goes along with the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from math import prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import pair_counts
from .kernels import ACTIVATIONS

EPS = 1e-6
SLICE = 256
#: Slopes of the activations, from input z and output h.
SLOPES: dict[str, Callable] = {"tanh": lambda z, h: 1.0 - h * h, "relu": lambda z, h: (z > 0) * 1.0, "abs": lambda z, h: np.sign(z), "sigmoid": lambda z, h: h * (1.0 - h), "linear": lambda z, h: np.ones_like(z)}
TARGETS = ("nll", "regression", "nll_mutiple_binary", "nll_weak", "affinity", "malis")


def per_axis(v: int | tuple[int, ...], dims: int) -> tuple[int, ...]:
    return (v,) * dims if isinstance(v, int) else tuple(v)


def maxout_factor(act: str) -> int:
    """k of maxout k; 1 for other activations, 0 where k is no number of 2 or more."""
    if not act.startswith("maxout"):
        return 1
    k = act.removeprefix("maxout").strip()
    return int(k) if k.isdecimal() and int(k) > 1 else 0


@dataclass(frozen=True)
class Layer:
    """kind: conv (true convolution over dims axes, then pool, gate, bias, activation), dense, or rnn (over an example's rows, giving the last state).

    size and pool are numbers, or one for each axis. pooling: max, or maxabs, which keeps the value of largest magnitude with its sign. act: a name, or
    maxout k, which keeps the largest of k adjacent units or channels (the first in ties): n_out linear units then give n_out / k outputs, maps.
    """

    kind: str
    n_in: int
    n_out: int
    act: str = "tanh"
    size: int | tuple[int, ...] = 1
    pool: int | tuple[int, ...] = 1
    rate: float = 0.0
    dims: int = 2
    pooling: str = "max"

    def __post_init__(self) -> None:
        if not self.factor:
            raise ValueError(f"{self.act}: maxout needs a number of 2 or more")
        if self.n_out % self.factor or self.factor > 1 and self.kind == "rnn":
            raise ValueError(f"{self.act}: {self.n_out} units of a {self.kind} layer can't be dealt to groups of {self.factor}")

    @property
    def factor(self) -> int:
        """How many units one output is the largest of."""
        return maxout_factor(self.act)

    @property
    def maps(self) -> int:
        """Outputs (channels, or values)."""
        return self.n_out // self.factor

    @property
    def extent(self) -> tuple[int, ...]:
        return per_axis(self.size, self.dims)

    @property
    def pools(self) -> tuple[int, ...]:
        return per_axis(self.pool, self.dims)

    def shapes(self) -> list[tuple[int, ...]]:
        if self.kind == "conv":
            return [(self.n_out, self.n_in, *self.extent), (self.n_out,)]
        if self.kind == "rnn":
            return [(self.n_in, self.n_out), (self.n_out, self.n_out), (self.n_out,), (self.n_out,)]
        return [(self.n_in, self.n_out), (self.n_out,)]


#: Values of the windows of a convolution that are laid out at once; larger ones are summed offset by offset.
WINDOW_VALUES = 4_000_000


def _at(offset: tuple[int, ...], extent: tuple[int, ...]) -> tuple[slice, ...]:
    return (slice(None), slice(None), *(slice(a, a + n) for a, n in zip(offset, extent, strict=True)))


def convolved(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The inner part of the true convolution of x (examples, channels, axes) with w (filters, channels, axes)."""
    k, dims = w.shape[2:], w.ndim - 2
    out = tuple(n - e + 1 for n, e in zip(x.shape[2:], k, strict=True))
    flipped = np.flip(w, tuple(range(2, 2 + dims)))
    if len(x) * prod(out) * x.shape[1] * prod(k) <= WINDOW_VALUES:
        windows = np.lib.stride_tricks.sliding_window_view(x, k, axis=tuple(range(2, 2 + dims))).transpose(0, *range(2, 2 + dims), 1, *range(2 + dims, 2 + 2 * dims))
        z = windows.reshape(len(x), -1, x.shape[1] * prod(k)) @ flipped.reshape(len(w), -1).T
        return z.transpose(0, 2, 1).reshape(len(x), len(w), *out)
    z = np.zeros((len(w), len(x), *out))
    for offset in np.ndindex(*k):
        z += np.tensordot(flipped[(slice(None), slice(None), *offset)], x[_at(offset, out)], axes=(1, 1))
    return z.swapaxes(0, 1)


def convolved_back(x: np.ndarray, w: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slopes by w and by x for slopes d of convolved(x, w)."""
    k, out = w.shape[2:], d.shape[2:]
    g, at_x = np.zeros_like(w), np.zeros((x.shape[1], len(x), *x.shape[2:]))
    rest = [0, *range(2, d.ndim)]
    for offset in np.ndindex(*k):
        place = (slice(None), slice(None), *(e - 1 - a for e, a in zip(k, offset, strict=True)))
        g[place] = np.tensordot(d, x[_at(offset, out)], axes=(rest, rest))
        at_x[_at(offset, out)] += np.tensordot(w[place], d, axes=(0, 1))
    return g, at_x.swapaxes(0, 1)


def pool_blocks(z: np.ndarray, pools: tuple[int, ...]) -> np.ndarray:
    """(examples, channels, pooled axes, values of a pool): what does not fill a pool is left out."""
    dims = len(pools)
    n = tuple(s // q for s, q in zip(z.shape[2:], pools, strict=True))
    whole = z[_at((0,) * dims, tuple(a * q for a, q in zip(n, pools, strict=True)))]
    split = whole.reshape(*z.shape[:2], *(v for pair in zip(n, pools, strict=True) for v in pair))
    return split.transpose(0, 1, *range(2, 2 + 2 * dims, 2), *range(3, 3 + 2 * dims, 2)).reshape(*z.shape[:2], *n, prod(pools))


def unpooled(blocks: np.ndarray, pools: tuple[int, ...], shape: tuple[int, ...]) -> np.ndarray:
    """pool_blocks undone, with zeros where nothing was pooled."""
    dims, n = len(pools), blocks.shape[2:-1]
    split = blocks.reshape(*blocks.shape[:2], *n, *pools).transpose(0, 1, *(v for i in range(dims) for v in (2 + i, 2 + dims + i)))
    extent = tuple(a * q for a, q in zip(n, pools, strict=True))
    out = np.zeros(shape)
    out[_at((0,) * dims, extent)] = split.reshape(*blocks.shape[:2], *extent)
    return out


def pool_routes(blocks: np.ndarray, pooling: str) -> np.ndarray:
    return (np.abs(blocks) if pooling == "maxabs" else blocks).argmax(axis=-1)


def gate(rate: float, key: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(examples, n): 1 / (1 - rate), or 0 at the rate; a hash of the example's key, the unit and the seed, so it is the same in every run."""
    x = key.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(n, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return (u >= rate) / (1.0 - rate)


def target_loss(target: str | Callable, z: np.ndarray, y: np.ndarray, n_lab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slope by z, whether it counts) of each row of linear outputs z. target: one of TARGETS, or a function of (z, y) that gives the
    first two. Labels below 0 do not count."""
    if callable(target):
        loss, slope = target(z, y)
        return loss, slope, np.ones(len(z), bool)
    if target == "regression":
        d = z - y.reshape(z.shape)
        return (d * d).mean(axis=1), 2.0 * d / z.shape[1], np.ones(len(z), bool)
    if target == "nll_mutiple_binary":
        y = y.reshape(z.shape)
        p0 = 1.0 / (1.0 + np.exp(-z))
        loss = -np.log(p0 + EPS) * (1.0 - y) - np.log(1.0 - p0 + EPS) * y
        slope = (y / (1.0 - p0 + EPS) - (1.0 - y) / (p0 + EPS)) * p0 * (1.0 - p0)
        return loss.mean(axis=1), slope / z.shape[1], np.ones(len(z), bool)
    y = y.reshape(-1).astype(np.int64)
    known = y >= 0
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hit = (np.arange(n_lab) == y[:, None]) * 1.0
    t = hit if target == "nll" else 0.5 * hit + 0.5 * p
    each = -np.log(p + EPS) * t
    by_p = -t / (p + EPS) - (0.5 * np.log(p + EPS) if target == "nll_weak" else 0.0)
    slope = p * (by_p - (by_p * p).sum(axis=1, keepdims=True))
    return each.sum(axis=1) * known, slope * known[:, None], known


def _adjacent(z: np.ndarray, factor: int) -> np.ndarray:
    """(examples, maps, factor, axes) of linear outputs (examples, channels, axes)."""
    return z.reshape(len(z), -1, factor, *z.shape[2:])


def activated(layer: Layer, z: np.ndarray) -> np.ndarray:
    return _adjacent(z, layer.factor).max(axis=2) if layer.factor > 1 else ACTIVATIONS[layer.act](z)


def activated_back(layer: Layer, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The slope by z for the slope of h = activated(layer, z)."""
    slope = slope.reshape(h.shape)
    if layer.factor == 1:
        return slope * SLOPES[layer.act](z, h)
    groups = _adjacent(z, layer.factor)
    out = np.zeros_like(groups)
    np.put_along_axis(out, groups.argmax(axis=2)[:, :, None], slope[:, :, None], 2)
    return out.reshape(z.shape)


def layer_output(layer: Layer, par: list[np.ndarray], x: np.ndarray, key: np.ndarray | None, step: int | None, i: int) -> tuple[np.ndarray, tuple]:
    """(output, what layer_slopes needs) of the i-th layer for its input."""
    drops = layer.rate and step is not None
    if layer.kind == "rnn":
        h = [np.tile(par[3], (len(x), 1))]
        zs = []
        for t in range(x.shape[1]):
            zs.append(x[:, t] @ par[0] + h[-1] @ par[1] + par[2])
            h.append(activated(layer, zs[-1]))
        g = gate(layer.rate, key, layer.n_out, step * 1009 + i) if drops else None
        return h[-1] if g is None else h[-1] * g, (x, zs, h, g)
    if layer.kind == "conv":
        z = convolved(x, par[0])
        full, where = z.shape, None
        if prod(layer.pools) > 1:
            blocks = pool_blocks(z, layer.pools)
            where = pool_routes(blocks, layer.pooling)
            z = np.take_along_axis(blocks, where[..., None], -1)[..., 0]
        g = gate(layer.rate, key, prod(z.shape[2:]), step * 1009 + i).reshape(len(x), 1, *z.shape[2:]) if drops else None
        z = (z if g is None else z * g) + par[1].reshape(1, -1, *(1,) * layer.dims)
        extra = (full, where)
    else:
        x = x.reshape(len(x), -1)
        g = gate(layer.rate, key, layer.n_out, step * 1009 + i) if drops else None
        z = x @ par[0]
        z = (z if g is None else z * g) + par[1]
        extra = ()
    h = activated(layer, z)
    return h, (x, z, h, g, *extra)


def layer_slopes(layer: Layer, par: list[np.ndarray], had: tuple, slope: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(slope by the input, by each parameter) for the slope of a layer's output."""
    if layer.kind == "rnn":
        x, zs, h, g = had
        slope = slope.reshape(h[-1].shape)
        back = slope if g is None else slope * g
        g_in, g_hid, g_b = (np.zeros_like(p) for p in par[:3])
        at_x = np.zeros_like(x)
        for t in reversed(range(x.shape[1])):
            d = back * SLOPES[layer.act](zs[t], h[t + 1])
            g_in, g_hid, g_b = g_in + x[:, t].T @ d, g_hid + h[t].T @ d, g_b + d.sum(axis=0)
            at_x[:, t], back = d @ par[0].T, d @ par[1].T
        return at_x, [g_in, g_hid, g_b, back.sum(axis=0)]
    x, z, h, g = had[:4]
    d = activated_back(layer, z, h, slope)
    if layer.kind == "dense":
        g_b, d = d.sum(axis=0), d if g is None else d * g
        return d @ par[0].T, [x.T @ d, g_b]
    full, where = had[4:]
    g_b, d = d.sum(axis=(0, *range(2, d.ndim))), d if g is None else d * g
    if where is not None:
        blocks = np.zeros((*d.shape, prod(layer.pools)))
        np.put_along_axis(blocks, where[..., None], d[..., None], -1)
        d = unpooled(blocks, layer.pools, full)
    g_w, at_x = convolved_back(x, par[0], d)
    return at_x, [g_w, g_b]


def initial_of(layer: Layer, sizes: list[tuple[int, ...]], rng: np.random.Generator) -> list[np.ndarray]:
    """Uniform draws on the scale of the fan in and out; recurrent weights by their largest singular value; biases by activation."""
    out = []
    for k, s in enumerate(sizes):
        if len(s) == 1:
            out.append(np.full(s, {"relu": 1.0, "sigmoid": 0.5}.get(layer.act, 0.0)))
            continue
        v = rng.uniform(-1.0, 1.0, s)
        out.append(v / np.linalg.norm(v, 2) if layer.kind == "rnn" and k == 1 else v * sqrt(2.0 / ((layer.n_in + layer.n_out) * prod(layer.extent))))
    return out


@dataclass
class Net:
    """Layers over examples of shape (channels, side, side), (channels, depth, side, side), (values,) or, with an rnn first, (steps, values). The last
    layer is linear; with dense outputs an example has one output row, a net of convolutions alone has one for each pixel of the last maps.

    Targets affinity and malis take one pair of outputs (apart, together) for each axis; labels are 0 and 1 for each axis (affinity), or a voxel's
    segment, 0 being background (malis, over the whole example; unrestricted as in graph.maximin_edges).

    Of target nll, class_weights weigh labels by class, and outputs without a label whose likeliest class has more than label_prop take it as theirs. lazy:
    examples have a further array masks of two flags a class, all classes' labelled flags first, then all not-present flags; weighted: a further array weights with a
    number for each output row."""

    shape: tuple[int, ...]
    layers: list[Layer]
    n_lab: int
    target: str | Callable = "nll"
    class_weights: tuple[float, ...] | None = None
    label_prop: float | None = None
    lazy: bool = False
    weighted: bool = False
    sizes: list[list[tuple[int, ...]]] = field(init=False)

    def __post_init__(self) -> None:
        self.sizes = [x.shapes() for x in self.layers]
        if self.voted and self.target != "nll":
            raise ValueError("class and example weights, lazy labels and propagated labels need the target nll")

    @property
    def voted(self) -> bool:
        return self.class_weights is not None or self.label_prop is not None or self.lazy or self.weighted

    @property
    def columns(self) -> list[str]:
        """What examples have beside their key."""
        return ["features", "label", *(["masks"] if self.lazy else []), *(["weights"] if self.weighted else [])]

    @property
    def n_weights(self) -> int:
        return sum(prod(s) for x in self.sizes for s in x)

    @property
    def by_pixel(self) -> bool:
        return self.layers[-1].kind == "conv"

    def unpacked(self, w: np.ndarray) -> list[list[np.ndarray]]:
        out, at = [], 0
        for x in self.sizes:
            out.append([])
            for s in x:
                out[-1].append(w[at : at + prod(s)].reshape(s))
                at += prod(s)
        return out

    def initial(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([v.ravel() for x, sizes in zip(self.layers, self.sizes, strict=True) for v in initial_of(x, sizes, rng)])

    def forward(self, w: np.ndarray, x: np.ndarray, key: np.ndarray | None = None, step: int | None = None) -> tuple[np.ndarray, list]:
        """(linear outputs, what the way back needs). With a step, layers drop units by their rates."""
        kept, x = [], x.reshape(len(x), *self.shape)
        for i, (layer, par) in enumerate(zip(self.layers, self.unpacked(w), strict=True)):
            x, had = layer_output(layer, par, x, key, step, i)
            kept.append(had)
        if self.by_pixel:
            x = np.moveaxis(x, 1, -1).reshape(-1, x.shape[1])
        return x, kept

    def backward(self, w: np.ndarray, kept: list, slope: np.ndarray) -> np.ndarray:
        """The gradient of all weights for the slopes of the linear outputs."""
        if self.by_pixel:
            m, c, *extent = kept[-1][2].shape
            slope = np.moveaxis(slope.reshape(m, *extent, c), -1, 1)
        grads: list[list[np.ndarray]] = []
        for layer, par, had in zip(reversed(self.layers), reversed(self.unpacked(w)), reversed(kept), strict=True):
            slope, own = layer_slopes(layer, par, had, slope)
            grads.append(own)
        return np.concatenate([v.ravel() for x in reversed(grads) for v in x])

    def loss_and_gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, key: np.ndarray | None = None, step: int | None = None, masks: np.ndarray | None = None, weights: np.ndarray | None = None) -> tuple[float, np.ndarray, int]:
        """(sum of losses, their gradient, how many count)."""
        z, kept = self.forward(w, x, key, step)
        if self.voted:
            each = len(z) // max(len(x), 1)
            flags = np.repeat(masks.reshape(len(x), 2, self.n_lab), each, axis=0) if self.lazy else None
            loss, slope, known = voted_loss(z, y, self.class_weights, self.label_prop, flags, weights.reshape(-1, 1) if self.weighted else None)
        elif self.target == "malis":
            loss, slope, known = malis_loss(z, y, len(x), kept[-1][2].shape[2:])
        elif self.target == "affinity":
            loss, slope, known = affinity_loss(z, y)
        else:
            loss, slope, known = target_loss(self.target, z, y, self.n_lab)
        return float(loss.sum()), self.backward(w, kept, slope), int(known.sum())

    def at(self, extent: tuple[int, ...]) -> Net:
        """The same layers over inputs of another extent; the weights fit where there are no dense layers."""
        return replace(self, shape=(self.shape[0], *extent))

    def _conv(self) -> list[Layer]:
        if not self.by_pixel:
            raise ValueError("only networks of convolutions have an output for each pixel")
        return self.layers

    @property
    def strides(self) -> tuple[int, ...]:
        """Pixels from one output to the next, by axis."""
        return tuple(prod(x) for x in zip(*(layer.pools for layer in self._conv()), strict=True))

    @property
    def field(self) -> tuple[int, ...]:
        """Pixels that an output sees, by axis."""
        out = []
        for axis in range(self.layers[0].dims):
            seen, stride = 1, 1
            for layer in self._conv():
                seen += (layer.extent[axis] - 1 + layer.pools[axis] - 1) * stride
                stride *= layer.pools[axis]
            out.append(seen)
        return tuple(out)

    def dense_by_fragments(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Linear outputs (examples, channels, axes) at every position, each layer once: a pool keeps all its shifts as fragments, which later layers pass as
        examples of their own. The number of positions along each axis must be a multiple of the stride."""
        h, pools = x.reshape(len(x), *self.shape), []
        for layer, par in zip(self._conv(), self.unpacked(w), strict=True):
            z = convolved(h, par[0])
            q = layer.pools
            if prod(q) > 1:
                n = tuple((s - p + 1) // p * p for s, p in zip(z.shape[2:], q, strict=True))
                if any((s + 1) % p for s, p in zip(z.shape[2:], q, strict=True)):
                    raise ValueError("fragments of unlike sizes: the positions are no multiple of the stride")
                blocks = [pool_blocks(z[_at(offset, n)], q) for offset in np.ndindex(*q)]
                z = np.concatenate([np.take_along_axis(b, pool_routes(b, layer.pooling)[..., None], -1)[..., 0] for b in blocks])
                pools.append(q)
            h = activated(layer, z + par[1].reshape(1, -1, *(1,) * layer.dims))
        for q in reversed(pools):
            dims, n = len(q), h.shape[2:]
            split = h.reshape(*q, -1, *h.shape[1:])
            h = split.transpose(dims, dims + 1, *(v for i in range(dims) for v in (dims + 2 + i, i))).reshape(-1, h.shape[1], *(a * b for a, b in zip(n, q, strict=True)))
        return h

    def dense_by_strides(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The same by running the whole network on every shift of the input."""
        x, s = x.reshape(len(x), *self.shape), self.strides
        n = tuple((a - f + 1) // b for a, f, b in zip(self.shape[1:], self.field, s, strict=True))
        part = self.at(tuple((a - 1) * b + f for a, b, f in zip(n, s, self.field, strict=True)))
        out = None
        for offset in np.ndindex(*s):
            z, _ = part.forward(w, x[_at(offset, part.shape[1:])])
            z = np.moveaxis(z.reshape(len(x), *n, -1), -1, 1)
            out = np.zeros((*z.shape[:2], *(a * b for a, b in zip(n, s, strict=True)))) if out is None else out
            out[(slice(None), slice(None), *(slice(o, None, b) for o, b in zip(offset, s, strict=True)))] = z
        return out


def probabilities_of(z: np.ndarray, target: str | Callable) -> np.ndarray:
    """Linear outputs (rows, channels) as probabilities: of each pair for affinities, of all classes else; as they are for regression."""
    if target == "nll_mutiple_binary":
        return 1.0 / (1.0 + np.exp(-z))
    if target == "regression":
        return z
    pairs = z.reshape(len(z), -1, 2 if target in ("affinity", "malis") else z.shape[1])
    p = np.exp(pairs - pairs.max(axis=2, keepdims=True))
    return (p / p.sum(axis=2, keepdims=True)).reshape(z.shape)


def voted_loss(z: np.ndarray, y: np.ndarray, class_weights: tuple[float, ...] | None = None, label_prop: float | None = None, flags: np.ndarray | None = None, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slope by z, votes) of each row: votes for the labelled class, where flags (rows, 2, classes) say that this class is labelled there, for a class of more than
    label_prop where no label is known, and against classes that flags say are absent."""
    p = probabilities_of(z, "nll")
    y = y.reshape(-1, 1)
    w = np.ones_like(p) if class_weights is None else np.broadcast_to(np.asarray(class_weights), p.shape)
    w = w if weights is None else w * weights
    up = (np.arange(p.shape[1]) == y) * (1.0 if flags is None else flags[:, 0])
    if label_prop is not None:
        up = up + (p > label_prop) * ((y < 0) if flags is None else 1.0 - flags[:, 0])
    absent = np.zeros_like(p) if flags is None else flags[:, 1]
    down = 1.0 - p * absent * w + EPS
    loss = (-np.log(p + EPS) * up * w - np.log(down) * (absent > 0)).sum(axis=1)
    by_p = -up * w / (p + EPS) + absent * w / down
    return loss, p * (by_p - (by_p * p).sum(axis=1, keepdims=True)), (up + absent).sum(axis=1)


def affinity_loss(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means over axes of the losses of pairs of outputs; y has a label (0, 1, or below 0 for unknown) for each row and axis."""
    heads = z.shape[1] // 2
    loss, slope, known = target_loss("nll", z.reshape(-1, 2), y.reshape(-1), 2)
    return loss.reshape(-1, heads).mean(axis=1), slope.reshape(z.shape) / heads, known.reshape(-1, heads).any(axis=1)


def lattice_edges(extent: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axis, first, second) of all neighbours on a grid, as flat positions; the second follows the first along the axis."""
    place = np.arange(prod(extent)).reshape(extent)
    found = [(np.full(a.size, axis), a.ravel(), b.ravel()) for axis in range(len(extent)) for a, b in [(np.take(place, range(extent[axis] - 1), axis), np.take(place, range(1, extent[axis]), axis))]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def malis_loss(z: np.ndarray, y: np.ndarray, n: int, extent: tuple[int, ...], restricted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slope by z, whether it counts) of n examples whose voxels have segments y: an edge's log-probability weighs as much as the voxel pairs that it joins
    rightly or wrongly. Counts of pairs stay as they are for the slope; an edge of unlike ends pays for being together, one within a segment for being
    apart."""
    axis, a, b = lattice_edges(extent)
    heads, n_vox = len(extent), prod(extent)
    p = probabilities_of(z, "malis").reshape(n, n_vox, heads, 2)
    segments = np.maximum(y.reshape(n, n_vox).astype(np.int64), 0)
    loss, slope = np.zeros(n), np.zeros((n, n_vox, heads, 2))
    for i in range(n):
        together = p[i, a, axis, 1]
        pos, neg = pair_counts(a, b, together, segments[i, a], segments[i, b], restricted)
        total = pos.sum() + neg.sum() + 1e-6
        apart = p[i, a, axis, 0]
        loss[i] = (np.where(pos > 0, -pos * np.log(together), 0.0) + np.where(neg > 0, -neg * np.log(apart), 0.0)).sum() / total
        by_z = (neg * together - pos * apart) / total
        slope[i, a, axis, 1], slope[i, a, axis, 0] = by_z, -by_z
    return loss, slope.reshape(z.shape), np.ones(n, bool)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, SLICE):
            yield whole.slice(k, SLICE)


def _flat(column: pa.Array, rows: int) -> np.ndarray:
    values = column.flatten() if pa.types.is_list(column.type) else column
    return np.asarray(values, np.float64).reshape(rows, -1)


def gradient(examples: DataFrame, net: Net, w: np.ndarray, step: int | None = None) -> tuple[float, np.ndarray, int]:
    """(mean loss, mean gradient, number) over examples (key and net.columns). A partition's sums leave as slices of the vector, which are added up slice by slice."""
    sent = examples.sparkSession.sparkContext.broadcast((net, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, w = sent.value
        total = np.zeros(len(w) + 2)
        for b in _batches(batches):
            more = {c: _flat(b.column(i), b.num_rows) for i, c in enumerate(b.schema.names) if i > 2}
            loss, g, n = net.loss_and_gradient(w, _flat(b.column(1), b.num_rows), _flat(b.column(2), b.num_rows), np.asarray(b.column(0)), step, **more)
            total += np.concatenate((g, [loss, n]))
        cuts = [total[i : i + SUM_VALUES] for i in range(0, len(total), SUM_VALUES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["slice", "sums"])

    sums = np.zeros(len(w) + 2)
    for r in _added(examples.select("key", *net.columns).mapInArrow(run, "slice int, sums binary")).collect():  # the weights' own size
        cut = np.frombuffer(r["sums"])
        sums[r["slice"] * SUM_VALUES :][: len(cut)] = cut
    n = max(sums[-1], 1.0)
    return float(sums[-2] / n), sums[:-2] / n, int(sums[-1])


def along(examples: DataFrame, net: Net, trials: np.ndarray, directions: np.ndarray, step: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(losses, slopes along the directions) at each row of trials: means over examples, all from one pass; two numbers a trial leave each partition."""
    sent = examples.sparkSession.sparkContext.broadcast((net, trials, directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, trials, directions = sent.value
        sums = np.zeros((3, len(trials)))
        for b in _batches(batches):
            more = {c: _flat(b.column(i), b.num_rows) for i, c in enumerate(b.schema.names) if i > 2}
            x, y, key = _flat(b.column(1), b.num_rows), _flat(b.column(2), b.num_rows), np.asarray(b.column(0))
            for k, (w, d) in enumerate(zip(trials, directions, strict=True)):
                loss, g, n = net.loss_and_gradient(w, x, y, key, step, **more)
                sums[:, k] += loss, g @ d, n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trials))), *map(pa.array, sums)], names=["k", "loss", "slope", "n"])

    found = examples.select("key", *net.columns).mapInArrow(run, "k long, loss double, slope double, n double").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("loss", "slope", "n"))).orderBy("k").collect()  # a row a trial
    out = np.array([(r["loss"], r["slope"], max(r["n"], 1.0)) for r in found]).reshape(-1, 3).T
    return out[0] / out[2], out[1] / out[2]


#: Values of a slice of summed gradients; partitions whose slices one task adds up in the first of two rounds.
SUM_VALUES, SUM_FAN = 65_536, 64


def _added(slices: DataFrame) -> DataFrame:
    """The sum of all rows of a slice, by two rounds: groups of partitions first, so that no task reads a row of every partition."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("sums"):
            v = np.frombuffer(x.as_buffer())
            total = v.copy() if total is None else total + v
        return pa.table([table.column("slice").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["slice", "sums"])

    for keys in ([F.col("slice"), F.spark_partition_id() % SUM_FAN], [F.col("slice")]):
        part = keys[1] if len(keys) > 1 else F.lit(0)
        slices = slices.withColumn("part", part).groupBy("slice", "part").applyInArrow(add, "slice int, sums binary")
    return slices


def outputs(examples: DataFrame, net: Net, w: np.ndarray, probabilities: bool = True) -> DataFrame:
    """(key, pos, c, p): each example's class probabilities (or linear outputs), pos the pixel (row by row) of nets of convolutions alone, else 0."""
    sent = examples.sparkSession.sparkContext.broadcast((net, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, w = sent.value
        for b in _batches(batches):
            z, _ = net.forward(w, _flat(b.column(1), b.num_rows), **{c: _flat(b.column(i), b.num_rows) for i, c in enumerate(b.schema.names) if i > 1})
            if probabilities:
                z = probabilities_of(z, net.target)
            each = len(z) // b.num_rows
            key = np.repeat(np.asarray(b.column(0)), each * z.shape[1])
            pos = np.tile(np.repeat(np.arange(each), z.shape[1]), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pos), pa.array(np.tile(np.arange(z.shape[1]), len(z))), pa.array(z.ravel())], names=["key", "pos", "c", "p"])

    return examples.select("key", "features", *getattr(net, "more_inputs", [])).mapInArrow(run, "key long, pos long, c long, p double")
