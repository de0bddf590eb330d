"""Networks whose layers take any earlier output or input, share parameters, and have several heads.

A graph has the same use as nets.Net: gradient, outputs, searches and the trainer take either. Slopes of an output that several layers read are added up, and so are gradients of
parameters that several layers have.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import prod

import numpy as np

from .nets import Layer, initial_of, layer_output, layer_slopes, target_loss


@dataclass(frozen=True)
class Node:
    """A named layer over the outputs of sources (nodes or inputs; several are joined by channel, or by value where the layer is dense).

    share: a node whose parameters it has too; tied: only that node's weights, transposed, with a bias of its own (dense). noise: deviation of what is added to its input
    in training.
    """

    name: str
    layer: Layer
    sources: tuple[str, ...]
    share: str | None = None
    tied: bool = False
    noise: float = 0.0


@dataclass(frozen=True)
class Head:
    """A loss over a node's linear outputs: its target (as in nets.Net, not over affinities), the column that has the labels, and its weight in the sum."""

    node: str
    target: str | Callable = "nll"
    labels: str = "label"
    weight: float = 1.0


def noise_of(key: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(examples, n) normal values that hang on the example's key alone."""
    return np.stack([np.random.default_rng((int(k) & 0xFFFFFFFF, seed)).normal(size=n) for k in key])


@dataclass
class Graph:
    """inputs: {column: shape}, the first being features; nodes in an order in which sources come first; heads: losses, the first of which is the one that outputs and
    errors are of. shapes, n_weights and columns follow."""

    inputs: dict[str, tuple[int, ...]]
    nodes: list[Node]
    heads: list[Head]
    sizes: dict[str, list[tuple[int, ...]]] = field(init=False)

    def __post_init__(self) -> None:
        if next(iter(self.inputs), None) != "features":
            raise ValueError("the first input must be features")
        known, by_name, self.sizes = set(self.inputs), {}, {}
        for x in self.nodes:
            if x.name in known or not x.sources or not known.issuperset(x.sources):
                raise ValueError(f"{x.name} needs a name of its own, and sources before it")
            if x.tied and (x.share is None or x.layer.kind != "dense"):
                raise ValueError(f"{x.name}: tied weights are those of a dense layer")
            if x.share is not None:
                if x.share not in by_name or by_name[x.share].share is not None and not by_name[x.share].tied:
                    raise ValueError(f"{x.name} shares parameters of a node before it that has its own")
                has, wants = by_name[x.share].layer.shapes(), x.layer.shapes()
                if (has[0][::-1] != wants[0]) if x.tied else (has != wants):
                    raise ValueError(f"{x.name} does not fit the parameters of {x.share}")
            self.sizes[x.name] = x.layer.shapes()[1:] if x.tied else [] if x.share else x.layer.shapes()
            known.add(x.name)
            by_name[x.name] = x
        for h in self.heads:
            if h.node not in by_name or by_name[h.node].layer.act != "linear" or h.target in ("affinity", "malis"):
                raise ValueError(f"{h.node}: a head is a linear node, and its target none over affinities")
        self.by_name = by_name

    @property
    def layers(self) -> list[Layer]:
        return [x.layer for x in self.nodes]

    @property
    def target(self) -> str | Callable:
        return self.heads[0].target

    @property
    def more_inputs(self) -> list[str]:
        return list(self.inputs)[1:]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(["features", "label", *self.more_inputs, *(h.labels for h in self.heads)]))

    @property
    def n_weights(self) -> int:
        return sum(prod(s) for sizes in self.sizes.values() for s in sizes)

    def unpacked(self, w: np.ndarray) -> dict[str, list[np.ndarray]]:
        """Each node's parameters; shared ones are views of the same numbers."""
        out, at = {}, 0
        for x in self.nodes:
            own = []
            for s in self.sizes[x.name]:
                own.append(w[at : at + prod(s)].reshape(s))
                at += prod(s)
            out[x.name] = [out[x.share][0].T, *own] if x.tied else out[x.share] if x.share else own
        return out

    def initial(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([v.ravel() for x in self.nodes for v in initial_of(x.layer, self.sizes[x.name], rng)] or [np.zeros(0)])

    def _run(self, w: np.ndarray, values: dict[str, np.ndarray], key: np.ndarray | None, step: int | None) -> tuple[dict[str, np.ndarray], dict[str, tuple]]:
        par, kept = self.unpacked(w), {}
        for i, x in enumerate(self.nodes):
            given = [values[n] for n in x.sources]
            if x.layer.kind == "dense":
                given = [v.reshape(len(v), -1) for v in given]
            v = np.concatenate(given, axis=1) if len(given) > 1 else given[0]
            if x.noise and step is not None:
                v = v + x.noise * noise_of(key, prod(v.shape[1:]), step * 1009 + i).reshape(v.shape)
            values[x.name], kept[x.name] = layer_output(x.layer, par[x.name], v, key, step, i)
        return values, kept

    def _given(self, x: np.ndarray, more: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {c: (x if c == "features" else more[c]).reshape(len(x), *shape) for c, shape in self.inputs.items()}

    def _rows(self, name: str, z: np.ndarray) -> np.ndarray:
        return np.moveaxis(z, 1, -1).reshape(-1, z.shape[1]) if self.by_name[name].layer.kind == "conv" else z

    def forward(self, w: np.ndarray, x: np.ndarray, key: np.ndarray | None = None, step: int | None = None, **more: np.ndarray) -> tuple[np.ndarray, dict]:
        """(linear outputs of the first head, every node's output)."""
        values, _ = self._run(w, self._given(x, more), key, step)
        return self._rows(self.heads[0].node, values[self.heads[0].node]), values

    def loss_and_gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, key: np.ndarray | None = None, step: int | None = None, **more: np.ndarray) -> tuple[float, np.ndarray, int]:
        """(sum of losses, their gradient, how many count in the first head). A further head's losses are brought to the first one's number of rows."""
        values, kept = self._run(w, self._given(x, more), key, step)
        labels = {"features": x, "label": y, **more}
        slopes: dict[str, np.ndarray] = {}
        total, count = 0.0, 0
        for i, h in enumerate(self.heads):
            z = values[h.node]
            rows = self._rows(h.node, z)
            given = np.asarray(labels[h.labels])
            loss, slope, known = target_loss(h.target, rows, given.reshape(len(rows), -1) if h.target in ("regression", "nll_mutiple_binary") or callable(h.target) else given, rows.shape[1])
            n = int(known.sum())
            count = n if i == 0 else count
            share = h.weight * (1.0 if i == 0 else count / max(n, 1))
            total += share * float(loss.sum())
            if z.ndim > 2:
                slope = np.moveaxis(slope.reshape(len(z), *z.shape[2:], z.shape[1]), -1, 1)
            slopes[h.node] = slopes.get(h.node, 0.0) + share * slope
        par, grads = self.unpacked(w), {x.name: [np.zeros(s) for s in x.layer.shapes()] for x in self.nodes}
        for x in reversed(self.nodes):
            if x.name not in slopes:
                continue
            at_x, own = layer_slopes(x.layer, par[x.name], kept[x.name], slopes[x.name])
            for g, v in zip(grads[x.name], own, strict=True):
                g += v
            at, axis_sizes = 0, [values[n].shape for n in x.sources]
            at_x = at_x.reshape(len(at_x), -1) if x.layer.kind == "dense" else at_x
            for n, shape in zip(x.sources, axis_sizes, strict=True):
                width = prod(shape[1:]) if x.layer.kind == "dense" else shape[1]
                if n in self.by_name:
                    slopes[n] = slopes.get(n, 0.0) + at_x[:, at : at + width].reshape(shape)
                at += width
        for x in reversed(self.nodes):  # parameters of a node that shares them count where they are
            if x.tied:
                grads[x.share][0] += grads[x.name][0].T
            elif x.share:
                for g, v in zip(grads[x.share], grads[x.name], strict=True):
                    g += v
        own = [g.ravel() for x in self.nodes for g in (grads[x.name][1:] if x.tied else [] if x.share else grads[x.name])]
        return total, np.concatenate(own or [np.zeros(0)]), count


def tied_autoencoder(n_in: int, widths: list[int], act: str = "tanh", noise: float = 0.3, tied: bool = True) -> Graph:
    """Dense layers and their inversion from the deepest on, with transposed weights (if tied) and noise at the first inverted layer; trained to give back the features."""
    sizes = [n_in, *widths]
    nodes = [Node(f"down{i}", Layer("dense", a, b, act), (f"down{i - 1}" if i else "features",)) for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True))]
    for k, i in enumerate(reversed(range(len(widths)))):
        layer = Layer("dense", sizes[i + 1], sizes[i], "linear" if i == 0 else act)
        nodes.append(Node(f"up{i}", layer, (f"up{i + 1}" if k else f"down{i}",), f"down{i}" if tied else None, tied, noise if k == 0 else 0.0))
    return Graph({"features": (n_in,)}, nodes, [Head("up0", "regression", "features")])
