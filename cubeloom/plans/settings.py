"""Settings of a training run: the values of a file over a user's defaults over the built-in ones, checked before anything runs."""

from __future__ import annotations

import difflib
import json
import types
import typing
import warnings
from dataclasses import dataclass, field, fields

# Names that users type in configurations.
OPTIMISERS = ("SGD", "Adam", "RPROP", "CG", "LBFGS")


def nearest(kind: str, name: str, known: list[str]) -> KeyError:
    """The error of an unknown name, which says the nearest known one."""
    return KeyError(f"unknown {kind} {name!r}; did you mean {difflib.get_close_matches(name, known, 1, 0.0)[0]!r}?")


def of_type(value: object, hint: object) -> bool:
    """Whether a value read from JSON is of a field's type; whole numbers are numbers, true and false are not."""
    if isinstance(hint, types.UnionType) or typing.get_origin(hint) is typing.Union:
        return any(of_type(value, h) for h in typing.get_args(hint))
    if typing.get_origin(hint) is list:
        return isinstance(value, list | tuple) and all(of_type(v, typing.get_args(hint)[0]) for v in value)
    if hint in (int, float):
        return not isinstance(value, bool) and isinstance(value, int if hint is int else int | float)
    return isinstance(value, hint)


def checked_values(cls: type, values: dict) -> dict:
    """values, where each is a field of the dataclass and of its type; else an error that names it."""
    known, hints = [f.name for f in fields(cls)], typing.get_type_hints(cls)
    for k, v in values.items():
        if k not in known:
            raise nearest("key", k, known)
        if not of_type(v, hints[k]):
            raise ValueError(f"{k} must be {getattr(hints[k], '__name__', hints[k]) if isinstance(hints[k], type) else hints[k]}, not {v!r}")
    return values


@dataclass
class TrainingSettings:
    """How a network is trained. valid_share: examples set aside for evaluation, by a draw that each keeps; schedule: pairs of a number of steps and the rate set after them; save: a folder for the weights, which must
    not exist yet unless overwrite."""

    steps: int = 10
    mode: str = "SGD"
    n_batches: int = 1
    rate: float = 0.1
    momentum: float = 0.9
    weight_decay: float = 0.0
    decay: float = 1.0
    decay_every: int = 1000
    schedule: list[list[float]] = field(default_factory=list)
    seed: int = 0
    valid_share: float = 0.0
    evaluate_every: int = 0
    save_every: int = 0
    most_seconds: float | None = None
    save: str | None = None
    overwrite: bool = False

    def __post_init__(self) -> None:
        if self.mode not in OPTIMISERS:
            raise ValueError(f"mode must be one of {', '.join(OPTIMISERS)}")
        for name in ("steps", "n_batches", "decay_every"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        if not all(len(p) == 2 and p[0] >= 0 and p[0] == int(p[0]) for p in self.schedule):
            raise ValueError("schedule has pairs of a number of steps and a rate")
        if not 0 <= self.valid_share < 1:
            raise ValueError("valid_share must be 0 or more, and below 1")
        if self.evaluate_every and not self.valid_share:
            raise ValueError("evaluate_every needs a valid_share")
        if self.save_every and not self.save:
            raise ValueError("save_every needs a folder to save in")

    @classmethod
    def parsed(cls, values: dict) -> TrainingSettings:
        return cls(**checked_values(cls, values))


SECTIONS = ("network", "training")


def _sections(path: str) -> dict[str, dict]:
    with open(path) as f:
        given = json.load(f)
    if not isinstance(given, dict):
        raise ValueError(f"{path} must hold an object")
    if not any(s in given for s in SECTIONS):  # keys of the network alone
        given = {"network": given}
    for s in given:
        if s not in SECTIONS:
            raise nearest("section", s, list(SECTIONS))
        if not isinstance(given[s], dict):
            raise ValueError(f"{path}: {s} must be an object")
    return given


def read_settings(path: str, defaults: str | None = None) -> tuple[dict, dict]:
    """(values of the network, of the training) of a JSON file with sections network and training, or with the network's keys alone; keys that it lacks are those of
    a file of defaults of the same form. Nothing of either is executed. A network that leaves what decides its form to built-in values gives a warning."""
    base, own = _sections(defaults) if defaults else {}, _sections(path)
    network, training = ({**base.get(s, {}), **own.get(s, {})} for s in SECTIONS)
    wanted = ["mode", "n_lab", *(["mlp"] if network.get("mode") == "vect-scalar" else ["side", "filters", "pool", "n_filters"])]
    if missing := [k for k in wanted if k not in network]:
        warnings.warn(f"{path}: built-in values stand in for {', '.join(missing)}", stacklevel=2)
    return network, training
