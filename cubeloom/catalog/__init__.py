"""Every operator as a named query over the standard tables, each beside its SQL twin."""

from . import arrays, augmentation, inference, layers, loading, losses, monitoring, planning, sampling, training, volumes  # noqa: F401
