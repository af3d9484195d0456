"""Parameters of a network and the decay functions that weigh sentence distance."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

_BUILT_IN: dict[str, Callable[[int], float]] = {
    "constant": lambda delta: 1.0,
    "exponential": lambda delta: math.exp(-delta),
    "inverse": lambda delta: 1.0 / (1.0 + delta),
}
_registered: dict[str, Callable[[int], float]] = {}


def register_decay(name: str, function: Callable[[int], float]) -> None:
    """Make a decay available by name. "linear" depends on the window and can't be replaced."""
    if not name or name == "linear":
        raise ValueError("a decay needs a name, and it can't be 'linear'")
    _registered[name] = function


def available_decays() -> list[str]:
    return sorted({*_BUILT_IN, *_registered, "linear"})


def decay_values(decay: str | Callable[[int], float], window: int) -> list[float]:
    """The decay at each sentence distance 0..window; unknown names raise KeyError."""
    if callable(decay):
        function = decay
    elif decay == "linear":
        return [1.0 - d / (window + 1) for d in range(window + 1)]
    elif decay in _registered or decay in _BUILT_IN:
        function = _registered.get(decay) or _BUILT_IN[decay]
    else:
        raise KeyError(f"unknown decay {decay!r}; available: {', '.join(available_decays())}")
    return [float(function(d)) for d in range(window + 1)]


@dataclass(frozen=True)
class NetworkConfig:
    """How a network is built.

    window: largest sentence distance of a cooccurrence. decay: weight by distance. Terms: whether stop words and punctuation count,
    which part-of-speech tags do (None: all), whether lemmas replace surfaces and whether they are lower-cased. store_text: whether
    sentence texts are kept for contexts.
    """

    window: int = 2
    decay: str | Callable[[int], float] = "exponential"
    include_stopwords: bool = False
    include_punctuation: bool = False
    term_pos: tuple[str, ...] | None = None
    use_lemma: bool = True
    lowercase_terms: bool = True
    store_text: bool = True

    def __post_init__(self):
        if self.window < 0:
            raise ValueError("window must be 0 or more")
        decay_values(self.decay, self.window)

    @property
    def decays(self) -> list[float]:
        return decay_values(self.decay, self.window)

    def to_json(self) -> str:
        """Stored with the decay's values, so that a custom function needn't be there when the network is read."""
        shown = asdict(self) | {"decay": self.decay if isinstance(self.decay, str) else "custom", "decays": self.decays}
        return json.dumps(shown, default=str)

    @classmethod
    def from_json(cls, text: str) -> NetworkConfig:
        stored = json.loads(text)
        values = stored.pop("decays")
        if stored["term_pos"] is not None:
            stored["term_pos"] = tuple(stored["term_pos"])
        stored["decay"] = values.__getitem__
        return cls(**stored)
