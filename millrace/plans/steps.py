"""A chain of named steps over lazy frames.

Each step is a function of the chain state and returns the next current frame. Nothing
runs until an action: the whole chain is one Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass
class State:
    """What a step sees: the current frame, the named frames, and free parameters."""

    current: DataFrame | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)
    parameters: Mapping[str, object] = field(default_factory=dict)


Step = Callable[[State], object]


def _slot(name: str | None) -> str | None:
    if name is None:
        return None
    cleaned = str(name).strip()
    if not cleaned:
        raise ValueError("A frame name must not be empty.")
    if cleaned == "current":
        raise ValueError("The name 'current' is reserved.")
    return cleaned


@dataclass(frozen=True)
class StepChain:
    """An immutable list of steps."""

    steps: tuple[tuple[Step, str | None, str | None], ...] = ()

    def step(
        self, function: Step, *, use: str | None = None, save_as: str | None = None
    ) -> "StepChain":
        """Append a step; ``use`` loads a named frame first, ``save_as`` names the result."""
        if not callable(function):
            raise ValueError("A step is a function of the state.")
        return replace(self, steps=(*self.steps, (function, _slot(use), _slot(save_as))))

    def _run(self, state: State, until: str | None):
        for function, use, save_as in self.steps:
            if use is not None:
                if use not in state.frames:
                    raise KeyError(f"There is no frame named {use!r}.")
                state.current = state.frames[use]
            state.current = function(state)
            if save_as is not None:
                state.frames[save_as] = state.current
                if save_as == until:
                    return state.current
        if until is not None:
            raise KeyError(f"No step saves a frame named {until!r}.")
        return state.current

    def run(self, current: DataFrame | None = None, **parameters):
        """The result of the last step."""
        return self._run(State(current, parameters=parameters), None)

    def preview(self, name: str, current: DataFrame | None = None, **parameters):
        """A named frame, without calling the steps after it."""
        return self._run(State(current, parameters=parameters), _slot(name))
