"""Plugins: named transforms of frames with declared parameters, which are checked when the plan is built.

    @plugin("fade", "Fades the images.", amount=Parameter("float", 0.5, low=0.0, high=1.0))
    def fade(frame, amount): ...

A plugin returns a frame, or a PluginResult of images, canvases and layers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class PluginError(ValueError):
    """`kind` is "invalid parameters", "execution failed" or "not found"."""

    def __init__(self, kind: str, text: str):
        super().__init__(f"{kind}: {text}")
        self.kind = kind


@dataclass(frozen=True)
class Parameter:
    """A parameter's kind ("string", "integer", "float", "bool", "path"), default, and what values it takes. One without a default must be given."""

    kind: str
    default: Any = None
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def checked(self, name: str, value: Any) -> Any:
        """The value in its kind; a whole number may stand for a float, nothing else for another kind."""
        kinds = {"string": str, "integer": int, "float": (int, float), "bool": bool, "path": str}
        if self.kind not in kinds:
            raise PluginError("invalid parameters", f"{name} has the unknown kind {self.kind}")
        if not isinstance(value, kinds[self.kind]) or (isinstance(value, bool) and self.kind != "bool"):
            raise PluginError("invalid parameters", f"{name} takes a value of kind {self.kind}, not {value!r}")
        if self.kind == "float":
            value = float(value)
            if not math.isfinite(value):
                raise PluginError("invalid parameters", f"{name} takes a finite number")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise PluginError("invalid parameters", f"{name} takes values from {self.low} to {self.high}, not {value!r}")
        if self.choices and value not in self.choices:
            raise PluginError("invalid parameters", f"{name} takes one of {', '.join(map(str, self.choices))}, not {value!r}")
        return value


@dataclass
class PluginResult:
    """What a plugin has made."""

    canvases: list = field(default_factory=list)
    images: list = field(default_factory=list)
    layers: list = field(default_factory=list)

    def is_empty(self) -> bool:
        return not (self.canvases or self.images or self.layers)

    def add_canvas(self, canvas) -> PluginResult:
        self.canvases.append(canvas)
        return self

    def add_image(self, frame) -> PluginResult:
        self.images.append(frame)
        return self

    def add_layer(self, layer) -> PluginResult:
        self.layers.append(layer)
        return self

    def canvas_at(self, index: int):
        return self.canvases[index] if 0 <= index < len(self.canvases) else None

    def image_at(self, index: int):
        return self.images[index] if 0 <= index < len(self.images) else None

    def layer_at(self, index: int):
        return self.layers[index] if 0 <= index < len(self.layers) else None


@dataclass(frozen=True)
class Plugin:
    name: str
    description: str
    change: Callable
    parameters: dict[str, Parameter] | None


PLUGINS: dict[str, Plugin] = {}


def plugin(name: str, description: str = "", **parameters: Parameter) -> Callable:
    """Registers a transform under a name. Without declared parameters, it takes what it is given."""

    def keep(change: Callable) -> Callable:
        PLUGINS[name] = Plugin(name, description, change, parameters or None)
        return change

    return keep


def checked(own: Plugin, given: dict[str, Any]) -> dict[str, Any]:
    """All of a plugin's parameters, given ones checked, others by their defaults."""
    if own.parameters is None:
        return given
    unknown = sorted(set(given) - set(own.parameters))
    if unknown:
        raise PluginError("invalid parameters", f"{own.name} has no {', '.join(unknown)}")
    missing = sorted(n for n, p in own.parameters.items() if n not in given and p.default is None)
    if missing:
        raise PluginError("invalid parameters", f"{own.name} needs {', '.join(missing)}")
    return {n: p.checked(n, given.get(n, p.default)) for n, p in own.parameters.items()}


def run(name: str, frame, given: dict[str, Any]) -> PluginResult:
    """The plugin's result; an empty one is an error."""
    if name not in PLUGINS:
        raise PluginError("not found", f"there is no plugin {name}")
    own = PLUGINS[name]
    made = own.change(frame, **checked(own, given))
    result = made if isinstance(made, PluginResult) else PluginResult().add_image(made)
    if result.is_empty():
        raise PluginError("execution failed", f"{name} made nothing")
    return result
