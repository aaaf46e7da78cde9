"""Makers of models by name, so that settings can say which one a flow asks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from boxloom.plans import detect
from boxloom.plans.detect import Model

_MAKERS: dict[str, Callable[..., Model]] = {"replay": detect.replay, "live": detect.live}


def register(name: str, maker: Callable[..., Model]) -> None:
    """Have ``maker`` make the models called ``name``; a name that is taken is an error."""
    if name in _MAKERS:
        raise ValueError(f"there is a maker of {name!r} already")
    _MAKERS[name] = maker


def known() -> list[str]:
    return sorted(_MAKERS)


def model(name: str, *args: Any, **config: Any) -> Model:
    """The model that the maker called ``name`` makes."""
    if name not in _MAKERS:
        raise ValueError(f"no maker is called {name!r}; there are {', '.join(known())}")
    return _MAKERS[name](*args, **config)
