"""Plug-in points: sources, steps and sinks of one's own, and what happens around every sink."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from spillway.plans.spec import PLUGGED

#: kind -> function; asked before the built-in kinds.
SOURCES: dict[str, Callable[..., Any]] = {}
STEPS: dict[str, Callable[..., Any]] = {}
SINKS: dict[str, Callable[..., Any]] = {}
#: Called in order with (node, sink, df) before a sink writes; what one returns, the next gets.
DECORATORS: list[Callable[..., Any]] = []
#: Python functions that a groovy-map step may name: rows as dicts in, a dict or None out.
FUNCTIONS: dict[str, Callable[[dict], dict | None]] = {}
#: Tag -> (field, function of a Column of one text) of jvs-enrich; model -> function (texts, source, target) of jvs-translate.
ENRICHERS: dict[str, tuple[str, Callable[..., Any]]] = {}
TRANSLATORS: dict[str, Callable[..., Any]] = {}


def _register(what: str, held: dict[str, Callable[..., Any]], kind: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    def put(f: Callable[..., Any]) -> Callable[..., Any]:
        held[kind] = f
        PLUGGED[what].add(kind)
        return f

    return put


def register_source(kind: str) -> Callable[..., Any]:
    """The function gets (context, args) and returns a DataFrame."""
    return _register("source", SOURCES, kind)


def register_step(kind: str) -> Callable[..., Any]:
    """The function gets (df, args, context) and returns a DataFrame."""
    return _register("step", STEPS, kind)


def register_sink(kind: str) -> Callable[..., Any]:
    """The function gets (df, args, context) and writes."""
    return _register("sink", SINKS, kind)


def decorate_sinks(f: Callable[..., Any]) -> Callable[..., Any]:
    DECORATORS.append(f)
    return f


def register_function(name: str) -> Callable[..., Any]:
    def put(f: Callable[[dict], dict | None]) -> Callable[[dict], dict | None]:
        FUNCTIONS[name] = f
        return f

    return put


def register_enricher(tag: str, field: str) -> Callable[..., Any]:
    """The function gets a Column of one text and returns the Column that ``field`` takes."""

    def put(f: Callable[..., Any]) -> Callable[..., Any]:
        ENRICHERS[tag] = field, f
        return f

    return put


def register_translator(model: str) -> Callable[..., Any]:
    """The function gets (texts, source language or None, target language) and returns as many texts."""

    def put(f: Callable[..., Any]) -> Callable[..., Any]:
        TRANSLATORS[model] = f
        return f

    return put
