"""Named actions (namespace, name) -> function of keyword text arguments, for scripts and notebooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ACTIONS: dict[tuple[str, str], Callable[..., DataFrame]] = {}


def register(namespace: str, name: str, action: Callable[..., DataFrame]) -> bool:
    """False, and nothing registered, where the name is taken."""
    if (namespace, name) in _ACTIONS:
        return False
    _ACTIONS[namespace, name] = action
    return True


def available(namespace: str | None = None) -> list[str]:
    return sorted(f"{a}.{b}" for a, b in _ACTIONS if namespace in (None, a))


def call(spark: SparkSession, namespace: str, name: str, **arguments: str) -> DataFrame:
    if (namespace, name) not in _ACTIONS:
        raise KeyError(f"no action {namespace}.{name}")
    return _ACTIONS[namespace, name](spark, **arguments)
