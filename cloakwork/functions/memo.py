"""Expressions that are built once: large ones cost seconds of calls to the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def remembered(build: Callable) -> Callable:
    """``build`` called once for equal arguments in the same JVM; another JVM starts anew."""
    built: dict = {}
    of: list = [None]  # the gateway itself, not its id, which a later one could have

    @wraps(build)
    def once(*args):
        if of[0] is not SparkContext._gateway:
            built.clear()
            of[0] = SparkContext._gateway
        if args not in built:
            built[args] = build(*args)
        return built[args]

    return once
