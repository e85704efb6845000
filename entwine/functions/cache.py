"""Columns built once per JVM: an unresolved column can go into any number of plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def per_jvm(build: Callable) -> Callable:
    """Remembers the result of ``build`` for its arguments while the gateway to the JVM lives.

    Each node of a column is a call to the JVM, so long expressions cost more to build than to plan.
    """
    known: dict[tuple, tuple] = {}

    @wraps(build)
    def run(*args):
        gateway = SparkContext._gateway
        have = known.get(args)
        if have is None or have[0] is not gateway:
            have = known[args] = (gateway, build(*args))
        return have[1]

    return run
