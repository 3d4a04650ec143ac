"""Jobs side by side, and tables held until something changes them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame

T = TypeVar("T")


def together(jobs: dict[str, Callable[[], T]]) -> dict[str, T]:
    """Runs independent jobs at the same time, so that Spark may share its cores among them; the first failure is raised once all have ended."""
    if not jobs:
        return {}
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = {name: pool.submit(job) for name, job in jobs.items()}
    return {name: r.result() for name, r in running.items()}


class Held:
    """Tables by name, computed on first use and kept until they, or what they depend on, are said to have changed."""

    def __init__(self) -> None:
        self._make: dict[str, tuple[Callable[[], DataFrame], tuple[str, ...]]] = {}
        self._kept: dict[str, DataFrame] = {}

    def define(self, name: str, make: Callable[[], DataFrame], *of: str) -> None:
        """of: the names that this table is made from."""
        self._make[name] = (make, of)

    def get(self, name: str) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = self._make[name][0]().persist()
        return self._kept[name]

    def changed(self, name: str) -> list[str]:
        """Forgets this table and all that are made from it; returns the names of those that were kept."""
        gone = [name]
        for n in gone:
            gone += [m for m, (_, of) in self._make.items() if n in of and m not in gone]
        kept = [n for n in gone if n in self._kept]
        for n in kept:
            self._kept.pop(n).unpersist()
        return kept
