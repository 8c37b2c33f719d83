"""What the operators of this subpackage share: tables, scratch space on shared storage, shipping of the package."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from stemspark.storage import BROADCAST_ROWS, forget, scratch, ship, small, stored  # noqa: F401

#: Links up to which one task finds their components (some 40 MB of its memory). Level by level they take some 30 stages, and
#: the driver keeps an account of every task of those.
ONE_TASK_LINKS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def task_partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


_RELEASES: dict[str, Callable[[], None]] = {}


def holds(owner: str, release: Callable[[], None]) -> None:
    """Says how to let go what an operator keeps in a Python worker between its tasks."""
    _RELEASES[owner] = release


def sole(owner: str) -> None:
    """Lets go what other operators keep in this worker: workers outlive a query's stages, and executors count their memory."""
    others = [o for o in _RELEASES if o != owner]
    for other in others:
        _RELEASES.pop(other)()
    if others:
        gc.collect()


class Bounded(dict):
    """A cache that forgets everything once it holds `most` entries."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __setitem__(self, key, value):
        if len(self) >= self.most:
            self.clear()
        super().__setitem__(key, value)
