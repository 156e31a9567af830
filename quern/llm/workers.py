"""What Python workers share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame


@contextmanager
def no_cycles() -> Iterator[None]:
    """For code that makes many objects and no cycles: the cycle collector would walk the workers' large tables again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def tasks_for(manifest: DataFrame, per_task: int) -> int:
    """Into how many tasks the files of a written manifest are dealt: per_task each, and no fewer tasks than shuffles have unless files are fewer."""
    files = manifest.count()
    return max(1, min(files, max(-(-files // per_task), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
