"""Steps of a simulation: which blocks can be drawn together, given which earlier blocks each one reads.

A step is either a level, all blocks whose sources are done, or, where a level would be narrow, the next STRETCH blocks of the
path, which one task works off in order. So no group grows with the path, and each step does STRETCH blocks or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: Blocks of a stretch of the path; a level with fewer is not worth a step of its own.
STRETCH = 2048


def steps(blocks: DataFrame, reads: DataFrame, stretch: int = STRETCH) -> tuple[DataFrame, list[bool]]:
    """(block_id, step) of ``blocks`` (block_id, pos), and for each step whether its blocks are a stretch.

    ``reads``: (block_id, src_id), sources that come earlier in the path. Only edges between blocks that are not yet done are
    carried from step to step. A path whose blocks each read the one before has no level wider than one: it is all stretches.
    """
    todo, left = stage(blocks.select("block_id", "pos")), stage(reads.select("block_id", "src_id").distinct())
    n, done, narrow = todo.count(), [], []
    while n:
        level = stage(todo.join(left.select("block_id").distinct(), "block_id", "left_anti"))
        width = level.count()
        narrow.append(width < min(stretch, n))
        if narrow[-1]:
            level = stage(todo.orderBy("pos").limit(stretch))
            width = min(stretch, n)
        gone = level.select("block_id")
        done.append(gone.withColumn("step", F.lit(len(narrow) - 1)))
        n -= width
        if n:
            todo = stage(todo.join(gone, "block_id", "left_anti"))
            left = stage(left.join(gone, "block_id", "left_anti").join(gone.withColumnRenamed("block_id", "src_id"), "src_id", "left_anti"))
    out = done[0] if done else blocks.select("block_id", F.lit(0).alias("step")).limit(0)
    for part in done[1:]:
        out = out.unionByName(part)
    return stage(out), narrow
