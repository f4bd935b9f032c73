"""Order of work: chunks, their priority, successors and timing."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

FORWARD, BACKWARD = 0, 1


@dataclass(frozen=True)
class Chunk:
    """A range of rows of a partition at one step of an epoch."""

    chunk: int
    part: int
    low: int
    high: int
    layer: int = 0
    direction: int = FORWARD
    epoch: int = 1
    vertex: bool = True

    def priority(self) -> tuple:
        """Lower epochs first, forward first, layers in the order of the direction, vertices before edges going forward
        and after them going back."""
        layer = self.layer if self.direction == FORWARD else -self.layer
        kind = self.vertex == (self.direction == BACKWARD)
        return (self.epoch, self.direction, layer, kind, self.part, self.chunk)


def chunks_of(n: int, k: int, part: int = 0) -> list[Chunk]:
    """k ranges of ceil(n / k) rows; the last ends at n and may be empty."""
    size = -(-n // k)
    return [Chunk(c, part, min(c * size, n), min((c + 1) * size, n)) for c in range(k)]


def next_gcn(c: Chunk, layers: int) -> Chunk:
    """Forward through the layers; the last is fused with its backward step; then back to 0 and on to the next epoch."""
    if c.direction == FORWARD:
        return replace(c, layer=c.layer + 1) if c.layer + 1 < layers else replace(c, direction=BACKWARD)
    return replace(c, layer=c.layer - 1) if c.layer else replace(c, direction=FORWARD, epoch=c.epoch + 1)


def next_gat(c: Chunk) -> Chunk:
    """The last forward layer turns round in the prediction step, so forward only counts up."""
    if c.direction == FORWARD:
        return replace(c, layer=c.layer + 1)
    return replace(c, layer=c.layer - 1) if c.layer else replace(c, direction=FORWARD, vertex=True, epoch=c.epoch + 1)


def absolute_layer(c: Chunk, layers: int) -> int:
    return c.layer if c.direction == FORWARD else 2 * layers - 1 - c.layer


def is_last(c: Chunk) -> bool:
    return c.direction == BACKWARD and c.layer == 0 and c.vertex


def may_run(epoch: int, slowest: int, staleness: int | None) -> bool:
    """Whether an epoch may start while the slowest partition is at another; None: no bound."""
    return staleness is None or epoch <= slowest + staleness


def by_priority(chunks: DataFrame) -> DataFrame:
    """rows (epoch, direction, layer, vertex, part, chunk) -> the same with rank order columns, smallest first."""
    layer = F.when(F.col("direction") == FORWARD, F.col("layer")).otherwise(-F.col("layer"))
    kind = (F.col("vertex") == (F.col("direction") == BACKWARD)).cast("int")
    return chunks.withColumns({"layer_order": layer, "kind_order": kind}).orderBy("epoch", "direction", "layer_order", "kind_order", "part", "chunk")


def epoch_times(metrics: DataFrame) -> DataFrame:
    """metrics (epoch, ms) -> one row: sync average without epoch 0, async average over all."""
    return metrics.agg(F.avg(F.when(F.col("epoch") > 0, F.col("ms"))).alias("sync_ms"), (F.sum("ms") / F.count("*")).alias("async_ms"))
