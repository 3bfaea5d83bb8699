"""The change feed: batches of assertions settle into belief, watchers get the difference."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mortise.operators.belief import difference
from mortise.operators.loops import settled


@dataclass
class Feed:
    """Belief that moves with each batch: settle(all assertions) -> belief; one batch is one event."""

    settle: Callable[[DataFrame], DataFrame]
    watchers: dict[str, tuple[Callable[[DataFrame, int], None], str | None]] = field(default_factory=dict)
    stated: DataFrame | None = None
    belief: DataFrame | None = None

    def watch(self, name: str, call: Callable[[DataFrame, int], None], condition: str | None = None) -> None:
        """call(changes, batch) after each settle; `condition` filters the changes, it doesn't run anew."""
        self.watchers[name] = (call, condition)

    def unwatch(self, name: str) -> None:
        self.watchers.pop(name, None)

    def apply(self, batch: DataFrame, number: int) -> None:
        """batch: fact columns and op (assert | retract). Retractions take effect before assertions of the same batch."""
        facts = [c for c in batch.columns if c != "op"]
        added, gone = (batch.where(F.col("op") == op).select(*facts).distinct() for op in ("assert", "retract"))
        before = self.stated if self.stated is not None else added.limit(0)
        self.stated = settled(before.join(gone, facts, "left_anti").union(added).distinct())
        old, self.belief = self.belief, settled(self.settle(self.stated))
        changes = settled(difference(old if old is not None else self.belief.limit(0), self.belief))
        for call, condition in list(self.watchers.values()):
            call(changes.where(condition) if condition else changes, number)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Follows a stream of assertions; each micro-batch is one settle."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()
