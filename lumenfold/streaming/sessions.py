"""Sessions at the edge of a stream: every micro-batch is stored, and a store that fails does not end the session."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame


class Sink:
    """For `writeStream.foreachBatch`: writes each batch to the named stores; a failure is warned of and counted, the other stores go on.

    stores: name -> function of (batch, batch number). `history` keeps the last batches that a store did not take, as many as `kept`.
    """

    def __init__(self, stores: dict[str, Callable[[DataFrame, int], None]], kept: int = 100):
        self.stores, self.kept = stores, kept
        self.failures: dict[str, int] = dict.fromkeys(stores, 0)
        self.history: list[tuple[str, int]] = []

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, write in self.stores.items():
                try:
                    write(batch, number)
                except Exception as e:  # a store of any kind
                    self.failures[name] += 1
                    self.history = [*self.history, (name, number)][-self.kept :]
                    warnings.warn(f"{name} did not take batch {number}: {e}", stacklevel=2)
        finally:
            batch.unpersist()
