"""What a node is told when it starts, and the sink that follows from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .sinks import LogSink, Sink
from .store import LedgerStore

#: Which store a node uses, by whether the contract is there, a database is named, and debugging is on. Fixed values.
MODES = ((False, False, False, "disabled"), (False, True, False, "error"), (False, False, True, "error"), (False, True, True, "error"), (True, False, False, "error"), (True, False, True, "logging"), (True, True, False, "database"), (True, True, True, "error"))


@dataclass(frozen=True)
class Settings:
    """predeploy: whether the contract is there, as its code says. store: the folder of a ledger store. debug: whether
    changes go to a log in the folder `log` instead. arguments: of a store's own process, as one text."""

    predeploy: bool
    store: str | None = None
    debug: bool = False
    log: str | None = None
    arguments: str = ""

    @property
    def mode(self) -> str:
        return next(mode for p, u, d, mode in MODES if (p, u, d) == (self.predeploy, self.store is not None, self.debug))

    @property
    def argument_list(self) -> list[str]:
        return self.arguments.split()

    def sink(self, spark: SparkSession) -> Sink | None:
        """None where nothing is to be kept; an error where the settings don't go together."""
        if self.mode == "error":
            raise ValueError("the contract, a store and debugging don't go together like this")
        if self.mode == "logging":
            if self.log is None:
                raise ValueError("no folder for the log")
            return LogSink(self.log)
        return LedgerStore(spark, self.store) if self.mode == "database" else None
