"""Long operations: a thread on the driver with a Spark job group, which can be awaited and cancelled."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from ..errors import EvidenceError

FOREGROUND_SECONDS, DEADLINE_SECONDS, LEASE_SECONDS, RESULT_SECONDS = 5.0, 600.0, 120.0, 600.0
MAX_PENDING, MAX_HELD = 8, 32


@dataclass
class Operation:
    id: str
    state: str = "running"  #: running, complete, failed, cancelled or expired
    result: Any = None
    error: BaseException | None = None
    begun: float = 0.0
    asked: float = 0.0
    ended: float | None = None
    done: threading.Event = field(default_factory=threading.Event, repr=False)


class Operations:
    def __init__(self, spark: SparkSession, clock: Callable[[], float] = time.monotonic, deadline: float = DEADLINE_SECONDS):
        self.spark, self.clock, self.deadline = spark, clock, deadline
        self._held: OrderedDict[str, Operation] = OrderedDict()
        self._lock = threading.Lock()

    def start(self, work: Callable[[], Any]) -> Operation:
        self.sweep()
        with self._lock:
            if sum(o.state == "running" for o in self._held.values()) >= MAX_PENDING:
                raise EvidenceError("too many operations are running", "E_OPERATION_BUSY", recovery="retry")
            now = self.clock()
            op = Operation(str(uuid.uuid4()), begun=now, asked=now)
            self._held[op.id] = op
            for key in [k for k, o in self._held.items() if o.state != "running"][: max(0, len(self._held) - MAX_HELD)]:
                self._held.pop(key)

        def run():
            self.spark.sparkContext.setJobGroup(op.id, "evidence operation", interruptOnCancel=True)
            try:
                self._end(op, "complete", result=work())
            except BaseException as e:  # noqa: BLE001
                self._end(op, "failed", error=e)

        InheritableThread(target=run, daemon=True).start()
        return op

    def _end(self, op: Operation, state: str, result: Any = None, error: BaseException | None = None) -> None:
        with self._lock:
            if op.state == "running":
                op.state, op.result, op.error, op.ended = state, result, error, self.clock()
        op.done.set()

    def get(self, key: str) -> Operation:
        self.sweep()
        op = self._held.get(key)
        if op is None:
            raise EvidenceError("there is no such operation", "E_OPERATION_NOT_FOUND")
        op.asked = self.clock()
        return op

    def wait(self, key: str, seconds: float = FOREGROUND_SECONDS) -> Operation:
        op = self.get(key)
        op.done.wait(seconds)
        return op

    def cancel(self, key: str) -> Operation:
        op = self.get(key)
        self._end(op, "cancelled")
        self.spark.sparkContext.cancelJobGroup(op.id)
        return op

    def sweep(self) -> None:
        """End what nobody asks for any more, and forget old results."""
        now = self.clock()
        for op in list(self._held.values()):
            if op.state == "running" and (now - op.begun > self.deadline or now - op.asked > LEASE_SECONDS):
                self._end(op, "expired")
                self.spark.sparkContext.cancelJobGroup(op.id)
            elif op.ended is not None and now - op.ended > RESULT_SECONDS:
                self._held.pop(op.id, None)
