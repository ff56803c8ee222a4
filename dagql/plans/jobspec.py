"""Jobs as DAGs of operators and connectors, lowered to one lazy DataFrame plan.

    job = JobSpec()
    scan = job.operator("scan", source=df)
    count = job.operator("count", lambda d: group(d, ["k"], n=F.count(F.lit(1))))
    job.connect("hashed", scan, 0, count, 0, keys=["k"])
    job.root(count)
    result = job.run()[count]

Operators take their inputs in port order and give one DataFrame, or a list or dict of them: one for each output port.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame

from dagql.operators.connectors import CONNECTORS


class Status(Enum):
    INITIALIZED = "INITIALIZED"
    RUNNING = "RUNNING"
    TERMINATED = "TERMINATED"
    FAILURE = "FAILURE"


@dataclass
class Operator:
    id: int
    name: str
    apply: Callable | None
    source: DataFrame | None
    outputs: int
    partitions: int | None = None
    locations: list[str] = field(default_factory=list)


@dataclass
class Connector:
    id: int
    kind: str
    producer: int
    out_port: int
    consumer: int
    in_port: int
    options: dict
    policy: dict


class JobSpec:
    """retries is for the record of those who submit the job; Spark's own setting is spark.task.maxFailures."""

    def __init__(self, retries: int = 2):
        self.operators: dict[int, Operator] = {}
        self.connectors: dict[int, Connector] = {}
        self.roots: list[int] = []
        self.retries = retries

    def operator(self, name: str, apply: Callable | None = None, source: DataFrame | None = None, outputs: int = 1) -> int:
        if (apply is None) == (source is None):
            raise ValueError("an operator is a function or a source")
        n = len(self.operators)
        self.operators[n] = Operator(n, name, apply, source, outputs)
        return n

    def connect(self, kind: str, producer: int, out_port: int, consumer: int, in_port: int, policy: dict | None = None, **options) -> int:
        """policy: materialise or pipeline, by either end. It is recorded; Spark's shuffles always materialise at the sender."""
        if kind not in CONNECTORS:
            raise ValueError(f"no connector {kind!r}; there are {', '.join(CONNECTORS)}")
        if not 0 <= out_port < self.operators[producer].outputs:
            raise ValueError(f"operator {producer} has no output {out_port}")
        if any(c.consumer == consumer and c.in_port == in_port for c in self.connectors.values()):
            raise ValueError(f"input {in_port} of operator {consumer} is taken")
        n = len(self.connectors)
        self.connectors[n] = Connector(n, kind, producer, out_port, consumer, in_port, options, policy or {})
        return n

    def root(self, operator: int) -> None:
        self.roots.append(operator)

    def constrain(self, operator: int, partitions: int | None = None, locations: list[str] | None = None) -> None:
        """The number of partitions holds for the operator's outputs; locations are recorded, Spark places tasks."""
        o = self.operators[operator]
        o.partitions, o.locations = partitions, list(locations or [])

    def inputs(self, operator: int) -> list[Connector]:
        found = sorted((c for c in self.connectors.values() if c.consumer == operator), key=lambda c: c.in_port)
        if [c.in_port for c in found] != list(range(len(found))):
            raise ValueError(f"operator {operator} lacks an input")
        return found

    def order(self) -> list[int]:
        """The operators that the roots need, producers first."""
        out: list[int] = []
        state: dict[int, bool] = {}

        def visit(n: int) -> None:
            if state.get(n):
                return
            if n in state:
                raise ValueError(f"operator {n} is its own input")
            state[n] = False
            for c in self.inputs(n):
                visit(c.producer)
            state[n] = True
            out.append(n)

        for r in self.roots:
            visit(r)
        return out

    def visit(self, operator: Callable[[Operator], None] | None = None, connector: Callable[[Connector], None] | None = None) -> None:
        """Each operator and connector that the roots need, once."""
        needed = self.order()
        for n in needed:
            if operator:
                operator(self.operators[n])
            for c in self.inputs(n) if connector else ():
                connector(c)

    def run(self) -> dict[int, DataFrame]:
        """The DataFrame of each root (its first output). Nothing is executed."""
        made: dict[int, list[DataFrame]] = {}
        for n in self.order():
            o = self.operators[n]
            if o.source is not None:
                out = o.source
            else:
                out = o.apply(*[CONNECTORS[c.kind](made[c.producer][c.out_port], **c.options) for c in self.inputs(n)])
            ports = list(out.values()) if isinstance(out, dict) else list(out) if isinstance(out, (list, tuple)) else [out]
            if len(ports) != o.outputs:
                raise ValueError(f"{o.name} gave {len(ports)} outputs, not {o.outputs}")
            made[n] = [p.repartition(o.partitions) if o.partitions else p for p in ports]
        return {r: made[r][0] for r in self.roots}

    def to_json(self) -> str:
        return json.dumps({
            "operators": [{"id": o.id, "name": o.name, "inputs": len(self.inputs(o.id)), "outputs": o.outputs, "partition-constraints": {"count": o.partitions, "locations": o.locations}} for o in self.operators.values()],
            "connectors": [{"id": c.id, "kind": c.kind, "in-operator-id": c.producer, "in-operator-port": c.out_port, "out-operator-id": c.consumer, "out-operator-port": c.in_port, "policy": c.policy} for c in self.connectors.values()],
            "roots": self.roots, "max-reattempts": self.retries,
        })

    def explain(self) -> str:
        """One line for each operator and its inputs."""
        lines = []
        for n in self.order():
            o = self.operators[n]
            lines.append(f"{n} {o.name}" + (f" [{o.partitions} partitions]" if o.partitions else ""))
            lines += [f"  <- {c.kind} from {c.producer}.{c.out_port}" for c in self.inputs(n)]
        return "\n".join(lines)


class Job:
    """An action in a thread of its own, with a status and listeners."""

    def __init__(self, action: Callable[[], object], on_start: Callable | None = None, on_finish: Callable[[Status], None] | None = None):
        self.status, self.error, self.result = Status.INITIALIZED, None, None
        self._action, self._start, self._finish = action, on_start, on_finish
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        self.status = Status.RUNNING
        try:
            if self._start:
                self._start()
            self.result = self._action()
            self.status = Status.TERMINATED
        except Exception as e:  # noqa: BLE001  kept for wait()
            self.error, self.status = e, Status.FAILURE
        if self._finish:
            self._finish(self.status)

    def start(self) -> Job:
        self._thread.start()
        return self

    def wait(self):
        self._thread.join()
        if self.error:
            raise self.error
        return self.result
