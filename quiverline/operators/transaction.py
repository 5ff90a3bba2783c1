"""Transactions: operations are staged on the driver, tried against the live view, and published as one batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.store import VectorTable
from ..types import VECTOR, AlreadyExists, Invalid, NotFound, VectorError, cut_label

_OPS = StructType([StructField("id", LongType()), StructField("step", LongType()), StructField("op", StringType()), StructField("label", StringType()), StructField("vector", VECTOR)])


class Transaction:
    """All or nothing.  After a failed commit nothing is applied and nothing stays staged."""

    def __init__(self, table: VectorTable):
        self.table, self.staged, self.last_error = table, [], ""

    @property
    def op_count(self) -> int:
        return len(self.staged)

    def insert(self, id: int, vector: Iterable[float], label: str = "") -> None:
        if id < 0 or id >= 1 << 63:
            raise Invalid(f"bad id: {id}")
        self.staged.append((id, "I", cut_label(label), self._vector(vector)))

    def update(self, id: int, vector: Iterable[float]) -> None:
        self.staged.append((id, "U", None, self._vector(vector)))

    def delete(self, id: int) -> None:
        self.staged.append((id, "D", None, None))

    def _vector(self, vector: Iterable[float]) -> list[float]:
        out = [float(x) for x in vector]
        if len(out) != self.table.dim:
            raise Invalid(f"{len(out)} components instead of {self.table.dim}")
        return out

    def _tried(self, staged: list) -> None:
        inserts = [op[0] for op in staged if op[1] == "I"]
        if len(set(inserts)) < len(inserts):
            raise AlreadyExists("an id is inserted twice")
        ids = sorted({op[0] for op in staged})
        # the filter keeps the staged ids alone, so the driver gets at most as many as it staged
        there = {r["id"] for r in self.table.live().where(F.col("id").isin(ids)).select("id").collect()}
        for id, op, _, _ in staged:
            if op == "I" and id in there:
                raise AlreadyExists(f"id exists: {id}")
            if op != "I" and id not in there:
                raise NotFound(f"no id {id}")
            (there.discard if op == "D" else there.add)(id)

    def commit(self) -> None:
        staged, self.staged = self.staged, []
        if not staged:
            return
        try:
            self._tried(staged)
            rows = [(id, step, op, label, vector) for step, (id, op, label, vector) in enumerate(staged)]
            largest = max((r[0] for r in rows if r[2] == "I"), default=None)
            self.table.append(self.table.spark.createDataFrame(rows, _OPS), len(rows), largest)
        except VectorError as e:
            self.last_error = str(e)
            raise

    def rollback(self) -> None:
        self.staged = []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()
