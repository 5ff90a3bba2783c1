"""Mutable vector table over Parquet: an append-only operation log, and snapshots that a manifest names.

A commit writes one batch of operations and then replaces the manifest, so it is seen whole or not at all.  The live view is
the last operation of each id; the label is that of its last insert.  Batches that insert ids never seen before are marked as
such, so that only what later batches touch is aggregated and the rest is read as it stands.  Writers are one at a time (a
commit that finds another manifest than it began with fails); readers see the manifest they opened, whose batches
outlive one compaction.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..types import VECTOR, VERSION, AlreadyExists, Invalid, Index, Metric, NotFound, VectorError, WrongVersion, cut_label
from . import files

FORMAT = 1
LOG = StructType([StructField("id", LongType()), StructField("seq", LongType()), StructField("op", StringType()), StructField("label", StringType()), StructField("vector", VECTOR)])


class VectorTable:
    """One table of `(id, label, vector)`."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict, read_only: bool = False):
        self.spark, self.path, self.manifest, self.read_only = spark, path.rstrip("/"), manifest, read_only
        self.last_error = ""
        self._closed = False

    # -- opening and saving ---------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, metric: Metric = Metric.L2, index: Index = Index.LINEAR, params: dict | None = None) -> VectorTable:
        if dim < 1:
            raise Invalid("a vector needs a component")
        if files.exists(spark, f"{path}/manifest.json"):
            raise AlreadyExists(f"{path} holds a table")
        table = cls(spark, path, {"format": FORMAT, "version": VERSION, "dim": dim, "metric": int(metric), "index": int(index), "params": params or {}, "batches": [], "fresh": [], "retired": [], "compacted": None, "streams": {}, "next_seq": 0, "next_id": 1, "generation": 0})
        table._publish(table.manifest)
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int | None = None, metric: Metric = Metric.L2, index: Index = Index.LINEAR, params: dict | None = None, read_only: bool = False) -> VectorTable:
        """An existing table, whose own metric and index count, or a new one.  A table that can't be read is never overwritten."""
        if not files.exists(spark, f"{path}/manifest.json"):
            if dim is None or read_only:
                raise NotFound(f"{path} holds no table")
            return cls.create(spark, path, dim, metric, index, params)
        table = cls(spark, path, cls.read_manifest(spark, path), read_only)
        if dim is not None and dim != table.dim:
            raise Invalid(f"the table has {table.dim} components, not {dim}")
        return table

    @staticmethod
    def read_manifest(spark: SparkSession, path: str) -> dict:
        """The manifest alone, checked; this is also how to describe a table without reading it."""
        inner = files.load_checked(spark, f"{path}/manifest.json")
        if inner.get("format") != FORMAT:
            raise WrongVersion(f"format {inner.get('format')}")
        return inner

    def _publish(self, manifest: dict) -> None:
        files.save_checked(self.spark, f"{self.path}/manifest.json", manifest)
        self.manifest = manifest

    @classmethod
    def from_rows(cls, spark: SparkSession, path: str, rows: DataFrame, metric: Metric = Metric.L2, index: Index = Index.LINEAR, params: dict | None = None) -> VectorTable:
        """A new table of `rows(vector[, id][, label])`; without ids, 1 to n in the order of the rows' place."""
        first = rows.select(F.size("vector").alias("d")).limit(1).collect()
        if not first:
            raise Invalid("no rows, so no dimension")
        if "id" not in rows.columns:
            from ..plans.ids import with_ids

            rows = with_ids(rows, 1)
        table = cls.create(spark, path, first[0]["d"], metric, index, params)
        table.insert_rows(rows)
        return table

    def close(self) -> None:
        """Commits are durable when they return, so closing neither saves nor loses anything."""
        self._closed = True

    save = flush = lambda self: None

    def __enter__(self) -> VectorTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- attributes -----------------------------------------------------------------------------------------------

    @property
    def dim(self) -> int:
        return self.manifest["dim"]

    @property
    def metric(self) -> Metric:
        return Metric(self.manifest["metric"])

    @property
    def index_type(self) -> Index:
        return Index(self.manifest["index"])

    @property
    def next_id(self) -> int:
        return self.manifest["next_id"]

    version = staticmethod(lambda: VERSION)

    def count(self) -> int:
        return self.live().count()

    def log(self, batches: list[str] | None = None) -> DataFrame:
        names = [f"{self.path}/{b}" for b in (self.manifest["batches"] if batches is None else batches)]
        # an empty range costs no job, and no Python worker
        return self.spark.read.schema(LOG).parquet(*names) if names else self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in LOG))

    def most(self) -> int:
        """Rows that are there at most: operations, which Parquet counts by itself."""
        return self.log().count()

    def live(self, vectors: bool = True) -> DataFrame:
        """(id, label, vector) of the rows that are there; (id, label) without `vectors`, which aren't read then.

        Rows of fresh batches that no other batch names are read as they stand; the rest is one aggregation by id, combined
        before its shuffle.
        """
        kept = ["id", "label", *["vector"] * vectors]
        fresh = [b for b in self.manifest["batches"] if b in set(self.manifest["fresh"])]
        rest = [b for b in self.manifest["batches"] if b not in set(fresh)]
        inserts, changes = self.log(fresh), self.log(rest)
        if not rest:
            return inserts.select(*kept)
        if not fresh:
            return _folded(changes, vectors)
        touched = changes.select("id").distinct()
        again = inserts.join(touched, "id", "left_semi").select(*changes.columns)
        return inserts.join(touched, "id", "left_anti").select(*kept).unionByName(_folded(again.unionByName(changes), vectors))

    # -- changes --------------------------------------------------------------------------------------------------

    def _fail(self, error: VectorError) -> None:
        self.last_error = str(error)
        raise error

    def _writable(self) -> None:
        if self.read_only or self._closed:
            self._fail(Invalid("the table is not open for writing"))
        if self.read_manifest(self.spark, self.path)["generation"] != self.manifest["generation"]:
            self._fail(VectorError("another writer has changed the table; open it again"))

    def _new_batch(self) -> str:
        return f"log/{self.manifest['generation'] + 1:08d}-{uuid.uuid4().hex[:8]}"

    def append(self, ops: DataFrame, rows: int, largest: int | None, beside: Callable[[str], None] | None = None, fresh: bool = False, mark: tuple[str, int] | None = None) -> None:
        """Publish checked operations `(id, step, op, label, vector)`, `step` numbering them from 0.

        `beside` writes what belongs to the batch, given its name, before the batch is seen.  `fresh` says that all are inserts of ids
        never seen before, one each.  `mark` is a stream's name and the number of its batch, published with it.
        """
        self._writable()
        self._commit(self._staged(ops), rows, largest, beside, fresh, mark)

    def _staged(self, ops: DataFrame) -> str:
        """The name of a batch that is written, and that nobody sees yet."""
        name, start = self._new_batch(), self.manifest["next_seq"]
        out = ops.select("id", (F.lit(start) + F.col("step")).cast("long").alias("seq"), "op", "label", F.col("vector").cast(VECTOR).alias("vector"))
        try:
            out.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        except BaseException:
            files.remove(self.spark, f"{self.path}/{name}")
            raise
        return name

    def _commit(self, name: str, rows: int, largest: int | None, beside: Callable[[str], None] | None = None, fresh: bool = False, mark: tuple[str, int] | None = None) -> None:
        """Publish a batch that `_staged` wrote."""
        self._writable()
        start = self.manifest["next_seq"]
        if beside:
            beside(name)
        new = {"batches": [*self.manifest["batches"], name], "next_seq": start + rows, "next_id": max(self.next_id, (largest or 0) + 1), "generation": self.manifest["generation"] + 1}
        if fresh:
            new["fresh"] = [*self.manifest["fresh"], name]
        if mark:
            new["streams"] = self.manifest["streams"] | {mark[0]: mark[1]}
        self._publish(self.manifest | new)

    def check(self, rows: DataFrame) -> DataFrame:
        """`rows(id, vector[, label])` with `reason`: null, or why a row can't be inserted."""
        taken = self.live(vectors=False).select("id").withColumn("_taken", F.lit(True))
        named = _named(rows)
        many = named.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1")
        reason = self._unfit().when(F.col("_n").isNotNull(), "repeated id").when(F.col("_taken"), "id exists")
        return named.join(many, "id", "left").join(taken, "id", "left").select("id", "label", "vector", reason.alias("reason"))

    def _unfit(self):
        """Why a row can't be inserted, as far as the row alone tells."""
        return (
            F.when(F.col("id").isNull() | (F.col("id") < 0), "bad id")
            .when(F.col("vector").isNull() | (F.size("vector") != self.dim), "bad dimension")
            .when(F.exists("vector", lambda x: x.isNull()), "null component")
        )

    def insert_rows(self, rows: DataFrame, beside: Callable[[str], None] | None = None) -> int:
        """Insert all rows, or none and raise.

        The rows are written once and checked as they lie there, by ids without their vectors; a batch that fails goes unseen.
        """
        self._writable()
        name = self._staged(_named(rows).select("id", F.lit(0).alias("step"), F.lit("I").alias("op"), _cut(F.col("label")).alias("label"), "vector"))
        try:
            ids = self.log([name]).select("id", self._unfit().alias("reason")).groupBy("id").agg(F.count("*").alias("n"), F.min("reason").alias("reason"))
            ids = ids.withColumn("reason", F.coalesce("reason", F.when(F.col("n") > 1, "repeated id")))
            n, least, largest, bad = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("id"), F.max("id"), F.count("reason")).first()
            # ids from the next one on were never there
            fresh = not self.manifest["batches"] or (least is not None and least >= self.next_id)
            if bad or (n and not fresh):
                taken = self.live(vectors=False).select("id", F.lit("id exists").alias("taken"))
                why = ids.join(taken, "id", "left").select("id", F.coalesce("reason", "taken").alias("reason")).where("reason IS NOT NULL").orderBy("id").limit(1).collect()
                if why:
                    kind = AlreadyExists if why[0]["reason"] in ("id exists", "repeated id") else Invalid
                    self._fail(kind(f"{why[0]['reason']}: {why[0]['id']}"))
            if n:
                # one insert an id, so operations of a batch need no order among themselves
                self._commit(name, 1, largest, beside, fresh)
        except BaseException:
            if name not in self.manifest["batches"]:
                files.remove(self.spark, f"{self.path}/{name}")
            raise
        if not n:
            files.remove(self.spark, f"{self.path}/{name}")
        return n

    def _insert(self, good: DataFrame, beside: Callable[[str], None] | None = None, mark: tuple[str, int] | None = None) -> int:
        n, least, largest = good.agg(F.count("*"), F.min("id"), F.max("id")).first()
        if n:
            # one insert an id, so operations of a batch need no order among themselves
            fresh = not self.manifest["batches"] or least >= self.next_id
            self.append(good.select("id", F.lit(0).alias("step"), F.lit("I").alias("op"), _cut(F.col("label")).alias("label"), "vector"), 1, largest, beside, fresh, mark)
        return n

    def insert_valid(self, rows: DataFrame, mark: tuple[str, int] | None = None, before: Callable[[DataFrame, int], None] | None = None) -> tuple[int, DataFrame]:
        """(rows inserted, rejects with their reason): of several rows with one id, all are rejected.

        `before` gets the rejects and their number ahead of the commit, so that a crash between them loses neither.
        """
        checked = self.check(rows).cache()
        rejects = checked.where("reason IS NOT NULL")
        count = rejects.count()
        if before:
            before(rejects, count)
        return self._insert(checked.where("reason IS NULL"), mark=mark), rejects

    def _one(self, id: int, op: str, label: str | None, vector: Iterable[float] | None) -> None:
        row = Row(id=id, step=0, op=op, label=label, vector=None if vector is None else [float(x) for x in vector])
        schema = StructType([StructField("id", LongType()), StructField("step", LongType()), StructField("op", StringType()), StructField("label", StringType()), StructField("vector", VECTOR)])
        self.append(self.spark.createDataFrame([row], schema), 1, id if op == "I" else None)

    def _vector(self, vector: Iterable[float]) -> list[float]:
        out = [float(x) for x in vector]
        if len(out) != self.dim:
            self._fail(Invalid(f"{len(out)} components instead of {self.dim}"))
        return out

    def insert(self, id: int, vector: Iterable[float], label: str = "") -> None:
        vector = self._vector(vector)
        if id < 0 or id >= 1 << 63:
            self._fail(Invalid(f"bad id: {id}"))
        if self.find(id) is not None:
            self._fail(AlreadyExists(f"id exists: {id}"))
        self._one(id, "I", cut_label(label), vector)

    def delete(self, id: int) -> None:
        if self.find(id) is None:
            self._fail(NotFound(f"no id {id}"))
        self._one(id, "D", None, None)

    def update(self, id: int, vector: Iterable[float]) -> None:
        """A new vector; the label stays."""
        vector = self._vector(vector)
        if self.find(id) is None:
            self._fail(NotFound(f"no id {id}"))
        self._one(id, "U", None, vector)

    def change_rows(self, ids: DataFrame, op: str) -> int:
        """Delete (`D`, ids `(id)`) or update (`U`, `(id, vector)`) all ids that are there; how many."""
        self._writable()
        there = ids.select("id", *["vector"] * (op == "U")).dropDuplicates(["id"]).join(self.live(vectors=False).select("id"), "id", "left_semi")
        vector = F.col("vector") if op == "U" else F.lit(None).cast(VECTOR)
        name = self._staged(there.select("id", F.lit(0).alias("step"), F.lit(op).alias("op"), F.lit(None).cast("string").alias("label"), vector.alias("vector")))
        n = self.log([name]).count()
        if n:
            self._commit(name, 1, None)
        else:
            files.remove(self.spark, f"{self.path}/{name}")
        return n

    def find(self, id: int) -> Row | None:
        """The live row of an id: the filter reaches the log's scan."""
        return self.live().where(F.col("id") == id).first()

    def get(self, id: int) -> tuple[list[float], str]:
        row = self.find(id)
        if row is None:
            self._fail(NotFound(f"no id {id}"))
        return list(row["vector"]), row["label"]

    def page(self, number: int, size: int = 200) -> DataFrame:
        """The live rows of a page, by id."""
        return self.live().orderBy("id").offset(number * size).limit(size)

    def compact(self, beside: Callable[[str], None] | None = None) -> list[str]:
        """Rewrite the log as inserts of the live rows.

        The old batches stay until the next compaction, for readers that opened the table before this one; returned are those
        that the last one left and that go now.
        """
        self._writable()
        old, gone = self.manifest["batches"], self.manifest["retired"]
        name, seq, last = self._new_batch(), self.manifest["next_seq"], self.manifest["compacted"]
        # operations up to which the new batch holds: a compaction alone adds none
        upto = last["upto"] if last and old == [last["batch"]] else seq
        self.live().select("id", F.lit(seq).cast("long").alias("seq"), F.lit("I").alias("op"), "label", "vector").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        if beside:
            beside(name)
        self._publish(self.manifest | {"batches": [name], "fresh": [name], "retired": old, "compacted": {"batch": name, "upto": upto}, "next_seq": seq + 1, "generation": self.manifest["generation"] + 1})
        for b in gone:
            files.remove(self.spark, f"{self.path}/{b}")
        return gone

    def begin(self):
        """A transaction; as a context manager it commits, or rolls back if an exception passes."""
        from ..operators.transaction import Transaction

        return Transaction(self)

    # -- search ---------------------------------------------------------------------------------------------------

    def access(self):
        """The trained access method of this table."""
        from ..plans.access import Access

        return Access(self)


def _named(rows: DataFrame) -> DataFrame:
    """(id, label, vector) of rows that may lack labels."""
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col("id").cast("long").alias("id"), label.alias("label"), F.col("vector").cast(VECTOR).alias("vector"))


def _folded(log: DataFrame, vectors: bool = True) -> DataFrame:
    """(id, label, vector), or (id, label), that the operations leave."""
    last = log.groupBy("id").agg(F.max_by(F.struct("op", *["vector"] * vectors), "seq").alias("last"), F.max_by("label", F.when(F.col("op") == "I", F.col("seq"))).alias("label"))
    return last.where("last.op <> 'D'").select("id", "label", *[F.col("last.vector").alias("vector")] * vectors)


def _cut(label):
    """At most 255 bytes of UTF-8, whole characters: only longer labels go through the cut."""
    short = F.coalesce(label, F.lit(""))
    raw = F.substring(short.cast("binary"), F.lit(1), F.lit(255))
    # at the border of a broken character the bytes of its beginning go: at most three
    valid = F.coalesce(*(F.when(F.is_valid_utf8(F.substring(raw, F.lit(1), F.lit(255 - k)).cast("string")), F.substring(raw, F.lit(1), F.lit(255 - k)).cast("string")) for k in range(4)), F.lit(""))
    return F.when(F.octet_length(short) <= 255, short).otherwise(valid)


