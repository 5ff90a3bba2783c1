"""Embedding cache with LRU order: as a table for batches, and as a relational replay of an access stream."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files
from ..types import VECTOR, Invalid


@dataclass
class CacheStats:
    hits: int = 0
    misses: int = 0
    evictions: int = 0

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class EmbeddingCache:
    """`text -> embedding` for the driver's own use: bounded by `max_entries` (0: unbounded), least recently used out first."""

    def __init__(self, spark: SparkSession, path: str | None, dim: int, max_entries: int = 0):
        if dim < 1:
            raise Invalid("an embedding needs a component")
        self.spark, self.path, self.dim, self.max_entries = spark, path, dim, max_entries
        self.entries: OrderedDict[str, list[float]] = OrderedDict()
        self.stats = CacheStats()
        if path and files.exists(spark, f"{path}/cache.json"):
            self._load()

    def _load(self) -> None:
        """A cache of another dimension, or one that can't be read, counts as empty; order is as saved."""
        try:
            head = json.loads(files.read_text(self.spark, f"{self.path}/cache.json"))
            if head["dim"] != self.dim:
                return
            self.stats = CacheStats(**head["stats"])
            rows = self.spark.read.parquet(f"{self.path}/{head['data']}").orderBy(F.desc("seq"))
            if self.max_entries:
                rows = rows.limit(self.max_entries)
            for r in reversed(rows.collect()):
                self.entries[r["text"]] = list(r["embedding"])
        except (ValueError, KeyError, TypeError):
            self.entries.clear()

    def save(self) -> None:
        """A new data folder, then the head that names it."""
        if not self.path:
            return
        rows = [(t, v, i) for i, (t, v) in enumerate(self.entries.items())]
        old = json.loads(files.read_text(self.spark, f"{self.path}/cache.json")) if files.exists(self.spark, f"{self.path}/cache.json") else {}
        name = f"data-{old.get('generation', 0) + 1}"
        self.spark.createDataFrame(rows, "text string, embedding array<float>, seq long").write.mode("overwrite").parquet(f"{self.path}/{name}")
        head = {"dim": self.dim, "data": name, "generation": old.get("generation", 0) + 1, "stats": asdict(self.stats)}
        files.replace_text(self.spark, f"{self.path}/cache.json", json.dumps(head))
        if old:
            files.remove(self.spark, f"{self.path}/{old['data']}")

    close = save

    def get(self, text: str) -> list[float] | None:
        got = self.entries.get(text)
        if got is None:
            self.stats.misses += 1
            return None
        self.entries.move_to_end(text)
        self.stats.hits += 1
        return list(got)

    def put(self, text: str, vector) -> None:
        vector = [float(x) for x in vector]
        if len(vector) != self.dim:
            raise Invalid(f"{len(vector)} components instead of {self.dim}")
        if text not in self.entries and self.max_entries and len(self.entries) >= self.max_entries:
            self.entries.popitem(last=False)
            self.stats.evictions += 1
        self.entries[text] = vector
        self.entries.move_to_end(text)

    def contains(self, text: str) -> bool:
        return text in self.entries

    __contains__ = contains

    def evict(self, text: str) -> bool:
        """By hand: doesn't count as an eviction."""
        return self.entries.pop(text, None) is not None

    def clear(self) -> None:
        self.entries.clear()

    @property
    def count(self) -> int:
        return len(self.entries)

    __len__ = lambda self: len(self.entries)

    def __enter__(self) -> EmbeddingCache:
        return self

    def __exit__(self, *_) -> None:
        self.save()


class CachedEmbedder:
    """Calls the model for texts that the cache lacks only."""

    def __init__(self, model: Callable[[str], list[float]], cache: EmbeddingCache, autosave_every: int = 0):
        self.model, self.cache, self.every, self._new = model, cache, autosave_every, 0

    def __call__(self, text: str) -> list[float]:
        got = self.cache.get(text)
        if got is None:
            got = [float(x) for x in self.model(text)]
            self.cache.put(text, got)
            self._new += 1
            if self.every and self._new % self.every == 0:
                self.cache.save()
        return got

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self(t) for t in texts]


def embed(texts: DataFrame, cached: DataFrame, model: Callable[[pd.Series], pd.Series]) -> tuple[DataFrame, DataFrame]:
    """(`texts` with `embedding`, new cache rows): different texts that `cached(text, embedding)` lacks go to the model once."""
    infer = F.pandas_udf(model, VECTOR)
    new = texts.select("text").where("text IS NOT NULL").distinct().join(cached.select("text"), "text", "left_anti").withColumn("embedding", infer("text"))
    known = cached.select("text", "embedding").unionByName(new)
    return texts.join(known, "text", "left"), new


def replay_sql(accesses: DataFrame, capacity: int) -> DataFrame:
    """(seq, key, hit) of get, and put on a miss: a hit iff fewer than `capacity` other keys came since the key's last access.

    A relational form; it looks at every access between two of a key, so it is for short streams.
    """
    prev = F.lag("seq").over(Window.partitionBy("key").orderBy("seq"))
    a = accesses.select("seq", "key", prev.alias("prev"))
    b = accesses.select(F.col("seq").alias("s2"), F.col("key").alias("k2"))
    between = a.where("prev IS NOT NULL").join(b, (F.col("s2") > F.col("prev")) & (F.col("s2") < F.col("seq")) & (F.col("k2") != F.col("key")), "left")
    others = between.groupBy("seq").agg(F.count_distinct("k2").alias("others"))
    return a.join(others, "seq", "left").select("seq", "key", F.coalesce(F.col("others") < capacity, F.lit(False)).alias("hit"))


def replay(accesses: DataFrame, capacity: int, shards: int = 1) -> DataFrame:
    """(seq, key, hit, evicted): LRU caches simulated in order of `seq`.

    LRU is sequential, so one cache is one task that holds `capacity` keys and streams the accesses; `shards` deals the keys over as
    many caches, each with its share of the capacity.
    """
    room = max(1, capacity // shards)
    dealt = accesses.select("seq", "key").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))

    def run(batches):
        held: dict[int, OrderedDict] = {}
        for b in batches:
            hits, gone = [], []
            for shard, key in zip(b["shard"], b["key"]):
                lru = held.setdefault(shard, OrderedDict())
                hit = key in lru
                out = None
                if not hit and len(lru) >= room:
                    out = lru.popitem(last=False)[0]
                lru[key] = None
                lru.move_to_end(key)
                hits.append(hit)
                gone.append(out)
            yield pd.DataFrame({"seq": b["seq"], "key": b["key"], "hit": hits, "evicted": gone})

    key = accesses.schema["key"].dataType.simpleString()
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("seq")
    return ordered.mapInPandas(run, f"seq long, key {key}, hit boolean, evicted {key}")


def lru_state(accesses: DataFrame, capacity: int) -> DataFrame:
    """(key, last_seq): what a cache holds after the stream, the `capacity` keys of latest access."""
    return accesses.groupBy("key").agg(F.max("seq").alias("last_seq")).orderBy(F.desc("last_seq")).limit(capacity)
