"""Metrics, access methods, parameters and errors."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

VERSION = "1.0.0"
#: Labels are cut to this many UTF-8 bytes, on a character's border.
LABEL_BYTES = 255
#: Norms whose product is below this count as zero (the smallest float32 step at 1).
EPSILON = 1.1920929e-07


class Metric(IntEnum):
    L2 = 0
    COSINE = 1
    IP = 2
    L1 = 3
    HAMMING = 4


class Index(IntEnum):
    LINEAR = 0
    HNSW = 1
    IVF = 2
    IVF_PQ = 3
    VAMANA = 4
    LSH = 5
    ANISOTROPIC = 6
    SQ = 7


class VectorError(RuntimeError):
    """Base of all errors; `code` is the numeric status."""

    code = -1


class NotFound(VectorError, KeyError):
    code = -4

    def __str__(self) -> str:
        return RuntimeError.__str__(self)


class AlreadyExists(VectorError):
    code = -5


class Invalid(VectorError, ValueError):
    code = -6


class NotTrained(VectorError):
    code = -7


class Corrupt(VectorError, OSError):
    code = -8


class WrongVersion(VectorError, OSError):
    code = -9


class PartialRollback(VectorError):
    """Kept for the status table: commits publish one batch or none, so it is never raised."""

    code = -10


@dataclass(frozen=True)
class Params:
    """Parameters of the access methods, with their defaults."""

    hnsw_m: int = 16
    hnsw_ef_construction: int = 200
    hnsw_ef_search: int = 50
    ivf_nlist: int = 128
    ivf_nprobe: int = 8
    pq_m: int = 8
    pq_nbits: int = 8
    vamana_r: int = 32
    vamana_l: int = 100
    vamana_alpha: float = 1.2
    lsh_l: int = 10
    lsh_k: int = 8
    lsh_w: float = 10.0
    aq_nlist: int = 128
    aq_nprobe: int = 32
    aq_m: int = 8
    aq_bits: int = 8
    aq_rerank_k: int = 100
    aq_eta: float = 0.2

    def __post_init__(self) -> None:
        if self.pq_nbits not in (4, 8) or self.aq_bits not in (4, 8):
            raise Invalid("codes have 4 or 8 bits")
        if self.ivf_nlist < 1 or self.aq_nlist < 1:
            raise Invalid("an inverted file needs a list")

    @classmethod
    def high_recall(cls) -> Params:
        return cls(hnsw_m=32, hnsw_ef_construction=400, hnsw_ef_search=200)

    @classmethod
    def low_latency(cls) -> Params:
        return cls(hnsw_m=16, hnsw_ef_construction=100, hnsw_ef_search=20)


VECTOR = ArrayType(FloatType())
ROW = StructType([StructField("id", LongType(), False), StructField("label", StringType()), StructField("vector", VECTOR)])


def cut_label(label: str | None) -> str:
    """A label of at most 255 bytes, whole characters only; None is empty."""
    raw = (label or "").encode()
    return raw[:LABEL_BYTES].decode(errors="ignore") if len(raw) > LABEL_BYTES else label or ""
