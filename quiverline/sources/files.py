"""Small files on any file system that Spark reaches."""

from __future__ import annotations

import json
import tempfile
import zlib
from typing import Any

from pyspark.sql import SparkSession

from ..types import Corrupt, Invalid


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`; where Spark runs in one process and it is unset, a
    temporary one, which no cluster could use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise Invalid("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quiverline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename over, so that a reader sees the old text or the new."""
    p, fs = _path(spark, path)
    side, _ = _path(spark, path + ".next")
    out = fs.create(side, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(side), fs.makeQualified(p), options)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def save_checked(spark: SparkSession, path: str, value: Any) -> None:
    """`value` as JSON, with its checksum, in place of what was there."""
    body = json.dumps(value, sort_keys=True)
    replace_text(spark, path, json.dumps({"body": body, "crc32": zlib.crc32(body.encode())}))


def load_checked(spark: SparkSession, path: str) -> Any:
    """What `save_checked` saved, or `Corrupt`."""
    try:
        outer = json.loads(read_text(spark, path))
        if zlib.crc32(outer["body"].encode()) != outer["crc32"]:
            raise Corrupt(f"the checksum of {path} is wrong")
        return json.loads(outer["body"])
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise Corrupt(f"{path} can't be read") from e


def listing(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each file below a folder, by its path there; hidden and marker files aside."""
    p, fs = _path(spark, path)
    top, out = fs.makeQualified(p).toString(), {}
    found = fs.listFiles(p, True)
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()[len(top) + 1 :]
        if not name.rpartition("/")[2].startswith(("_", ".")):
            out[name] = f.getLen()
    return out
