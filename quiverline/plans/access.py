"""One interface to the eight access methods: train on a table, save, load, search."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import graph, inverted, lsh, sq, topk
from ..sources import files
from ..sources.store import VectorTable
from ..types import Corrupt, Index, Invalid, Metric, NotTrained, Params


class Access:
    """The access method a table names.  LINEAR needs no training; the others are built by `train` and saved beside the table.

    An index follows its table: rows that later batches insert or update are encoded by the stored model when a search asks, the
    rows they replace or delete are left out before the best are taken.  `refresh` saves that state, `train` fits anew.
    """

    def __init__(self, table: VectorTable):
        self.table, self.spark = table, table.spark
        self.params = replace(Params(), **table.manifest["params"])
        self.model: Any = None
        self.data: DataFrame | None = None
        self.at: dict | None = None  # the saved index: its folder, and the operations and batches that it holds

    @property
    def _pointer(self) -> str:
        return f"{self.table.path}/index/current.json"

    @property
    def _is_graph(self) -> bool:
        return self.table.index_type in (Index.HNSW, Index.VAMANA)

    def _fit(self, rows: DataFrame) -> Any:
        p, kind = self.params, self.table.index_type
        if kind == Index.SQ:
            return sq.ranges(rows)
        if kind == Index.IVF:
            return inverted.InvertedFile.train(rows, p.ivf_nlist)
        if kind == Index.IVF_PQ:
            return inverted.ProductQuantizer.train(rows, p.ivf_nlist, p.pq_m, p.pq_nbits)
        if kind == Index.ANISOTROPIC:
            return inverted.ProductQuantizer.train(rows, p.aq_nlist, p.aq_m, p.aq_bits, eta=max(p.aq_eta, 0.0))
        if kind == Index.LSH:
            return lsh.Lsh.gaussian(self.table.dim, self.table.metric, p.lsh_l, p.lsh_k, p.lsh_w)
        return ()

    def _encode(self, rows: DataFrame) -> DataFrame:
        p, kind, metric = self.params, self.table.index_type, self.table.metric
        if kind == Index.SQ:
            return sq.encode(rows, *self.model)
        if kind == Index.IVF:
            return self.model.encode(rows).select("id", "vector", "cell")
        if kind == Index.IVF_PQ:
            return self.model.encode(rows).select("id", "codes", "cell")
        if kind == Index.ANISOTROPIC:
            return self.model.encode(rows, keep_vector=True).select("id", "codes", "vector", "cell")
        if kind == Index.LSH:
            return self.model.postings(rows, keep_vector=True)
        if kind == Index.HNSW:
            return graph.build_small_world(rows, metric, p.hnsw_m, p.hnsw_ef_construction)
        return graph.build_pruned_flat(rows, metric, p.vamana_r, p.vamana_l, p.vamana_alpha)

    def train(self, rows: DataFrame | None = None) -> Access:
        """Fit the model on `rows` (the live rows if none) and encode all live rows."""
        if self.table.index_type != Index.LINEAR:
            self.model = self._fit(self.table.live() if rows is None else rows)
        return self.refresh()

    def refresh(self) -> Access:
        """Encode all live rows by the model as it is, and save both; the index before the last one goes."""
        if self.table.index_type == Index.LINEAR:
            return self
        if self.model is None:
            self.load()
        manifest = self.table.manifest
        folder = f"index/{manifest['generation']:08d}-{uuid.uuid4().hex[:8]}"
        data = self._encode(self.table.live())
        writer = data.write
        if "cell" in data.columns:  # stored by cell, so that a search reads the probed cells' files only
            writer = data.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("cell")
        out = f"{self.table.path}/{folder}"
        writer.mode("overwrite").option("compression", "zstd").parquet(f"{out}/data")
        files.save_checked(self.spark, f"{out}/model.json", _to_json(self.model))
        before = files.load_checked(self.spark, self._pointer) if files.exists(self.spark, self._pointer) else None
        self.at = {"folder": folder, "before": before["folder"] if before else None, "schema": data.schema.json(), "files": files.listing(self.spark, f"{out}/data"), "seq": manifest["next_seq"], "batches": manifest["batches"]}
        files.save_checked(self.spark, self._pointer, self.at)
        if before and before["before"]:
            files.remove(self.spark, f"{self.table.path}/{before['before']}")
        self.data = self._saved()
        return self

    def _saved(self) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(self.at["schema"]))).parquet(f"{self.table.path}/{self.at['folder']}/data")

    def load(self) -> Access:
        """The model and data that were saved last; their checksums and files are looked at first."""
        if self.table.index_type == Index.LINEAR:
            return self
        if not files.exists(self.spark, self._pointer):
            raise NotTrained("train the index first")
        self.at = files.load_checked(self.spark, self._pointer)
        folder = f"{self.table.path}/{self.at['folder']}"
        if not files.exists(self.spark, f"{folder}/data") or files.listing(self.spark, f"{folder}/data") != self.at["files"]:
            raise Corrupt(f"files of {folder} are missing or have another size")
        self.model = _from_json(self.table.index_type, files.load_checked(self.spark, f"{folder}/model.json"))
        self.data = self._saved()
        return self

    def _state(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(saved data, ids that later batches touch, their live rows); the last two are None if there are none."""
        new = [b for b in self.table.manifest["batches"] if b not in set(self.at["batches"])]
        compacted = self.table.manifest["compacted"]
        if compacted and compacted["batch"] in new:
            if compacted["upto"] != self.at["seq"]:
                # the changes since the index was saved are no longer told apart
                return self._encode(self.table.live()), None, None
            new.remove(compacted["batch"])
        if not new:
            return self.data, None, None
        touched = self.table.log(new).select("id").distinct()
        return self.data, touched, self.table.live().join(touched, "id", "left_semi")

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, width: int | None = None, allow_l2_ranking: bool = False) -> DataFrame:
        """(query_id, rank, id, distance, label) for `queries(query_id, query)`; labels are joined to the k found only."""
        kind, metric = self.table.index_type, self.table.metric
        if kind == Index.LINEAR:
            found = topk.knn(queries, self.table.live(), k, metric, self.table.most())
        else:
            if self.data is None:
                self.load()
            data, touched, fresh = self._state()
            if touched is not None and not self._is_graph:
                data = data.join(touched, "id", "left_anti").select(*data.columns).unionByName(self._encode(fresh))
            found = self._found(queries, data, k, nprobe, width, allow_l2_ranking, touched)
            if touched is not None and self._is_graph:
                # what came after the graphs were built is searched exactly
                found = topk.ranked(found.drop("rank").unionByName(topk.knn(queries, fresh, k, metric).drop("rank")), k)
        return found.join(self.table.live(vectors=False), "id").select("query_id", "rank", "id", F.col("distance"), "label")

    def _found(self, queries: DataFrame, data: DataFrame, k: int, nprobe: int | None, width: int | None, allow_l2_ranking: bool, gone: DataFrame | None) -> DataFrame:
        p, kind, metric = self.params, self.table.index_type, self.table.metric
        if kind == Index.SQ:
            return sq.search(queries, data, *self.model, k, metric, self.table.most())
        if kind == Index.IVF:
            return self.model.search(queries, data, k, metric, nprobe or p.ivf_nprobe)
        if kind == Index.IVF_PQ:
            if metric != Metric.L2 and not allow_l2_ranking:
                raise Invalid("product codes rank by squared L2; say allow_l2_ranking to accept that for another metric")
            return self.model.search(queries, data, k, nprobe or p.ivf_nprobe)
        if kind == Index.ANISOTROPIC:
            return self.model.search_reranked(queries, data, k, metric, nprobe or p.aq_nprobe, p.aq_rerank_k)
        if kind == Index.LSH:
            return self.model.search(queries, k, data)
        return graph.search(queries, data, k, width or (p.hnsw_ef_search if kind == Index.HNSW else p.vamana_l), gone)

    def search_one(self, query: list[float], k: int) -> list[tuple[int, float, str]]:
        """(id, distance, label) of one query, nearest first."""
        if len(query) != self.table.dim:
            raise Invalid(f"{len(query)} components instead of {self.table.dim}")
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<double>")
        return [(r["id"], r["distance"], r["label"]) for r in sorted(self.search(one, k).collect(), key=lambda r: r["rank"])]


def _to_json(model: Any) -> Any:
    if isinstance(model, inverted.InvertedFile):
        return {"centroids": model.centroids.tolist()}
    if isinstance(model, inverted.ProductQuantizer):
        return {"centroids": model.centroids.tolist(), "codebooks": model.codebooks.tolist(), "eta": model.eta}
    if isinstance(model, lsh.Lsh):
        return {"planes": model.planes.tolist(), "bias": model.bias.tolist(), "width": model.width, "metric": int(model.metric)}
    return model


def _from_json(kind: Index, raw: Any) -> Any:
    if kind == Index.IVF:
        return inverted.InvertedFile(np.array(raw["centroids"]))
    if kind in (Index.IVF_PQ, Index.ANISOTROPIC):
        return inverted.ProductQuantizer(np.array(raw["centroids"]), np.array(raw["codebooks"]), raw["eta"])
    if kind == Index.LSH:
        return lsh.Lsh(np.array(raw["planes"]), np.array(raw["bias"]), raw["width"], Metric(raw["metric"]))
    return raw
