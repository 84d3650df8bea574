"""A client over a store: insert, search, download, delete, edges, graph, namespaces, snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparkvec.operators import graph, knn, lifecycle
from sparkvec.operators.filters import Filter
from sparkvec.plans.request import Ticket, parse_search, parse_ticket, planned
from sparkvec.session import ship
from sparkvec.sources.store import NotFound, Store


def frame(spark: SparkSession, data: object) -> DataFrame:
    """A DataFrame of rows given as DataFrame, pandas, Arrow table, or list of dicts.

    Complex vectors become real and imaginary parts in turn; dicts, and lists that are no vectors, become JSON text.
    """
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "to_pandas"):
        data = data.to_pandas()
    rows = data.to_dict("records") if isinstance(data, pd.DataFrame) else [dict(r) for r in data]

    def plain(k: str, v: object) -> object:
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list | tuple):
            if v and all(isinstance(x, complex | int | float) for x in v) and any(isinstance(x, complex) for x in v):
                return [float(p) for x in v for p in (complex(x).real, complex(x).imag)]
            if k in ("vector", "embedding"):
                return [float(x) for x in v]
            return json.dumps(v)
        return json.dumps(v) if isinstance(v, dict) else v

    return spark.createDataFrame([Row(**{k: plain(k, v) for k, v in r.items()}) for r in rows])


class Client:
    def __init__(self, spark: SparkSession, root: str):
        ship(spark)
        self.spark, self.store = spark, Store(spark, root)

    def insert(self, dataset: str, data: object) -> dict:
        return self.store.insert(dataset, frame(self.spark, data))

    def upsert(self, dataset: str, data: object) -> dict:
        return self.store.upsert(dataset, frame(self.spark, data))

    def search(self, dataset: str, **request: object) -> DataFrame:
        return planned(self.store, Ticket(dataset, search=parse_search({"dataset": dataset, **request})))

    def search_by_id(self, dataset: str, id: object, k: int = 10, **request: object) -> DataFrame:
        rows = self.store.scan(dataset).where(F.col("id") == F.lit(id))
        col = "vector" if "vector" in rows.columns else "embedding"
        first = rows.select(col).first()
        if first is None:
            raise NotFound(str(id))
        return self.search(dataset, vector=list(first[0]), k=k, **request)

    def search_by_ids(self, dataset: str, ids: DataFrame, k: int = 10, **how: str) -> DataFrame:
        """The nearest of each of many stored items (a column ``id``)."""
        rows = self.store.scan(dataset)
        return knn.by_id(rows, ids, k, vector_col="vector" if "vector" in rows.columns else "embedding", **how)

    def digest(self, dataset: str, id_col: str = "id", ts: str = "ts") -> DataFrame:
        """One digest of all rows' ids and times, to compare two copies by."""
        return lifecycle.digest_root(self.store.scan(dataset), id_col, ts)

    def differing(self, dataset: str, other: str, id_col: str = "id", ts: str = "ts") -> DataFrame:
        """The leaves in which two copies differ."""
        return lifecycle.differing_leaves(*[lifecycle.digest_leaves(self.store.scan(x), id_col, ts) for x in (dataset, other)])

    def ticket(self, text: str) -> DataFrame:
        return planned(self.store, parse_ticket(text))

    def download(self, dataset: str, filters: tuple[Filter, ...] = (), limit: int = 0) -> DataFrame:
        return self.store.scan(dataset, filters, limit=limit)

    def stream(self, dataset: str, filters: tuple[Filter, ...] = ()) -> Iterator[Row]:
        return self.download(dataset, filters).toLocalIterator(prefetchPartitions=True)

    def delete(self, dataset: str, ids: list) -> dict:
        return self.store.delete(dataset, self.spark.createDataFrame([(str(i),) for i in ids], "id string"))

    def drop(self, dataset: str) -> None:
        self.store.drop(dataset)

    def list_datasets(self, namespace: str = "default", **criteria: object) -> DataFrame:
        return self.store.list(namespace, **criteria)

    def info(self, dataset: str) -> dict:
        rows, size = self.store.info(dataset)
        return {"rows": rows, "bytes": size, "schema": self.store.schema(dataset)}

    def add_edge(self, dataset: str, subject: int, predicate: str, obj: int, weight: float = 1.0) -> None:
        self.store.add_edges(dataset, self.spark.createDataFrame([(subject, predicate, obj, float(weight))], "subject bigint, predicate string, object bigint, weight double"))

    def traverse(self, dataset: str, start: int, **how: object) -> DataFrame:
        return graph.traverse(self.spark.createDataFrame([(start,)], "start bigint"), self.store.edges(dataset), **how)

    def graph_stats(self, dataset: str) -> DataFrame:
        return graph.stats(self.store.edges(dataset))

    def create_namespace(self, name: str) -> None:
        self.store.create_namespace(name)

    def delete_namespace(self, name: str) -> None:
        self.store.delete_namespace(name)

    def namespaces(self) -> list[str]:
        return self.store.namespaces()

    def count_datasets(self, namespace: str = "default") -> int:
        return len(self.store.datasets(namespace))

    def snapshot(self, dataset: str, to: str) -> None:
        self.store.snapshot(dataset, to)

    def restore(self, dataset: str, source: str) -> None:
        self.store.restore(dataset, source)
