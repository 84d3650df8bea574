"""Datasets in a folder: parquet parts, deletion marks, edges, a change log and versions of the schema.

Layout of ``root/<namespace>/<name>/``: ``data-<generation>/b=<number>`` (one folder for each batch), ``tombstones-<generation>``,
``edges``, ``meta/<number>-<version>.json``. A change first writes its files and then, by one rename, the next meta file, which names
the generation, the last batch, and what has been applied from which stream. Readers see only what the latest meta file
names: a batch that a crash left without one is overwritten by the next, a compaction that was cut short is invisible. One writer for each dataset.
Paths go through Hadoop's file system, so a root may lie on any store Spark can write to.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.operators.filters import Filter, apply
from sparkvec.operators.lifecycle import SchemaError, last_writer, live


class NotFound(KeyError):
    pass


def split_path(path: str) -> tuple[str, str]:
    """a/b/c -> (a, b/c); x and /x -> (default, x)."""
    head, slash, rest = (path or "").partition("/")
    return (head or "default", rest) if slash else ("default", head)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ files
    def _path(self, p: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _exists(self, p: str) -> bool:
        return self._fs.exists(self._path(p))

    def _names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(p))) if self._exists(p) else []

    def _folder(self, path: str, must: bool = True) -> str:
        ns, name = split_path(path)
        at = f"{self.root}/{ns}/{name}"
        if must and not self._exists(f"{at}/meta"):
            raise NotFound(path)
        return at

    def _meta(self, at: str) -> dict:
        names = [n for n in self._names(f"{at}/meta") if n.endswith(".json")]
        if not names:
            return {"version": 0, "seq": 0, "fields": [], "data": "data-0", "tombstones": "tombstones-0", "applied": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{at}/meta/{names[-1]}", wholetext=True).collect()))

    def _write_text(self, at: str, text: str) -> None:
        """A file that is there as a whole or not at all."""
        tmp = f"{at}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(tmp), True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if not self._fs.rename(self._path(tmp), self._path(at)):
            raise OSError(f"{at} is there already")

    def _commit(self, at: str, meta: dict) -> None:
        """Make what was written visible: the next meta file."""
        meta["number"] = meta.get("number", 0) + 1
        meta["time"] = time.time_ns()
        self._write_text(f"{at}/meta/{meta['number']:012d}-{meta['version']:06d}.json", json.dumps(meta))

    # ------------------------------------------------------------ namespaces and datasets
    def create_namespace(self, name: str) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    def delete_namespace(self, name: str) -> None:
        if name == "default":
            raise ValueError("the default namespace can't be deleted")
        if not self._exists(f"{self.root}/{name}"):
            raise NotFound(name)
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def namespaces(self) -> list[str]:
        return sorted({"default", *self._names(self.root)})

    def datasets(self, namespace: str = "default") -> list[str]:
        return [n for n in self._names(f"{self.root}/{namespace}") if self._exists(f"{self.root}/{namespace}/{n}/meta")]

    def list(self, namespace: str = "default", name_contains: str = "", more_than: int | None = None, at_most: int | None = None, exactly: int | None = None) -> DataFrame:
        """``(name, rows, bytes)`` of the datasets that meet the criteria."""
        rows = [(n, *self.info(f"{namespace}/{n}")) for n in self.datasets(namespace) if name_contains in n]
        df = self.spark.createDataFrame(rows, "name string, rows bigint, bytes bigint")
        for limit, op in ((more_than, lambda c, v: c > v), (at_most, lambda c, v: c <= v), (exactly, lambda c, v: c == v)):
            if limit is not None:
                df = df.where(op(F.col("rows"), limit))
        return df

    def _bytes(self, at: str) -> int:
        data = f"{at}/{self._meta(at)['data']}"
        return self._fs.getContentSummary(self._path(data)).getLength() if self._exists(data) else 0

    def info(self, path: str) -> tuple[int, int]:
        at = self._folder(path)
        return self.scan(path).count(), self._bytes(at)

    def schema(self, path: str, version: int | None = None) -> T.StructType:
        """The schema now, or as it was at a version."""
        m = self._meta(self._folder(path))
        v = m["version"] if version is None else version
        return T.StructType([T.StructField.fromJson(f["field"]) for f in m["fields"] if f["added"] <= v and (not f["dropped"] or f["dropped"] > v)])

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(self._folder(path)), True)

    # ------------------------------------------------------------ writing
    def _evolve(self, meta: dict, schema: T.StructType) -> dict:
        known = {f["field"]["name"]: f for f in meta["fields"]}
        for f in schema.fields:
            own = known.get(f.name)
            kind = T.StructField(f.name, f.dataType, True).jsonValue()
            if own and own["dropped"]:
                raise SchemaError(f"column {f.name!r} was dropped and can't be used again")
            if own and own["field"]["type"] != kind["type"]:
                raise SchemaError(f"column {f.name!r} changes its type")
            if not own:
                meta["version"] += 1
                meta["fields"].append({"field": kind, "added": meta["version"], "dropped": 0})
        return meta

    def insert(self, path: str, df: DataFrame, source: str = "", number: int | None = None) -> dict:
        """Append a batch; creates the dataset if need be. New columns evolve the schema.

        With a ``source`` and its running ``number`` the batch is applied once: a number up to the last one applied from that source
        is answered with ``repeated``. Batch and number become visible together.
        """
        at = self._folder(path, must=False)
        meta = self._meta(at)
        if number is not None and number <= meta["applied"].get(source, -1):
            return {"status": "repeated", "seq": meta["seq"], "version": meta["version"]}
        meta = self._evolve(meta, df.schema)
        meta["seq"] += 1
        if number is not None:
            meta["applied"][source] = number
        rows = df.withColumn("_seq", F.lit(meta["seq"]).cast("bigint"))
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/{meta['data']}/b={meta['seq']}")
        self._commit(at, meta)
        return {"status": "ok", "seq": meta["seq"], "version": meta["version"]}

    def applied(self, path: str, source: str) -> int | None:
        """The last number applied from a source."""
        return self._meta(self._folder(path, must=False))["applied"].get(source)

    def drop_column(self, path: str, name: str) -> None:
        at = self._folder(path)
        meta = self._meta(at)
        own = next((f for f in meta["fields"] if f["field"]["name"] == name and not f["dropped"]), None)
        if own is None:
            raise NotFound(name)
        meta["version"] += 1
        own["dropped"] = meta["version"]
        self._commit(at, meta)

    def delete(self, path: str, ids: DataFrame, id_col: str = "id") -> dict:
        """Mark ids as deleted, in all batches so far; the same id may be inserted again later. Marking twice changes nothing.

        Tells how many of the ids were there, and how many weren't.
        """
        at = self._folder(path)
        meta = self._meta(at)
        want = ids.select(F.col(id_col).cast("string").alias("id")).distinct()
        there = self.scan(path, columns=["id"]).select(F.col("id").cast("string").alias("id")).distinct()
        n, here = want.count(), want.join(there, "id", "left_semi").count()
        want.withColumn("seq", F.lit(meta["seq"]).cast("bigint")).write.mode("append").parquet(f"{at}/{meta['tombstones']}")
        return {"status": "ok", "deleted": here, "unknown": n - here}

    def upsert(self, path: str, df: DataFrame) -> dict:
        """Append; readers with ``latest=(key, ts)`` see the last writer of each key."""
        return self.insert(path, df)

    # ------------------------------------------------------------ reading
    def _data(self, path: str, after: int = 0) -> DataFrame:
        at = self._folder(path)
        meta, schema = self._meta(at), self.schema(path)
        if not self._exists(f"{at}/{meta['data']}"):
            return self.spark.createDataFrame([], schema.add("_seq", "bigint"))
        own = T.StructType([*schema.fields, T.StructField("_seq", T.LongType()), T.StructField("b", T.LongType())])
        rows = self.spark.read.schema(own).parquet(f"{at}/{meta['data']}")
        return rows.where((F.col("b") <= meta["seq"]) & (F.col("b") > after)).drop("b")

    def tombstones(self, path: str) -> DataFrame | None:
        at = self._folder(path)
        dead = f"{at}/{self._meta(at)['tombstones']}"
        return self.spark.read.parquet(dead) if self._exists(dead) else None

    def _alive(self, path: str, df: DataFrame, id_col: str = "id") -> DataFrame:
        dead = self.tombstones(path)
        if dead is None or id_col not in df.columns:
            return df
        t = dead.groupBy("id").agg(F.max("seq").alias("_dead")).withColumnRenamed("id", "_id")
        return df.join(t, (F.col(id_col).cast("string") == F.col("_id")) & (F.col("_seq") <= F.col("_dead")), "left_anti")

    def scan(self, path: str, filters: tuple[Filter, ...] = (), columns: list[str] | None = None, limit: int = 0, id_col: str = "id", latest: tuple[str, str] | None = None, ttl: tuple[Column, Column, Column] | None = None) -> DataFrame:
        """The dataset's rows without deleted ones. Filters are pushed to the files; a limit of 0 is none."""
        df = self._data(path)
        if latest:
            df = last_writer(df, *latest, "_seq")
        df = self._alive(path, apply(df, filters), id_col)
        if ttl:
            df = live(df, *ttl)
        df = df.select(*columns) if columns else df.drop("_seq")
        return df.limit(limit) if limit > 0 else df

    def changes(self, path: str, after: int = 0) -> DataFrame:
        """Rows of batches with a sequence number above ``after`` (with ``_seq``), for a reader that catches up."""
        return self._data(path, after).where(F.col("_seq") > after)

    # ------------------------------------------------------------ edges
    def add_edges(self, path: str, edges: DataFrame) -> None:
        edges.select(F.col("subject").cast("bigint"), F.col("predicate").cast("string"), F.col("object").cast("bigint"), F.col("weight").cast("double")).write.mode("append").parquet(f"{self._folder(path)}/edges")

    def edges(self, path: str) -> DataFrame:
        at = self._folder(path)
        if not self._exists(f"{at}/edges"):
            return self.spark.createDataFrame([], "subject bigint, predicate string, object bigint, weight double")
        return self.spark.read.parquet(f"{at}/edges")

    # ------------------------------------------------------------ rewriting
    def compact(self, path: str, file_bytes: int = 128 << 20) -> None:
        """Rewrite the rows that are left, in files of about ``file_bytes``, and forget the marks; numbers of batches are kept."""
        at = self._folder(path)
        meta = self._meta(at)
        old = [meta["data"], meta["tombstones"]]
        rows, files = self._alive(path, self._data(path)), max(1, -(-self._bytes(at) // file_bytes))
        name = uuid.uuid4().hex
        meta["data"], meta["tombstones"] = f"data-{name}", f"tombstones-{name}"
        rows.repartition(files).write.option("compression", "zstd").parquet(f"{at}/{meta['data']}/b={meta['seq']}")
        self._commit(at, meta)
        for x in old:
            self._fs.delete(self._path(f"{at}/{x}"), True)

    def snapshot(self, path: str, to: str) -> None:
        """All rows and columns, and the edges, of the dataset as it is now, in a folder of its own that counts once it is complete."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        self.scan(path).write.option("compression", "zstd").parquet(f"{to}/{name}/data")
        self.edges(path).write.parquet(f"{to}/{name}/edges")
        self._write_text(f"{to}/{name}/complete", name)
        for old in self._names(to):
            if old < name:
                self._fs.delete(self._path(f"{to}/{old}"), True)

    def restore(self, path: str, source: str) -> None:
        """The dataset as the last snapshot that was completed has it."""
        whole = [n for n in self._names(source) if self._exists(f"{source}/{n}/complete")]
        if not whole:
            raise NotFound(source)
        if self._exists(f"{self._folder(path, must=False)}/meta"):
            self.drop(path)
        self.insert(path, self.spark.read.parquet(f"{source}/{whole[-1]}/data"))
        self.add_edges(path, self.spark.read.parquet(f"{source}/{whole[-1]}/edges"))
