"""The document store: Parquet by document type, with upserts by id and resets by type."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions import text as X
from wayfold.schema import TYPES
from wayfold.sources.scratch import remove_path



def last_by_id(new: DataFrame, order: str | None = None) -> DataFrame:
    """One row of each id: the last by ``order`` (which goes), or the last in the order in which ``new`` is read."""
    if order is None:
        order = "_read"
        new = new.withColumn(order, F.monotonically_increasing_id())
    return new.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc(order)))).filter("_n = 1").drop("_n", order)


def merge_by_id(existing: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """``existing`` with ``new`` put over it by id, the last row of each id."""
    new = last_by_id(new, order)
    return existing.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)


def reset_types(existing: DataFrame, types: list[str]) -> DataFrame:
    return existing.filter(~F.col("doc_type").isin(*types))


class BulkError(ValueError):
    """Rows that cannot be stored; the message quotes the first of them."""


def refuse_bad(new: DataFrame, quoted: int = 5) -> None:
    bad = new.filter(F.col("id").isNull() | (F.col("id") == "") | F.col("doc_type").isNull() | ~F.col("doc_type").isin(*TYPES))
    found = bad.select("id", X.clip(F.col("doc_type"), 40).alias("doc_type")).limit(quoted).collect()
    if found:
        raise BulkError("; ".join(f"id {r.id!r} of type {r.doc_type!r}" for r in found))


class StoreConflict(RuntimeError):
    """Another writer committed first; what was written is not part of the store."""


class DocumentStore:
    """Documents below one path in immutable versions, a folder for each type, and manifests that say which folders count.

    A change writes a version beside the others and becomes visible by one new manifest, which is created only if nobody
    else has created it: readers see the state before or after, never one between, and a writer that stops half-way has
    changed nothing. Types that a change does not touch keep their folders.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # ---- manifests

    def _hadoop(self, path: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        found, store = self._hadoop(path)
        return [s.getPath().getName() for s in store.listStatus(found)] if store.exists(found) else []

    def versions(self) -> list[int]:
        """The numbers of all manifests, the current one last."""
        return sorted(int(n) for n in self._list(f"{self.path}/manifests") if n.isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """``types`` (type to version) and ``schema`` (JSON) of a manifest, the current one by default."""
        known = self.versions()
        if not known:
            return {"number": 0, "types": {}, "schema": None}
        number = known[-1] if number is None else number
        path, store = self._hadoop(f"{self.path}/manifests/{number}")
        stream = store.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {"number": number, **json.loads(text)}

    def _commit(self, before: dict, types: dict[str, str], schema: str | None) -> None:
        path, store = self._hadoop(f"{self.path}/manifests/{before['number'] + 1}")
        staged, _ = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = store.create(staged)
        stream.write(bytearray(json.dumps({"types": types, "schema": schema}).encode()))
        stream.close()
        if store.exists(path) or not store.rename(staged, path):
            store.delete(staged, False)
            raise StoreConflict(f"version {before['number'] + 1} of {self.path} is there already")

    # ---- reading

    def read(self, number: int | None = None) -> DataFrame:
        """The documents of the current version, or of an earlier one."""
        now = self.manifest(number)
        if not now["types"]:
            if now["schema"] is None:
                raise FileNotFoundError(f"no store at {self.path}")
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(now["schema"])))
        folders = [f"{self.path}/data/version={v}/doc_type={t}" for t, v in now["types"].items()]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*folders).drop("version")

    def types(self) -> list[str]:
        """The types that are stored."""
        return [t for t in TYPES if t in self.manifest()["types"]]

    def count(self) -> int:
        return self.read().count() if self.types() else 0

    def health(self) -> dict:
        """Whether the store can be read, and how many documents it has."""
        try:
            if not self.versions():
                return {"ok": False, "detail": f"no store at {self.path}", "documents": 0}
            return {"ok": True, "detail": "", "documents": self.count()}
        except Exception as problem:  # any failure is the answer here
            return {"ok": False, "detail": str(problem)[:200], "documents": 0}

    # ---- changing

    def _write(self, docs: DataFrame, before: dict, gone: tuple[str, ...]) -> None:
        """Commits ``docs`` as the whole of the types it holds; the types in ``gone`` that it does not hold go."""
        version = uuid.uuid4().hex
        folder = f"{self.path}/data/version={version}"
        docs.write.partitionBy("doc_type").parquet(folder)
        written = [n.removeprefix("doc_type=") for n in self._list(folder) if n.startswith("doc_type=")]
        kept = {t: v for t, v in before["types"].items() if t not in gone}
        self._commit(before, kept | {t: version for t in written}, docs.schema.json())

    def replace(self, docs: DataFrame) -> None:
        """Replaces the types that ``docs`` holds."""
        self._write(docs, self.manifest(), ())

    def reset(self, types: tuple[str, ...]) -> None:
        """Takes all documents of some types out; others are not touched."""
        now = self.manifest()
        if set(types) & set(now["types"]):
            self._commit(now, {t: v for t, v in now["types"].items() if t not in types}, now["schema"])

    def upsert(self, new: DataFrame, order: str | None = None, anew: tuple[str, ...] = ()) -> None:
        """Merges by id, whatever type an id had before; of an id's rows the last in ``order`` counts, or the last as they
        are read. All rows are refused where one cannot be stored. The types in ``anew`` lose what they held, in the same commit."""
        refuse_bad(new)
        now = self.manifest()
        left = {t: v for t, v in now["types"].items() if t not in anew}
        if not left:
            return self._write(last_by_id(new, order), now, tuple(now["types"]))
        old = self.read().filter(F.col("doc_type").isin(*left))
        named = new.select("doc_type").union(old.join(new.select("id"), "id", "left_semi").select("doc_type"))
        touched = [r[0] for r in named.distinct().collect()]  # five at most
        self._write(merge_by_id(old.filter(F.col("doc_type").isin(*touched)), new, order), now, (*touched, *anew))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what none of the last ``keep`` versions needs."""
        known = self.versions()
        needed = {v for n in known[-keep:] for v in self.manifest(n)["types"].values()}
        for name in self._list(f"{self.path}/data"):
            if name.startswith("version=") and name.removeprefix("version=") not in needed:
                remove_path(self.spark, f"{self.path}/data/{name}")
        for n in known[:-keep]:
            remove_path(self.spark, f"{self.path}/manifests/{n}")


def fan_out(docs: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, dict]:
    """``docs`` (a stored table, so that no sink makes it again) to all sinks; one that fails is reported and the others go on."""
    report = {}
    for name, write in sinks.items():
        began = time.time()
        try:
            write(docs)
            report[name] = {"ok": True, "seconds": time.time() - began}
        except Exception as problem:
            report[name] = {"ok": False, "seconds": time.time() - began, "detail": str(problem)[:200]}
    return report


def import_summary(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"))
