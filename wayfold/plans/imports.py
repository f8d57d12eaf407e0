"""Imports end to end: read, reset, write to every sink once, and say what was done."""

from __future__ import annotations

import dataclasses
import resource
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayfold.plans.corpus import build_corpus, judge_places, place_documents, reject_counts
from wayfold.plans.index import Index
from wayfold.schema import TYPES, ImportOptions
from wayfold.sources.exports import read_places, read_register
from wayfold.sources.scratch import scope, stored
from wayfold.sources.store import DocumentStore, fan_out

# The document types that each kind of import replaces when it starts anew.
REGISTER_TYPES, PLACE_TYPES = ("address", "street", "municipality", "postcode"), ("place",)


@dataclasses.dataclass
class ImportResult:
    """Documents in all and by type, rejected rows by reason, and for every sink what was sent, stored and how long it took."""

    documents: int = 0
    types: dict[str, int] = dataclasses.field(default_factory=dict)
    rejected: dict[str, int] = dataclasses.field(default_factory=dict)
    sinks: dict[str, dict] = dataclasses.field(default_factory=dict)
    wall: float = 0.0
    peak_mb: float = 0.0

    @property
    def ok(self) -> bool:
        return all(s["ok"] for s in self.sinks.values())


def _write(docs: DataFrame, sinks: dict[str, DocumentStore], types: tuple[str, ...], recreate: bool, rejected: dict[str, int]) -> ImportResult:
    began = time.time()

    def put(store: DocumentStore):
        return lambda rows: store.upsert(rows, "batch_order", anew=types if recreate else ())

    # the source is read once: counts are observed on the pass that stores what the sinks read
    seen = Observation()
    with scope(docs.sparkSession):
        counted = docs.observe(seen, *(F.count(F.when(F.col("doc_type") == t, 1)).alias(t) for t in TYPES))
        staged = stored(counted, "import")
        by_type = {t: n for t, n in seen.get.items() if n}
        total = sum(by_type.values())
        report = fan_out(staged, {name: put(store) for name, store in sinks.items()})
    for name, entry in report.items():
        health = sinks[name].health()
        entry |= {"sent": total if entry["ok"] else 0, "stored": health["documents"], "per_second": total / max(entry["seconds"], 0.01)}
    return ImportResult(total, by_type, rejected, report, time.time() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)


def import_register(spark: SparkSession, paths: list[str], sinks: dict[str, DocumentStore], options: ImportOptions = ImportOptions(), recreate: bool = False) -> ImportResult:
    """Headers are checked before anything is reset. With ``recreate`` all register types go first, venues stay."""
    rows = read_register(spark, paths, options)
    return _write(build_corpus(rows, options, ordered=True), sinks, REGISTER_TYPES, recreate, {})


def import_places(spark: SparkSession, path: str, sinks: dict[str, DocumentStore], options: ImportOptions = ImportOptions(), recreate: bool = False) -> ImportResult:
    """As ``import_register``, for venues; rejected rows are counted by reason."""
    judged = judge_places(read_places(spark, path, options), options.postcodes)
    rejected = {r.reject_reason: r.rows for r in reject_counts(judged).collect()}
    return _write(place_documents(judged, ordered=True), sinks, PLACE_TYPES, recreate, rejected)


def merge_results(results: list[ImportResult]) -> ImportResult:
    """Results of several workers as one: counts and times add up, the peak is the highest, a failure anywhere stays one."""
    out = ImportResult()
    for r in results:
        out.documents += r.documents
        out.wall += r.wall
        out.peak_mb = max(out.peak_mb, r.peak_mb)
        for mine, other in ((out.types, r.types), (out.rejected, r.rejected)):
            for k, n in other.items():
                mine[k] = mine.get(k, 0) + n
        for name, s in r.sinks.items():
            have = out.sinks.setdefault(name, {"ok": True, "seconds": 0.0, "sent": 0, "stored": 0})
            have |= {"ok": have["ok"] and s["ok"], "seconds": have["seconds"] + s["seconds"], "sent": have["sent"] + s["sent"], "stored": max(have["stored"], s["stored"])}
            have["per_second"] = have["sent"] / max(have["seconds"], 0.01)
            if s.get("detail"):
                have["detail"] = s["detail"]
    return out


def finish(store: DocumentStore, folder: str) -> Index:
    """The index of everything stored, built once after the last import."""
    return Index.of(store.read(), folder=folder)
