"""Files with line breaks in splits, versions of the store, imports of repeated ids, and figures without one task a key."""

import csv
import io
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from test_sources import cells
from wayfold.operators import evaluation as E
from wayfold.plans import corpus as C
from wayfold.plans import imports as P
from wayfold.schema import PLACE_COLUMNS, REGISTER_COLUMNS, ImportOptions
from wayfold.sources import quoted as Q
from wayfold.sources.exports import read_places, read_register
from wayfold.sources.store import DocumentStore, StoreConflict


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "30000", "spark.sql.files.openCostInBytes": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_splits_give_the_rows_of_a_serial_reader(spark, small_splits, tmp_path):
    rnd = random.Random(3)

    def cell():
        k = rnd.random()
        if k < 0.3:
            return "".join(rnd.choice('abcé "\n,\r') for _ in range(rnd.randint(1, 30))) + "."
        if k < 0.304:  # longer than several splits
            return "\n".join(f'line, "x" {i}' for i in range(6000))
        return "".join(rnd.choice('abc5"') if i else rnd.choice("abc") for i in range(rnd.randint(0, 9)))

    rows = [[str(i), cell(), cell()] for i in range(2500)]
    for end in ("\n", "\r\n"):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end).writerows([["a", "b", "c"], *rows])
        path = tmp_path / f"x{len(end)}.csv"
        path.write_bytes(out.getvalue().encode())
        schema = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])
        assert Q.file_lines(spark, str(path)).select("split").distinct().count() > 5
        got = [[r.a, r.b or "", r.c or ""] for r in Q.read_quoted(spark, str(path), schema).orderBy("ord").collect()]
        assert got == list(csv.reader(io.StringIO(out.getvalue(), newline="")))[1:] == rows


def test_maps_compose(spark):
    """A line's map, by a cell-by-cell reader of one character at a time."""

    def ends_inside(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if state == "quoted":
                state = "closing" if c == '"' else "quoted"
            elif state == "closing":
                state = "quoted" if c == '"' else "start" if c == "," else "plain"
            else:
                state = "start" if c == "," else "quoted" if c == '"' and state == "start" else "plain"
        return state == "quoted"

    import pyarrow as pa

    rnd = random.Random(1)
    lines = ["".join(rnd.choice('a",') for _ in range(rnd.randint(0, 7))) for _ in range(3000)]
    outside, inside = Q.outcomes(pa.array(lines))
    assert outside.tolist() == [ends_inside(x, False) for x in lines] and inside.tolist() == [ends_inside(x, True) for x in lines]
    for start in (False, True):
        state, want = start, []
        for x in lines:
            want.append(state)
            state = ends_inside(x, state)
        begins, last = Q.walk(outside, inside, start)
        assert begins.tolist() == want and last == state


def write_register(path, rows):
    with open(path, "w", newline="") as out:
        csv.writer(out).writerows([REGISTER_COLUMNS, *rows])
    return str(path)


def test_register_cells_with_line_breaks(spark, tmp_path):
    rows = [cells(), cells(address_id="2", streetname_nl="Kerk\nstraat", street_id="s9"), cells(address_id="3", postname_nl='Post "A"\r\n, B')]
    got = read_register(spark, [write_register(tmp_path / "r.csv", rows)]).orderBy("ord").collect()
    assert [(r.address_id, r.streetname_nl, r.postname_nl) for r in got] == [("1", "Kerkstraat", "Sint-Job"), ("2", "Kerk\nstraat", "Sint-Job"), ("3", "Kerkstraat", 'Post "A"\r\n, B')]


def test_last_of_an_import_counts(spark, tmp_path):
    rows = [cells(house_number=str(n), **{"EPSG:4326_lat": str(50 + n)}) for n in range(1, 8)]
    store = DocumentStore(spark, str(tmp_path / "docs"))
    result = P.import_register(spark, [write_register(tmp_path / "r.csv", rows)], {"main": store}, ImportOptions.level("address"))
    assert result.ok and result.types == {"address": 7} and store.count() == 1
    assert store.read().first().house_number == "7"
    store.upsert(spark.createDataFrame([("x", "street", 1), ("x", "street", 2), ("x", "place", 3)], "id string, doc_type string, v int").select("id", "doc_type"))
    assert [r.doc_type for r in store.read().filter("id = 'x'").collect()] == ["place"]


def test_addresses_behind_other_members(spark, tmp_path):
    ok = {"addressCountry": "BE", "postalCode": "9500", "addressLocality": "Gent", "streetAddress": "Kerkstraat 1"}
    members = [{"nl": "-", "fr": ok}, {"nl": [], "fr": ok}, {"nl": None, "pt": ok}, {"nl": {}, "fr": ok}, {"nl": 5}, [ok], "x", {"fr": {**ok, "postalCode": "9000"}, "nl": {**ok, "streetAddress": "Meir"}}]
    with open(tmp_path / "p.csv", "w", newline="") as out:
        csv.writer(out).writerows([PLACE_COLUMNS, *([str(i), '{"nl":"Zaal"}', "", json.dumps(m)] for i, m in enumerate(members))])
    judged = C.judge_places(read_places(spark, str(tmp_path / "p.csv")))
    assert {r.place_cdbid: r.reject_reason for r in judged.collect()} == {"0": None, "1": None, "2": None, "3": "not in belgium", "4": "no address", "5": "no address", "6": "no address", "7": None}
    assert {r.id: r.street_name for r in C.place_documents(judged).collect()} == {"place:0": "Kerkstraat 1", "place:1": "Kerkstraat 1", "place:2": "Kerkstraat 1", "place:7": "Meir"}


def test_versions(spark, tmp_path, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, "id string, doc_type string, v int")
    rows = lambda s, n=None: {(r.id, r.doc_type, r.v) for r in s.read(n).collect()}
    store = DocumentStore(spark, str(tmp_path / "docs"))
    with pytest.raises(FileNotFoundError):
        store.read()
    store.upsert(make([("a", "street", 1), ("a", "street", 2), ("b", "place", 1)]))
    first = rows(store)
    assert first == {("a", "street", 2), ("b", "place", 1)}
    # a writer that stops before its commit has changed nothing
    with monkeypatch.context() as m:
        m.setattr(DocumentStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(make([("a", "place", 9), ("c", "street", 9)]))
    assert rows(store) == first and store.versions() == [1]
    # of two writers that began alike the second is told
    before = store.manifest()
    store.upsert(make([("b", "street", 3)]))
    with pytest.raises(StoreConflict):
        store._commit(before, {}, before["schema"])
    assert rows(store) == {("a", "street", 2), ("b", "street", 3)} and rows(store, 1) == first
    # a type that a change does not touch keeps its folder
    kept = store.manifest()["types"]["street"]
    store.upsert(make([("p", "postcode", 1)]))
    assert store.manifest()["types"]["street"] == kept
    # anew: one commit, no state without the type between
    store.upsert(make([("z", "street", 7)]), anew=("street", "place"))
    assert rows(store) == {("z", "street", 7), ("p", "postcode", 1)} and store.versions() == [1, 2, 3, 4]
    store.vacuum(keep=1)
    assert rows(store) == {("z", "street", 7), ("p", "postcode", 1)} and store.versions() == [4]
    store.reset(("street", "postcode"))
    assert store.count() == 0 and store.read().columns == ["id", "doc_type", "v"] and store.health() == {"ok": True, "detail": "", "documents": 0}


def test_percentiles_of_one_engine(spark):
    rnd = random.Random(6)
    values = [rnd.choice([1.0, 2.0, 2.0, 2.0, rnd.random() * 10]) for _ in range(4000)] + [None, 3.5]
    samples = spark.createDataFrame([("a", "q", v) for v in values] + [("b", "q", 5.0), ("c", "q", None)], "engine string, query string, took_ms double")
    got = {r.engine: r for r in E.latency_summary(samples, "engine").collect()}
    known = sorted(v for v in values if v is not None)

    def at(p):
        h = p * (len(known) - 1)
        k = int(h)
        return known[k] + (h - k) * (known[min(k + 1, len(known) - 1)] - known[k])

    assert all(abs(got["a"][name] - at(p)) < 1e-9 for name, p in E.PERCENTILES.items()) and got["a"].n == len(known)
    assert (got["b"].p50, got["b"].p99, got["c"].n, got["c"].p50) == (5.0, 5.0, 0, None)


def test_sliding_median_across_runs(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 32)
    rnd = random.Random(7)
    values = {e: [rnd.random() for _ in range(n)] for e, n in (("a", 150), ("b", 3), ("c", 40))}
    samples = spark.createDataFrame([(e, i, v) for e, vs in values.items() for i, v in enumerate(vs)], "engine string, iter long, took_ms double").repartition(3)
    got = {(r.engine, r.iter): r.rolling_ms for r in E.rolling_median(samples).collect()}
    assert len(got) == 193 and all(abs(m - statistics.median(values[e][max(0, i - 19) : i + 1])) < 1e-12 for (e, i), m in got.items())
