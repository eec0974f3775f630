import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.config import DEFAULTS, config, merged
from vecloom.database import Database
from vecloom.operators import monitor, mutations
from vecloom.schema import RECORDS, check_k, check_vector, encode_id, partition_name_ok
from vecloom.sources import files
from vecloom.sources.store import VersionedTable


def random_rows(n, dim=10, seed=0):
    rng = np.random.default_rng(seed)
    return [{"id": f"test-{i}", "vector": rng.random(dim).tolist(), "metadata": {"testIndex": i, "group": i % 3}} for i in range(n)]


def test_ids_and_overwrites(spark):
    db = Database(spark)
    assert db.add_vector([1.0, 2.0, 3.0]) == "1"
    db.add_vector([0.0, 0.0, 1.0], id=5, metadata={"source": "test", "count": 5})
    db.add_vector([0.5, 0.5], id="test")
    assert db.add_vector([9.0]) == "6"
    assert db.vector_dimension("test") == 2 and db.has_vector(5) and not db.has_vector("5")
    db.add_vector([7.0, 7.0, 7.0], id=5)
    assert db.get_vector(5) == [7.0, 7.0, 7.0] and db.get_metadata(5) == {"source": "test", "count": 5}
    assert db.update_metadata(5, {"count": 10, "newField": "value"}) and db.get_metadata(5) == {"source": "test", "count": 10, "newField": "value"}
    assert db.update_metadata(5, lambda m: {**m, "count": m["count"] + 1}) and db.get_metadata(5)["count"] == 11
    assert db.set_metadata(5, {"only": True}) and db.get_metadata(5) == {"only": True}
    assert not db.update_metadata("none", {}) and not db.set_metadata(77, {}) and not db.update_vector("none", [1.0])
    assert db.update_vector(5, [1.0, 1.0]) and db.get_vector(5) == [1.0, 1.0] and db.get_metadata(5) == {"only": True}
    assert db.delete_vector(5) and not db.delete_vector(5) and db.get_vector(5) is None
    assert db.find("6").first().id_is_num and db.find("test").count() == 1
    s = db.stats()
    assert s["vector_count"] == 3 and s["dimensions"] == {1: 1, 2: 1, 3: 1}


def test_numbers_and_texts_are_different_ids(spark):
    db = Database(spark)
    db.bulk_add([{"id": 1, "vector": [1.0, 0.0], "metadata": {"what": "number", "w": 5}}, {"id": "1", "vector": [0.9, 0.1], "metadata": {"what": "text", "w": 1}}, {"id": "x", "vector": [0.0, 1.0]}])
    got = db.search([1.0, 0.0], 2, include_metadata=True, include_vectors=True).orderBy("rank").collect()
    assert [(r.id, r.id_is_num, json.loads(r.metadata)["what"], round(r.vector[0], 1)) for r in got] == [("1", True, "number", 1.0), ("1", False, "text", 0.9)]
    assert [r.id_is_num for r in db.search([1.0, 0.0], 2, rerank_method="diversity").orderBy("rank").collect()] == [True, False]
    assert db.search([1.0, 0.0], 1, rerank_method="weighted", weights={"w": 1.0}, fetch_k=3).first().id_is_num
    assert {(r.query_id, r.id_is_num) for r in db.batch_search([[1.0, 0.0], [0.9, 0.1]], 1).collect()} == {(0, True), (1, False)}
    pair = db.relationships(0.2, include_metadata=True).collect()
    assert [(r.id_a, r.id_b, {r.id_a_is_num, r.id_b_is_num}) for r in pair] == [("1", "1", {True, False})]
    assert {(r.id, r.id_is_num) for r in db.communities(0.2).collect()} == {("1", True), ("1", False)}
    for kind in ("ivf", "lsh", "pq", "hnsw"):
        db.build_index(kind, **({"clusters": 2} if kind in ("ivf", "pq") else {"tables": 4, "hashes": 1} if kind == "lsh" else {}))
        rows = db.search([1.0, 0.0], 2, method=kind, include_metadata=True).orderBy("rank").collect()
        assert [json.loads(r.metadata)["what"] for r in rows] == ["number", "text"], kind
        assert db.search([1.0, 0.0], 3, method=kind, filter=lambda id, m: id == "1" and m["what"] == "text").count() == 1, kind
    assert db.similar(1, 1).first().id_is_num is False
    db.delete_vector("1")
    assert db.has_vector(1) and not db.has_vector("1")


def test_numbers_are_given_out_once(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Database(spark, path)
    assert [db.add_vector([1.0]) for _ in range(2)] == ["1", "2"]
    db.delete_vector(2)
    assert db.add_vector([2.0]) == "3"
    db.delete_vector(3)
    assert Database(spark, path).add_vector([3.0]) == "4"


def test_catalogue_is_saved_with_each_change(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Database(spark, path, partitioning={"capacity": 2})
    db.create_partition("p1")
    assert list(Database(spark, path).catalog) == ["p1"]
    db.bulk_add(random_rows(3))
    other = Database(spark, path)
    assert other.stats()["vector_count"] == 3 and list(other.catalog) == ["p1", "p2"] and other.active_partition() == "p2"


def test_bad_items_stamps_and_progress(spark):
    db, steps = Database(spark), []
    out = db.bulk_add([{"id": "a", "vector": [1.0, 2.0]}, {"id": "b"}, {"id": "c", "vector": []}, {"id": True, "vector": [1.0]}, {"id": "d", "vector": ["x"]}, {"id": "e", "vector": [3.0], "metadata": {"k": 1}}], skip_bad=True, stamp=True, progress=lambda share, step: steps.append(share))
    assert out["count"] == 2 and out["skipped"] == [1, 2, 3, 4] and steps == sorted(steps) and steps[-1] == 1.0
    assert db.get_metadata("a")["dimension"] == 2 and db.get_metadata("e")["k"] == 1 and "createdAt" in db.get_metadata("e")
    with pytest.raises(KeyError):
        db.bulk_add([{"id": "b"}])
    db.create_partition("other", active=True)
    db.bulk_add([{"id": "z", "vector": [1.0, 2.0]}])
    db.build_index("hnsw", partition_ids=["other"], progress=lambda share, step: steps.append((share, step)))
    assert steps[-2:] == [(0.0, "hnsw"), (1.0, "hnsw")] and [r.id for r in db.search([1.0, 2.0], 5, method="hnsw").collect()] == ["z"]


def test_single_precision(spark):
    db = Database(spark)
    db.add_vector([0.1, 0.2, 0.3], id="a")
    assert db.get_vector("a") == [0.10000000149011612, 0.20000000298023224, 0.30000001192092896]


def test_spill(spark):
    db = Database(spark, partitioning={"capacity": 40})
    events = []
    db.on("*", lambda e: events.append(e["event"]))
    out = db.bulk_add(random_rows(100))
    assert out["count"] == 100 and len(out["partition_ids"]) == 3 and db.stats()["vector_count"] == 100
    assert sorted(r.vector_count for r in db.partition_stats().collect()) == [20, 40, 40]
    db.bulk_add(random_rows(30, seed=1))  # the same ids are written over
    assert db.stats()["vector_count"] == 100
    assert "partition:create" in events and "vector:bulk" in events
    strict = Database(spark, partitioning={"capacity": 5, "auto_create": False})
    with pytest.raises(RuntimeError):
        strict.bulk_add(random_rows(6))


def test_partitions(spark):
    db = Database(spark)
    db.create_partition("one")
    assert db.active_partition() == "one"
    db.create_partition("two", active=True)
    assert db.active_partition() == "two" and db.partitions().where("active").count() == 1
    for bad in ("one", "a b", ""):
        with pytest.raises(ValueError):
            db.create_partition(bad)
    with pytest.raises(KeyError):
        db.set_active_partition("none")
    db.bulk_add(random_rows(3))
    assert db.partition("two").count() == 3 and db.partition("one").isEmpty()


def test_search_everywhere(spark):
    db = Database(spark)
    db.bulk_add(random_rows(80))
    q = db.get_vector("test-3")
    for kind in ("ivf", "lsh", "pq", "hnsw"):
        db.build_index(kind, **({"clusters": 16} if kind in ("ivf", "pq") else {"tables": 16, "hashes": 4} if kind == "lsh" else {}))
    exact = db.search(q, 5, include_metadata=True, include_vectors=True).orderBy("rank").collect()
    assert exact[0].id == "test-3" and json.loads(exact[0].metadata)["testIndex"] == 3 and len(exact[0].vector) == 10
    for kind in ("ivf", "lsh", "pq", "hnsw"):
        got = db.search(q, 5, method=kind, filter={"group": 0}).orderBy("rank").collect()
        assert got[0].id == "test-3" and all(int(r.id[5:]) % 3 == 0 for r in got), kind
    mmr = db.search(q, 5, rerank_method="diversity", fetch_k=20, balance=0.3).orderBy("rank").collect()
    assert len(mmr) == 5 and mmr[0].id == "test-3"
    w = db.search(q, 5, rerank_method="weighted", weights={"testIndex": 1.0}, fetch_k=80).orderBy("rank").first()
    assert w.id == "test-79"
    assert [r.rank for r in db.search(q, 3, offset=2).orderBy("rank").collect()] == [1, 2, 3]
    assert "test-3" not in [r.id for r in db.similar("test-3", 4).collect()] and db.similar("none").isEmpty()
    assert db.batch_search([q, q], 2).count() == 4
    assert db.metadata_search({"group": 1}, limit=2).count() == 2
    first = db.search(q, 5, use_cache=True)
    assert db.search(q, 5, use_cache=True) is first and db.search(q, 4, use_cache=True) is not first
    for kind, options in (("ivf", {"nprobe": 16}), ("lsh", {"probes": 8}), ("pq", {"exact_from": 80}), ("hnsw", {})):
        rows = db.batch_search([q, [0.5] * 10], 3, method=kind, **options).collect()
        assert {r.id for r in rows if r.query_id == 0 and r["rank"] == 1} == {"test-3"} and len(rows) == 6 and all(r.partition_id for r in rows), kind
    assert db.stats()["clusters"]["count"] == 16 and db.cluster_stats().agg(F.sum("size")).first()[0] == 80
    db.add_vector([0.0] * 10, id="new")
    assert db.search(q, 5, use_cache=True) is not first
    with pytest.raises(ValueError):
        db.search(q, 5, method="ivf")  # a change dropped it
    # a graph follows changes
    assert db.search([0.0] * 10, 1, method="hnsw").first().id == "new"
    db.update_vector("new", [9.0] * 10)
    assert db.search([9.0] * 10, 1, method="hnsw").first().id == "new" != db.search([0.0] * 10, 1, method="hnsw").first().id
    db.delete_vector("test-3")
    assert db.search(q, 1, method="hnsw").first().id != "test-3"
    line = db.snapshot()
    assert line["errors"] == db.stats()["errors"] == 1 and line["searches"] == len(db.log) and list(db.history) == [line]
    s = db.search_stats().first()
    assert s.searches == len(db.log) > 0 and 0 < s.hit_rate < 1
    assert db.communities(10.0).select("community").distinct().count() == 1


def test_persistence(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Database(spark, path)
    db.bulk_add(random_rows(20))
    db.create_partition("later")
    db.close()
    with pytest.raises(RuntimeError):
        db.search([0.0] * 10)
    db.close()
    again = Database(spark, path)
    assert again.stats()["vector_count"] == 20 and set(again.catalog) == {"p1", "later"}
    assert again.search(again.get_vector("test-4"), 1).first().id == "test-4"
    again.delete_vector("test-4")
    assert not Database(spark, path).has_vector("test-4") and again.health()["status"] == "ok"


def test_writes_touch_their_partitions_only(spark, tmp_path, monkeypatch):
    from vecloom.sources import store

    path = str(tmp_path / "db")
    db = Database(spark, path, partitioning={"capacity": 5})
    db.bulk_add(random_rows(12))
    db.bulk_add([{"id": "late", "vector": [1.0]}])
    db.update_metadata("test-7", {"new": 1})
    records = tmp_path / "db" / "records"
    written = {v.name: sorted(p.name[13:] for p in v.iterdir() if p.name.startswith("partition_id=")) for v in records.iterdir() if v.is_dir()}
    assert written == {"v00000001": ["p1", "p2", "p3"], "v00000002": ["p3"], "v00000003": ["p2"]}
    again = Database(spark, path, partitioning={"capacity": 5})
    assert again.stats()["vector_count"] == 13 and again.get_metadata("test-7")["new"] == 1 and again.has_vector("late")
    db.bulk_add([{"id": "test-0", "vector": [5.0]}])  # moves from the first partition to the last
    assert db.records.where("id = 'test-0'").count() == 1 and db.records.where("id = 'test-0'").first().partition_id == "p3"
    assert db._table.vacuum(1) == ["v00000001", "v00000002"] and Database(spark, path).stats()["vector_count"] == 13
    monkeypatch.setattr(store, "MOST_VERSIONS", 2)
    db.delete_vector("late")
    assert db._table.vacuum(1) == ["v00000003", "v00000004"] and Database(spark, path).stats()["vector_count"] == 12


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.current() is None and t.load() is None
    for n in (1, 2, 3):
        t.save(spark.range(n))
    assert t.load().count() == 3 and t.load(version="v00000001").count() == 1
    # a save that fails leaves the table as it was, and what it wrote is not met
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        t.save(broken, {"n": 4})
    assert t.current() == "v00000003" and t.load().count() == 3 and t.state() is None
    assert t.save(spark.range(6), {"n": 6}) == "v00000005" and t.load().count() == 6 and t.state() == {"n": 6}
    assert t.vacuum(1) == ["v00000001", "v00000002", "v00000003", "v00000004"] and t.load().count() == 6


def test_files(spark, tmp_path):
    rows = [("p", "a", False, 0, [1.0, 2.0], '{"x": "q\\"uote, comma"}'), ("p", "1", True, 1, [3.5], None)]
    df = spark.createDataFrame(rows, RECORDS)
    for kind in ("parquet", "json", "csv"):
        files.export(df, str(tmp_path / kind), kind)
        got = files.import_records(spark, str(tmp_path / kind), kind).orderBy("seq").collect()
        assert [(r.id, r.id_is_num, r.vector, r.metadata) for r in got] == [(r[1], r[2], r[4], r[5]) for r in rows], kind
    files.write_packed(df, str(tmp_path / "packed"))
    assert sorted(r.vector for r in files.read_packed_rows(spark, str(tmp_path / "packed")).collect()) == [[1.0, 2.0], [3.5]]
    d = tmp_path / "old"
    d.mkdir()
    data = files.to_bytes([1, 2]) + files.to_bytes([3])
    meta = {"version": 1, "vectors": [{"id": "a", "offset": 0, "length": 8, "dim": 2}, {"id": 7, "offset": 8, "length": 4, "dim": 1}, {"id": "cut", "offset": 12, "length": 8, "dim": 2}], "metadata": {"7": {"k": 1}}}
    (d / "meta.json").write_text(json.dumps(meta))
    (d / "vec.bin").write_bytes(data)
    got = files.read_packed(spark, str(d)).orderBy("seq").collect()
    assert [(r.id, r.id_is_num, r.vector, r.metadata) for r in got] == [("a", False, [1.0, 2.0], None), ("7", True, [3.0], '{"k": 1}')]
    assert files.read_packed(spark, str(tmp_path / "missing")).isEmpty()
    with pytest.raises(ValueError):
        files.from_bytes(b"12345")


def test_numbering(spark, monkeypatch):
    monkeypatch.setattr(mutations, "CHUNK", 4)
    rng = np.random.default_rng(3)
    ids = [None if rng.random() < 0.4 else (int(rng.integers(0, 30)) if rng.random() < 0.5 else "t") for _ in range(25)]
    want, counter = [], 3
    for i in ids:
        if i is None:
            want.append(str(counter))
            counter += 1
        else:
            counter = max(counter, i + 1) if isinstance(i, int) else counter
            want.append(str(i))
    df = spark.createDataFrame([(n * 10, None if i is None else str(i), None if i is None else isinstance(i, int)) for n, i in enumerate(ids)], "o int, id string, id_is_num boolean")
    placed = mutations.numbered(df, ["o"])
    assert [r.pos for r in placed.orderBy("o").collect()] == list(range(25))
    assert [r.id for r in mutations.assign_ids(placed, 3).orderBy("o").collect()] == want


def test_monitor(spark):
    log = spark.createDataFrame([(float(i), "scan" if i % 2 else "hnsw", i % 4 == 0) for i in range(1, 21)], "duration_ms double, method string, cache_hit boolean")
    s = monitor.summary(log).first()
    assert s.p95_ms == 19.0 and s.queries_per_minute == 20 and s.hit_rate == 0.25 and s.avg_ms == 10.5
    assert monitor.per_method(log).count() == 2
    t = monitor.Timer()
    with t.measure("x"):
        pass
    assert len(t.splits["x"]) == 1


def test_config_and_checks(monkeypatch):
    monkeypatch.setenv("VECLOOM_PATH", "/x")
    assert config()["path"] == "/x" and config(path="/y", hnsw={"m": 4})["hnsw"] == {"m": 4, "ef_construction": 200, "ef_search": 50}
    assert merged(DEFAULTS, None) == DEFAULTS and DEFAULTS["hnsw"]["m"] == 16
    assert encode_id(1) == ("1", True) and encode_id("1") == ("1", False) and partition_name_ok("a.b-c_1") and not partition_name_ok("a/b")
    for bad in (lambda: encode_id(True), lambda: check_k(-1), lambda: check_k(2000, True), lambda: check_vector([], strict=True), lambda: check_vector([1.0], 2, True)):
        with pytest.raises((ValueError, TypeError)):
            bad()
    assert F is not None
