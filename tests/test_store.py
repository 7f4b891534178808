"""The store with several writers, deletion, images and compaction."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from paperloom.operators import store as S

SCHEMA = "conversion_id string, original_name string, markdown string"


def rows(spark, *ids, name="n"):
    return spark.createDataFrame([(i * 64, name, f"text {i}") for i in ids], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return S.ConversionStore(spark, str(tmp_path / "s"), SCHEMA)


def ids(store):
    return sorted(r["conversion_id"][0] for r in store.list().select("conversion_id").collect())


def test_two_writers_leave_each_id_once(spark, store):
    other, errors = S.ConversionStore(spark, store.path, SCHEMA), []

    def put(s, chars, name):
        try:
            for k in range(3):
                s.put(rows(spark, *chars[k : k + 6], name=name))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=put, args=a) for a in ((store, "0123456789", "a"), (other, "6789abcdef", "b"), (S.ConversionStore(spark, store.path, SCHEMA), "456789ab", "c"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not errors and ids(store) == list("0123456789abcd")
    assert [e["version"] for e in store.entries()] == list(range(len(store.entries())))


def test_who_is_second_takes_out_what_the_first_brought(spark, store, monkeypatch):
    commit, made = S.ConversionStore._commit, []

    def late(self, version, kind, batch):
        if not made:
            made.append(1)
            S.ConversionStore(spark, store.path, SCHEMA).put(rows(spark, "b", "c", name="first"))
        return commit(self, version, kind, batch)

    monkeypatch.setattr(S.ConversionStore, "_commit", late)
    convert = F.udf(lambda x: x)  # counted below by its rows alone
    store.put(rows(spark, "a", "b", name="second").withColumn("markdown", convert("markdown")))
    found = {r["conversion_id"][0]: r["original_name"] for r in store.read().collect()}
    assert found == {"a": "second", "b": "first", "c": "first"} and len(store.entries()) == 2


def test_nothing_shows_before_its_entry(spark, store, monkeypatch):
    monkeypatch.setattr(S.ConversionStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.put(rows(spark, "a"))
    monkeypatch.undo()
    assert ids(store) == [] and not store.has("a" * 64)
    store.put(rows(spark, "a"))
    assert ids(store) == ["a"]


def test_deletion_and_storing_again(spark, store):
    store.put(rows(spark, "a", "b", name="old"))
    store.delete(spark.createDataFrame([("a" * 64,), ("f" * 64,), ("no id",), (None,)], "conversion_id string"))
    assert ids(store) == ["b"] and store.get("a" * 64).count() == 0
    store.put(rows(spark, "a", "b", name="new"))
    assert {r["conversion_id"][0]: r["original_name"] for r in store.list().collect()} == {"a": "new", "b": "old"}
    store.delete(rows(spark, "b"))
    store.delete(rows(spark, "b"))
    assert ids(store) == ["a"] and store.compact() and ids(store) == ["a"] and [e["kind"] for e in store.entries()] == ["base"]
    store.put(rows(spark, "b", name="again"))
    assert ids(store) == ["a", "b"] and store.list().columns == ["conversion_id", "original_name"]


def test_images(spark, store):
    image = lambda *x: spark.createDataFrame([(i * 64, n, m, bytearray(d)) for i, n, m, d in x], S.ConversionStore.IMAGES)
    store.put(rows(spark, "a", "b"), image(("a", "one.png", "image/png", b"111"), ("a", "../../two", "image/png", b"22"), ("z", "x.png", "image/png", b"0"), ("a", "one.png", "image/png", b"222")))
    names = {r["name"]: r["size"] for r in store.images("a" * 64).collect()}
    assert names["one.png"] == 3 and len(names) == 2 and all("/" not in n for n in names)
    assert bytes(store.image("a" * 64, "one.png").first()["data"]) == b"111" and store.image("a" * 64, "none").count() == 0 and store.image("z" * 64, "x.png").count() == 0
    store.put(rows(spark, "a"), image(("a", "late.png", "image/png", b"1")))  # stored already, with its images
    assert store.images("a" * 64).count() == 2
    store.delete(rows(spark, "a"))
    assert store.images("a" * 64).count() == 0 and store.compact() and store.images("a" * 64).count() == 0
    store.put(rows(spark, "a"), image(("a", "late.png", "image/png", b"1")))
    assert [r["name"] for r in store.images("a" * 64).collect()] == ["late.png"]


def test_compaction_gives_way(spark, store, monkeypatch):
    store.put(rows(spark, "a"))
    commit = S.ConversionStore._commit

    def late(self, version, kind, batch):
        if kind == "base":
            monkeypatch.undo()
            store.put(rows(spark, "b"))
        return commit(self, version, kind, batch)

    monkeypatch.setattr(S.ConversionStore, "_commit", late)
    assert not store.compact() and ids(store) == ["a", "b"]


def test_other_file_systems_rename(spark, tmp_path):
    """Through a mount table, whose files aren't local ones: the way without hard links."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.stores.link./s", f"file://{tmp_path}")
    a, b = (S.ConversionStore(spark, "viewfs://stores/s/x", SCHEMA) for _ in range(2))
    a.put(rows(spark, "a"))
    assert not b._commit(0, "add", "f" * 32)
    b.put(rows(spark, "a", "b", name="late"))
    assert ids(a) == ["a", "b"] and {r["original_name"] for r in a.read().where("original_name = 'late'").collect()} == {"late"}
