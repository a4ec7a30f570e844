from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quern.operators import store

SCHEMA = "id long, v string"


def rows(spark, ids, v):
    return spark.createDataFrame([(i, f"{v}{i}") for i in ids], SCHEMA)


def parquet_files(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(f"{path}/data") for n in names if n.endswith(".parquet")}


def content(df):
    return {r["id"]: r["v"] for r in df.collect()}


def test_an_upsert_writes_only_its_buckets(spark, tmp_path):
    st = store.Store(spark, str(tmp_path), buckets=64)
    st.upsert("t", rows(spark, range(2000), "a"), ["id"])
    before, folders = parquet_files(tmp_path), st.tables()["t"].folders
    assert len(folders) == 64
    new = rows(spark, [1, 2, 3, 5000, 5001], "b")
    st.upsert("t", new, ["id"])
    touched = {str(r[0]) for r in new.select(st.tables()["t"].bucket()).collect()}
    after = st.tables()["t"].folders
    assert {b for b in after if after[b] != folders.get(b)} == touched and len(touched) <= 5
    assert len(parquet_files(tmp_path)) - len(before) <= len(touched)
    want = {i: f"a{i}" for i in range(2000)} | {i: f"b{i}" for i in (1, 2, 3, 5000, 5001)}
    assert content(st.read("t")) == want and content(st.read("t", version=1)) == {i: f"a{i}" for i in range(2000)}
    assert content(st.find("t", "id", 5000)) == {5000: "b5000"} and "bucket" not in st.read("t").columns
    st.delete("t", rows(spark, [1, 77], ""), ["id"])
    assert content(st.read("t")) == {i: v for i, v in want.items() if i not in (1, 77)}
    st.delete("t", spark.createDataFrame([("a5",), ("none",)], "v string"), ["v"])  # not the bucket's column
    assert 5 not in content(st.read("t")) and st.read("t").count() == len(want) - 3


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    st = store.Store(spark, str(tmp_path), buckets=4)
    with st.change() as c:
        c.upsert("t", rows(spark, range(10), "a"), ["id"])
        c.upsert("u", rows(spark, range(3), "x"), ["id"])
    with pytest.raises(ZeroDivisionError), st.change() as c:
        c.upsert("t", rows(spark, range(5), "b"), ["id"])
        1 / 0  # noqa: B018
    assert st.version() == 1 and set(content(st.read("t")).values()) == {f"a{i}" for i in range(10)}
    monkeypatch.setattr(store.Files, "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        st.upsert("t", rows(spark, range(5), "b"), ["id"])  # written, never committed
    monkeypatch.undo()
    fresh = store.Store(spark, str(tmp_path))
    assert fresh.version() == 1 and content(fresh.read("t")) == {i: f"a{i}" for i in range(10)} and os.listdir(f"{tmp_path}/staged") in ([], [f for f in os.listdir(f"{tmp_path}/staged") if f.endswith(".crc")])
    st.upsert("t", rows(spark, [3], "c"), ["id"])
    assert content(st.read("t"))[3] == "c3" and content(st.read("u")) == {0: "x0", 1: "x1", 2: "x2"}


def test_changes_that_meet(spark, tmp_path):
    a, b = store.Store(spark, str(tmp_path), 4), store.Store(spark, str(tmp_path), 4)
    a.upsert("t", rows(spark, [1], "a"), ["id"])
    with a.change() as c:
        c.upsert("t", rows(spark, [2], "a"), ["id"])
        b.upsert("u", rows(spark, [9], "b"), ["id"])  # another table: both stay
    assert content(a.read("t")) == {1: "a1", 2: "a2"} and content(a.read("u")) == {9: "b9"}
    with pytest.raises(store.Conflict), a.change() as c:
        c.upsert("t", rows(spark, [3], "a"), ["id"])
        b.upsert("t", rows(spark, [4], "b"), ["id"])
    assert content(a.read("t")) == {1: "a1", 2: "a2", 4: "b4"}
    a.upsert("t", rows(spark, [3], "a"), ["id"])
    assert set(content(b.read("t"))) == {1, 2, 3, 4}


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    st = store.Store(spark, str(tmp_path), buckets=8)
    for n in range(5):
        st.upsert("t", rows(spark, range(n, n + 3), f"v{n}-"), ["id"])
    st.write("gone", rows(spark, [1], "g"), ["id"])
    st.drop("gone")
    with pytest.raises(KeyError):
        st.drop("gone")
    want = content(st.read("t"))
    assert st.vacuum() == 0  # all is young
    held = len(parquet_files(tmp_path))
    assert st.vacuum(keep=1, age_s=-60) > 0 and len(parquet_files(tmp_path)) < held
    assert content(st.read("t")) == want and st.read("gone") is None and len([n for n in os.listdir(f"{tmp_path}/manifests") if n.endswith(".json") and not n.startswith(".")]) == 1
    assert len(parquet_files(tmp_path)) == len(st.tables()["t"].folders) and not os.path.exists(f"{tmp_path}/data/gone") or not parquet_files(f"{tmp_path}/data/gone")


def test_empty_tables_new_columns_and_ties(spark, tmp_path):
    st = store.Store(spark, str(tmp_path), buckets=4)
    assert st.read("t") is None and st.find("t", "id", 1) is None and st.version() == 0
    st.delete("t", rows(spark, [1], ""), ["id"])
    assert st.version() == 0  # nothing changed, nothing is written
    st.upsert("t", rows(spark, [], "a"), ["id"])
    assert st.read("t").columns == ["id", "v"] and st.read("t").count() == 0
    st.upsert("t", rows(spark, [1, 2], "a"), ["id"])
    st.upsert("t", spark.createDataFrame([(2, "b", 7), (2, "c", 9), (None, "n", 1)], "id long, v string, w int"), ["id"], order="w")
    assert sorted(map(tuple, st.read("t").select("id", "v", "w").collect()), key=str) == sorted([(1, "a1", None), (2, "c", 9), (None, "n", 1)], key=str)
    st.upsert("t", spark.createDataFrame([(None, "n", 1)], "id long, v string, w int"), ["id"])
    st.delete("t", rows(spark, [1, 2], ""), ["id"])
    assert [r["v"] for r in st.read("t").collect()] == ["n"]
    assert st.write("t", rows(spark, [5], "z").withColumn("w", F.lit(1))).count() == 1
