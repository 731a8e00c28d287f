"""The versioned index: an upsert writes its rows only, a dead one changes nothing, readers see whole snapshots."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from slicewise.sources import versioned_index as vi

SCHEMA = "collection string, chunk_id string, version int, embedding array<float>, chunk_text string"


def rows(spark, *given):
    return spark.createDataFrame([(c, i, v, [1.0] if t != "no vector" else None, t) for c, i, v, t in given], SCHEMA)


def texts(df):
    return sorted((r.collection, r.chunk_id, r.version, r.chunk_text) for r in df.collect())


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/deltas/**/*.parquet", recursive=True)}


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "index")


def test_upsert_writes_only_its_rows(spark, path):
    assert vi.read(spark, path) is None
    assert vi.upsert(spark, path, rows(spark, ("1", "x", 0, "a"), ("1", "y", 0, "b"), ("c2", "x", 0, "c"))).count() == 0
    before = files(path)
    rejected = vi.upsert(spark, path, rows(spark, ("1", "x", 1, "a1"), ("1", "y", -1, "old"), ("c2", "x", 0, "same version"),
                                           ("c2", "z", 0, "no vector"), (None, "q", 0, "t"), ("", "q", 0, "t"), ("c3", None, 0, "t")))
    assert rejected.count() == 4
    after = files(path)
    assert {f: after[f] for f in before} == before                              # nothing was rewritten
    added = spark.read.parquet(*[f for f in after if f not in before])
    assert added.count() == 3
    assert texts(vi.read(spark, path)) == [("1", "x", 1, "a1"), ("1", "y", 0, "b"), ("c2", "x", 0, "same version")]
    assert texts(vi.read(spark, path, 1)) == [("1", "x", 0, "a"), ("1", "y", 0, "b"), ("c2", "x", 0, "c")]


def test_a_killed_upsert_leaves_the_old_snapshot(spark, path, monkeypatch):
    vi.upsert(spark, path, rows(spark, ("c", "x", 0, "a")))
    fail = F.udf(lambda t: 1 / 0, "string")
    with pytest.raises(Exception):                                              # dies while it writes
        vi.upsert(spark, path, rows(spark, ("c", "x", 1, "b")).withColumn("chunk_text", fail("chunk_text")))
    with monkeypatch.context() as m:                                            # dies after writing, before the commit
        m.setattr(vi, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            vi.upsert(spark, path, rows(spark, ("c", "x", 2, "c")))
    assert texts(vi.read(spark, path)) == [("c", "x", 0, "a")]
    left = [d for d in glob.glob(f"{path}/deltas/delta=*") if d.split("=")[1] not in vi.state(spark, path)["deltas"]]
    assert left and vi.vacuum(spark, path) == 0 and vi.vacuum(spark, path, older_than_s=0) == len(left)
    assert texts(vi.read(spark, path)) == [("c", "x", 0, "a")]


def test_clear_compact_and_vacuum(spark, path):
    vi.upsert(spark, path, rows(spark, ("c", "x", 0, "a"), ("d", "x", 0, "b")))
    vi.clear(spark, path, "c")
    assert texts(vi.read(spark, path)) == [("d", "x", 0, "b")]
    vi.upsert(spark, path, rows(spark, ("c", "y", 0, "new"), ("d", "x", 3, "b3")))
    want = [("c", "y", 0, "new"), ("d", "x", 3, "b3")]
    assert texts(vi.read(spark, path)) == want
    n = vi.compact(spark, path)
    assert texts(vi.read(spark, path)) == want and len(vi.state(spark, path)["deltas"]) == 1
    assert vi.compact(spark, path) == n                                         # nothing left to do
    assert "Join" not in vi.read(spark, path)._jdf.queryExecution().executedPlan().toString()
    vi.upsert(spark, path, rows(spark, ("d", "x", 3, "later of equal versions")))
    assert ("d", "x", 3, "later of equal versions") in texts(vi.read(spark, path))
    assert vi.vacuum(spark, path, older_than_s=0) == 2 and vi.snapshots(spark, path) == [5]
    assert len(texts(vi.read(spark, path))) == 2


def test_writers_at_the_same_time(spark, path, monkeypatch):
    """Another upsert commits between this one's read of the snapshot and its commit; both stay. So does one during a compaction."""
    vi.upsert(spark, path, rows(spark, ("c", "x", 0, "a")))
    real, others = vi._publish, [("c", "y", 0, "other"), ("c", "z", 0, "third")]

    def overtaken(spark_, path_, new):
        if others:
            row = others.pop()
            with monkeypatch.context() as m:
                m.setattr(vi, "_publish", real)
                vi.upsert(spark, path, rows(spark, row))
        return real(spark_, path_, new)
    monkeypatch.setattr(vi, "_publish", overtaken)
    vi.upsert(spark, path, rows(spark, ("c", "w", 0, "mine")))
    assert not others and [t[1] for t in texts(vi.read(spark, path))] == ["w", "x", "y", "z"]
    others.append(("c", "x", 1, "during compaction"))
    vi.compact(spark, path)
    assert len(vi.state(spark, path)["deltas"]) == 2
    assert [t[3] for t in texts(vi.read(spark, path))] == ["mine", "during compaction", "other", "third"]


def test_replayed_batches_and_repeated_keys(spark, path):
    for _ in range(2):
        vi.upsert(spark, path, rows(spark, ("c", "x", 0, "a"), ("c", "x", 0, "b"), ("c", "x", None, "z")), batch=("stream", 0))
    vi.upsert(spark, path, rows(spark, ("c", "y", 0, "a")), batch=("other", 0))
    assert len(vi.state(spark, path)["deltas"]) == 2
    assert texts(vi.read(spark, path)) == [("c", "x", 0, "b"), ("c", "y", 0, "a")]


def test_columns(spark, path):
    vi.upsert(spark, path, rows(spark, ("c", "x", 0, "a")).limit(0))
    assert vi.read(spark, path).count() == 0
    vi.upsert(spark, path, rows(spark, ("c", "x", 0, "a")))
    vi.upsert(spark, path, rows(spark, ("c", "y", 0, "b")).withColumn("lang", F.lit("en")))
    assert sorted((r.chunk_id, r.lang) for r in vi.read(spark, path).collect()) == [("x", None), ("y", "en")]
    for bad in (rows(spark, ("c", "x", 0, "a")).withColumn("version", F.lit("1")), rows(spark, ("c", "x", 0, "a")).withColumn("_seq", F.lit(1))):
        with pytest.raises(ValueError):
            vi.upsert(spark, path, bad)
    vi.upsert(spark, path, rows(spark, ("d", "x", 0, "a")))
    only = vi.read(spark, path, collections=["c"])
    assert [r.chunk_id for r in only.orderBy("chunk_id").collect()] == ["x", "y"]
    stack, pruned = [only._jdf.queryExecution().sparkPlan()], []
    while stack:
        node = stack.pop()
        stack += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("Scan parquet"):
            pruned.append("collection" in node.partitionFilters().toString())
    assert len(pruned) == 4 and all(pruned)
