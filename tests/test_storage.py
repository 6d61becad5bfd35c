"""Publications, journals, record streams, checkpoints, command line."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerlake import checkpoints, cli, runlog, schema_doc, storage
from ledgerlake.errors import StorageError
from ledgerlake.streaming.record_stream import RecordStream, sink

WHO = {"who": "test"}
SCHEMA = T.StructType([T.StructField("value", T.LongType())])


def test_journal(tmp_path):
    path = tmp_path / "state"
    put = lambda step, expected: storage.replace_journal(path, "f", WHO, {"step": step}, expected)
    assert storage.load_journal(path, "f", WHO) is None
    assert put(1, -1).generation == 0 and put(2, 0).generation == 1
    with pytest.raises(StorageError):
        put(3, 0)
    newest = tmp_path / ".state.generation-1"
    newest.write_bytes(newest.read_bytes()[:-5])
    assert storage.load_journal(path, "f", WHO) == storage.JournalValue(0, {"step": 1})
    with pytest.raises(StorageError):
        storage.load_journal(path, "f", {"who": "other"})


def test_arrays(tmp_path, spark):
    arrays = {"counts": np.arange(4), "scores": np.eye(2, dtype="float32")}
    root = tmp_path / "bundle"
    storage.publish_arrays(root, arrays, WHO)
    assert storage.publish_arrays(root, arrays, WHO).records == {"arrays": 2}
    assert (storage.load_arrays(root, ["counts"])["counts"] == np.arange(4)).all()
    assert {r.name: r.shape for r in storage.arrays_frame(spark, root).collect()} == {"counts": [4], "scores": [2, 2]}
    files = storage.inventory(root)
    assert sorted((r.path, r.size, r.digest) for r in storage.inventory_frame(spark, root).collect()) == [(f.path, f.size, f.digest) for f in files]
    with pytest.raises(StorageError):
        storage.load_arrays(root, ["none"])
    with pytest.raises(StorageError):
        storage.publish_arrays(tmp_path / "x", {"a": np.array([np.nan])}, WHO)
    p = root / "scores.npy"
    p.write_bytes(p.read_bytes()[:-1] + b"\x01")
    with pytest.raises(StorageError, match="differ"):
        storage.load_arrays(root)


def test_publication_recovers(tmp_path, spark):
    root = tmp_path / "p"
    partial = storage.partial_of(root)
    partial.mkdir()
    (partial / "old").write_text("x")
    build = lambda folder: (folder / "new").write_text("y") and {"n": 1}
    manifest = storage.publish_directory(root, "f", WHO, build)
    assert [f.path for f in manifest.files] == ["new"]
    root.rename(partial)
    assert storage.publish_directory(root, "f", WHO, None).digest == manifest.digest
    assert storage.publish_frame(spark.range(5).toDF("value"), tmp_path / "frame", "t", WHO).records == {"rows": 5}
    (root / "link").symlink_to(root / "new")
    with pytest.raises(StorageError):
        storage.verify_directory(root, "f", WHO)


def test_decode():
    assert storage.decode_as(tuple[int | None, ...], [1, None]) == (1, None)
    for kind, value in ((int, True), (str, 1), (tuple[int, int], [1]), (storage.StoredFile, {"path": "a"})):
        with pytest.raises(StorageError):
            storage.decode_as(kind, value)
    for path in ("/a", "../a", "a//b", storage.MANIFEST, ""):
        with pytest.raises(StorageError):
            storage.StoredFile(path, 0, "0" * 64)


def rows(spark, a, b):
    return spark.createDataFrame([(x,) for x in range(a, b)], SCHEMA)


def test_stream(tmp_path, spark):
    def run(name, cuts):
        s = RecordStream(tmp_path / name, "t", WHO, SCHEMA, 10, shard_rows=4)
        w = s.open(spark, "start")
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            w.append(rows(spark, a, b), ["value"])
            w.checkpoint(f"c{k}")
            w.retain(f"c{k}")
            w = s.open(spark, f"c{k}")
        manifest = w.finalize(w.checkpoint_identity)
        assert [r.value for r in s.open(spark, w.checkpoint_identity).frame().orderBy("row_no").collect()] == list(range(10))
        return manifest

    one, two = run("one", [0, 3, 10]), run("two", [0, 5, 6, 10])
    assert one.records == {"rows": 10, "shards": 3}
    assert [spark.read.parquet(str(tmp_path / "one" / f.path)).count() for f in one.files] == [4, 4, 2]
    assert [f.digest for f in one.files] == [f.digest for f in two.files]


def test_stream_rollback(tmp_path, spark):
    s = RecordStream(tmp_path / "s", "t", WHO, SCHEMA, 8)
    w = s.open(spark, "start")
    w.append(rows(spark, 0, 4), ["value"])
    w.checkpoint("a")
    with pytest.raises(StorageError):
        w.checkpoint("b")
    w.retain("a")
    w.append(rows(spark, 4, 8), ["value"])
    w.checkpoint("b")
    assert w.frame("a").count() == 4 and w.committed_rows == 8
    w = s.open(spark, "a")
    assert w.committed_rows == 4
    with pytest.raises(StorageError):
        w.append(rows(spark, 0, 5), ["value"])
    with pytest.raises(StorageError):
        w.append(spark.range(1), ["id"])
    with pytest.raises(StorageError):
        w.finalize("a")


def test_stream_refuses_what_is_not_as_committed(tmp_path, spark):
    s = RecordStream(tmp_path / "s", "t", WHO, SCHEMA, 8)
    w = s.open(spark, "start")
    w.append(rows(spark, 0, 3), ["value"])
    w.append(rows(spark, 3, 5), ["value"])
    assert w.rows == 5 and w.committed_rows == 0
    with pytest.raises(StorageError):
        w.append(rows(spark, 5, 5), ["value"])
    w.checkpoint("a")
    assert [x for b in w.batches("a", 2) for x in b.column("value").to_pylist()] == list(range(5)) and all(b.num_rows <= 2 for b in w.batches("a", 2))
    assert s.open(spark, "a").committed_rows == 5
    part = next(s.pending.glob("segment-000001/part-*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[:-9] + bytes([whole[-9] ^ 1]) + whole[-8:])
    with pytest.raises(StorageError, match="differ"):
        s.open(spark, "a")
    part.write_bytes(whole)
    generation, kept = s.state()
    s.promote(generation, [kept[-1].__class__("z", kept[-1].segments, 9, kept[-1].files)])
    with pytest.raises(StorageError, match="inconsistent"):
        s.open(spark, "z")


def test_sink(tmp_path, spark):
    s = RecordStream(tmp_path / "s", "t", WHO, SCHEMA, 6)
    rows(spark, 0, 3).write.parquet(str(tmp_path / "in"))
    rows(spark, 3, 6).write.mode("append").parquet(str(tmp_path / "in"))
    put = sink(s, spark, ["value"])
    q = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    name = s.state()[1][-1].identity
    put(rows(spark, 0, 3), int(name.split("-")[1]))  # a repeated batch
    assert sorted(r.value for r in s.open(spark, name).frame().collect()) == list(range(6))


def test_checkpoint(tmp_path):
    state = {"w": np.eye(2), "opt": (np.arange(3), None, [np.float32(1)])}
    checkpoints.save_checkpoint(tmp_path / "c", state, np.int64(7))
    step, back = checkpoints.restore_checkpoint(tmp_path / "c", state)
    assert step == 7 and (back["w"] == np.eye(2)).all() and back["opt"][1] is None
    assert checkpoints.restore_checkpoint_state(tmp_path / "c")[0] == 7
    with pytest.raises(StorageError):
        checkpoints.restore_checkpoint(tmp_path / "c", {"w": np.eye(3)})
    with pytest.raises(StorageError):
        checkpoints.save_checkpoint(tmp_path / "d", state, 1.5)


@dataclasses.dataclass
class State:
    step: int
    weights: np.ndarray
    rest: tuple


def test_checkpoint_of_a_typed_state(tmp_path):
    state = State(3, np.eye(2), (State(1, np.zeros(1), ()), {"a": np.arange(2)}))
    checkpoints.save_checkpoint(tmp_path / "c", state, name="run")
    step, back = checkpoints.restore_checkpoint(tmp_path / "c", state, name="run", expected_step=3)
    assert step == 3 and isinstance(back, State) and isinstance(back.rest[0], State) and (back.weights == np.eye(2)).all()
    assert isinstance(checkpoints.restore_checkpoint_state(tmp_path / "c", [State])[1], State)
    for bad in (lambda: checkpoints.restore_checkpoint_state(tmp_path / "c"), lambda: checkpoints.restore_checkpoint(tmp_path / "c", state, expected_step=4), lambda: checkpoints.restore_checkpoint(tmp_path / "c", {"step": 3}), lambda: checkpoints.save_checkpoint(tmp_path / "d", [1])):
        with pytest.raises(StorageError):
            bad()


def test_public_names():
    import ledgerlake

    assert all(getattr(ledgerlake, name) is not None for name in ledgerlake.__all__)
    with pytest.raises(AttributeError):
        ledgerlake.nothing


def test_dialect():
    from ledgerlake.plans.reader import rewrite

    assert rewrite("SELECT * EXCLUDE (a), '* EXCLUDE (' FROM t") == "SELECT * EXCEPT (a), '* EXCLUDE (' FROM t"
    assert rewrite("SELECT a FROM t WHERE b QUALIFY c = 1 LIMIT 3") == "SELECT * EXCEPT (_qualified) FROM (SELECT a, (c = 1) AS _qualified FROM t WHERE b) WHERE _qualified LIMIT 3"


def test_command_line(tmp_path, spark, config, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda args: spark)
    with runlog.init(tmp_path, config) as run:
        run.metric("acc", 0.5, step=1)
    call = lambda *a: (cli.main(["--root", str(tmp_path), *a]), capsys.readouterr().out)
    assert run.rid in call("ls")[1] and run.rid not in call("ls", "--status", "failed")[1]
    assert '"status": "finished"' in call("show", run.rid)[1] and call("show", "none")[0] == 1
    assert "0.5" in call("query", "SELECT value FROM metrics")[1]
    assert call("verify") == (0, "") and "0 blobs" in call("gc")[1]
    assert "nonfinite" in call("schema")[1] and schema_doc.write(tmp_path / "S.md").exists()
    (runlog.run_dir(tmp_path, run.rid) / "run.json").write_text("{")
    assert call("verify")[0] == 1
