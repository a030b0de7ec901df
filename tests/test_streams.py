"""Streams as streams: polling with timers, retries and quiet times; replayed batches; logs read once."""

import time

import pytest

from graphmill.streaming import poller as P


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    return root


def put(root, name, text, age=0):
    import os

    (root / name).write_text(text)
    t = time.time() - 1000 + age
    os.utime(root / name, (t, t))


def test_poller_changes_retries_deletions_and_quiet_time(spark, tree, tmp_path):
    import hashlib

    calls, fail, now, rebuilt = [], [], [1000.0], []

    def update(paths):
        calls.append(sorted(r.path for r in paths.collect()))
        if fail:
            raise OSError(fail.pop())

    def rebuild():
        rebuilt.append(1)
        if len(rebuilt) == 1:
            raise OSError("no")

    known = lambda: spark.createDataFrame([("same.py", hashlib.sha256(b"s").hexdigest()), ("other.py", "0"), ("gone.py", "1")], "path string, last_hash string")
    make = lambda: P.Poller(spark, f"file://{tmp_path}/poller", update, rebuild, quiet_ms=5000, absent_ms=25_000, known=known, clock=lambda: now[0])
    for name in ("same.py", "other.py", "new.py"):
        put(tree, name, name[0])
    fail.append("first update")
    make().poll(str(tree))  # compared by hash with what the index has
    assert calls == [["new.py", "other.py"]]
    put(tree, "same.py", "s2", 5)
    make().poll(str(tree))  # another poller, as after a restart: what failed comes again
    assert calls[1:] == [["new.py", "other.py", "same.py"]]
    p = make()
    p.poll(str(tree))
    assert len(calls) == 2 and not rebuilt
    now[0] += 6
    assert not p.rest() and rebuilt == [1]  # the rebuild fails, and waits
    now[0] += 1
    assert not p.rest() and rebuilt == [1]
    now[0] += 6
    assert make().rest() and rebuilt == [1, 1] and not p.rest()
    (tree / "new.py").unlink()
    deadline = time.time() + 90
    while sum(len(c) for c in calls[2:]) < 2 and time.time() < deadline:
        time.sleep(3)
        p.poll(str(tree))
    gone = sorted(x for c in calls[2:] for x in c)
    assert gone == ["gone.py", "new.py"]
    batch = p.state()["batch"]
    p.step(spark.createDataFrame([("again.py", "created")], P.CHANGES), batch)  # delivered again
    assert sorted(x for c in calls[2:] for x in c) == gone


def log_of(*numbers):
    return "".join(f"COMMIT_SEP\n{n:040d}\nA{n}\na@x\n{n}\n{n - 1:040d}\nmessage {n}\n\n{n}\t-\tsrc/{n}.py\n" for n in numbers)


def test_a_growing_git_log_is_read_once(spark, tmp_path):
    from graphmill.sources.gitlog import GitLogSource

    spark.dataSource.register(GitLogSource)
    log, seen = tmp_path / "log.txt", []

    def run():
        stream = spark.readStream.format("git_log").option("path", str(log)).option("commits", 2).load()
        q = stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted((r.timestamp, r.files[0].file_path, r.files[0].insertions, r.files[0].deletions) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(90) and q.exception() is None
        out = sorted(x[0] for s in seen for x in s)
        seen.clear()
        return out

    log.write_text(log_of(5, 4, 3, 2, 1))
    assert run() == [1, 2, 3, 4, 5]
    assert run() == []
    log.write_text(log_of(7, 6, 5, 4, 3, 2, 1))
    assert run() == [6, 7]
    log.write_text(log_of(9, 8))  # history was rewritten
    assert run() == [8, 9]
    batch = spark.read.format("git_log").option("path", str(log)).option("after", f"{8:040d}").load()
    assert [(r.sha, r.message) for r in batch.collect()] == [(f"{9:040d}", "message 9")]


def test_refresh_builds_updates_and_repeats_after_crashes(spark, tree, tmp_path, monkeypatch):
    from graphmill.plans import build as B
    from graphmill.storage import Index
    from graphmill.streaming import changes as X

    index = Index(spark, str(tmp_path / "index"))
    for name, text in (("a.c", '#include "a.h"\n'), ("a.h", "int f();\n"), ("b.py", "x = 1\n")):
        put(tree, name, text)
    refresh = lambda: B.refresh_sources(index, str(tree), "main", clock=lambda: 50)
    assert refresh() == {"mode": "build", "changed": 3, "status": "success"}
    assert refresh() == {"mode": "none", "changed": 0}
    put(tree, "a.c", '#include "c.h"\n#include "a.h"\n', 5)
    put(tree, "c.h", "int g();\n", 5)
    (tree / "b.py").unlink()
    old = {r.path: r.id for r in X.visible(index).collect()}
    ids = []
    for owner, name in ((Index, "mark_dirty"), (Index, "_save")):
        with monkeypatch.context() as m:
            m.setattr(owner, name, lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                refresh()
        assert {r.path: r.id for r in X.visible(index).collect()} == old
        assert index.raw("files").where("layer = 'overlay'").count() == 0
        ids.append({r.path: r.id for r in spark.read.parquet(f"{index.root}/tables/files/layer=overlay/generation=1").collect()})
    assert refresh() == {"mode": "update", "changed": 3}
    new = {r.path: r.id for r in X.visible(index).collect()}
    assert set(new) == {"a.c", "a.h", "c.h"} and new["a.h"] == old["a.h"]
    assert ids[0] == ids[1] == {k: new[k] for k in ("a.c", "c.h")}
    got = {r.raw_import: r.resolved_id for r in index.raw("file_imports").where("layer = 'overlay'").collect()}
    assert got == {"c.h": new["c.h"], "a.h": old["a.h"]}
    assert refresh() == {"mode": "none", "changed": 0}


def test_a_batch_of_a_stream_is_applied_once(spark, tmp_path):
    from graphmill.storage import Index
    from graphmill.streaming import changes as X

    index = Index(spark, str(tmp_path / "index"))
    batch = spark.createDataFrame([("n.py", "python", "n", False, 1)], X.CHANGE)
    assert X.update_overlay(index, batch, "main", 1, stream=("s", 0)) == 1
    other = spark.createDataFrame([("n.py", "python", "other", False, 2)], X.CHANGE)
    assert X.update_overlay(index, other, "main", 1, stream=("s", 0)) == 0
    assert X.update_overlay(index, other, "main", 1, stream=("s", 1)) == 1
    assert [r.source for r in X.visible(index).collect()] == ["other"]
