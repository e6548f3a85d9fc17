"""Commits by several writers at once: nothing twice, nothing lost, nothing half visible."""

import threading

import pytest
from pyspark.sql import functions as F

from menuloom.operators import review
from menuloom.sources import commits, versions


def at_once(*calls):
    """Run the calls in threads; their results or exceptions, in order."""
    out = [None] * len(calls)

    def run(i, call):
        try:
            out[i] = call()
        except Exception as e:  # noqa: BLE001
            out[i] = e

    threads = [threading.Thread(target=run, args=(i, c)) for i, c in enumerate(calls)]
    [t.start() for t in threads]
    [t.join(300) for t in threads]
    return out


@pytest.fixture
def racing(monkeypatch):
    """Hold each thread's first claim until all writers have one, so that all but one lose."""
    def race(writers):
        barrier, local, real = threading.Barrier(writers, timeout=120), threading.local(), commits.claim

        def claim(*args):
            if threading.current_thread() is not threading.main_thread() and not getattr(local, "waited", False):
                local.waited = True
                barrier.wait()
            return real(*args)

        monkeypatch.setattr(commits, "claim", claim)
        monkeypatch.setattr(versions, "claim", claim)

    return race


def batch(spark, threads, writer):
    rows = [(t, pos, f"{writer}-{i}") for i, (t, pos) in enumerate(threads)]
    return spark.createDataFrame(rows, "thread_id string, pos long, id string")


def test_two_writers_stage_each_thread_once(spark, tmp_path, racing):
    root = str(tmp_path / "staged")
    assert review.staged_changes(spark, root) is None
    assert review.stage(spark, root, batch(spark, [("old", 0)], "x")) == 1
    racing(3)
    names = ["old", *"abcdefgh", None]
    mine = batch(spark, [(n, 0) for n in names[:6]] + [("a", 1)], "w1")
    other = batch(spark, [(n, 0) for n in names[3:]], "w2")
    third = batch(spark, [(n, 0) for n in names[1:4]], "w3")
    got = at_once(*[lambda b=b: review.stage(spark, root, b) for b in (mine, other, third)])
    assert not [g for g in got if isinstance(g, Exception)], got
    staged = review.staged_changes(spark, root).collect()
    assert sorted(str(r.thread_id) for r in staged) == sorted(map(str, names))
    numbers = [r.version for r in commits.log_entries(spark, root).collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))
    assert review.stage(spark, root, mine) is None and review.staged_changes(spark, root).count() == len(names)


def test_a_failed_writer_leaves_nothing_to_read(spark, tmp_path):
    root = str(tmp_path / "staged")
    review.stage(spark, root, batch(spark, [("a", 0)], "w"))
    # Written, never claimed.
    batch(spark, [("lost", 0)], "w").write.parquet(f"{root}/data/folder={commits.new_folder()}")
    assert [r.thread_id for r in review.staged_changes(spark, root).collect()] == ["a"]
    assert review.stage(spark, root, batch(spark, [("lost", 0)], "v")) == 2
    assert review.staged_changes(spark, root).filter("thread_id = 'lost'").count() == 1


def test_claims_are_exclusive(spark, tmp_path):
    root = str(tmp_path / "log")
    won = at_once(*[lambda n=n: commits.claim(spark, root, 1, f"w-{n}") for n in range(8)])
    assert sorted(won) == [False] * 7 + [True]
    entry = commits.log_entries(spark, root).first()
    assert (entry.version, entry.folder) == (1, f"w-{won.index(True)}")


def test_one_of_two_publishers_wins(spark, tmp_path, racing):
    root = str(tmp_path / "catalog")
    versions.publish(spark, root, {"dishes": spark.range(3)}, base=0)
    racing(2)
    got = at_once(*[lambda n=n: versions.publish(spark, root, {"dishes": spark.range(n)}, base=1) for n in (10, 20)])
    lost = [g for g in got if isinstance(g, commits.CommitConflict)]
    assert len(lost) == 1 and [g for g in got if g == 2]
    assert versions.read_version(spark, root, "dishes").count() == (10, 20)[got.index(2)]
    with pytest.raises(commits.CommitConflict):
        versions.publish(spark, root, {"dishes": spark.range(1)}, base=1)
    assert versions.publish(spark, root, {"dishes": spark.range(5)}) == 3
    assert versions.read_version(spark, root, "dishes", 1).agg(F.count("*")).first()[0] == 3
