"""Published runs: readers see one whole run, whatever happens to a later one."""

import os

import pytest

from vesselflow.sources import publish as P


def _write(spark, value, fail=False):
    def write(folder):
        spark.range(value).write.parquet(f"{folder}/a")
        if fail:
            raise RuntimeError("killed")
        spark.range(10 * value).write.parquet(f"{folder}/b")
    return write


def _counts(spark, out):
    return [t.count() for t in P.read_published(spark, out, "a", "b")]


def test_a_killed_run_leaves_the_old_version(spark, scratch):
    out = os.path.join(scratch, "published")
    with pytest.raises(FileNotFoundError, match="nothing is published"):
        P.current(spark, out)
    with pytest.raises(RuntimeError):
        P.publish(spark, out, _write(spark, 1, fail=True))
    with pytest.raises(FileNotFoundError):
        P.current(spark, out)
    first = P.publish(spark, out, _write(spark, 2))
    assert _counts(spark, out) == [2, 20]
    held = P.read_published(spark, out, "a", "b")
    with pytest.raises(RuntimeError):
        P.publish(spark, out, _write(spark, 3, fail=True))
    assert _counts(spark, out) == [2, 20]
    second = P.publish(spark, out, _write(spark, 4))
    assert _counts(spark, out) == [4, 40] and first < second
    assert [t.count() for t in held] == [2, 20]                # a reader of the old version goes on with it
    assert len(P.stale(spark, out)) == 3 and not any(second in v for v in P.stale(spark, out))
    assert not [f for f in os.listdir(out) if f.startswith("_current.") and not f.endswith(".crc")]


def test_a_switch_that_fails_leaves_the_old_version(spark, scratch, monkeypatch):
    out = os.path.join(scratch, "switch")
    P.publish(spark, out, _write(spark, 2))

    def broken(*_):
        raise OSError("no rename")

    monkeypatch.setattr(P, "_switch", broken)
    with pytest.raises(OSError):
        P.publish(spark, out, _write(spark, 5))
    assert _counts(spark, out) == [2, 20]


def test_a_missing_version_is_named(spark, scratch):
    out = os.path.join(scratch, "gone")
    P.publish(spark, out, _write(spark, 1))
    P._switch(spark, out, "20000101T000000000000-none")
    with pytest.raises(FileNotFoundError, match="20000101T000000000000-none"):
        P.current(spark, out)
