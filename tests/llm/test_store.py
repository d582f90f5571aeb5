import re
from pathlib import Path

import pyarrow as pa
import pytest
from opalgrid.llm import store


class Cluster:
    """A session of a cluster without the setting."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "yarn"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match=r"spark.checkpoint.dir"):
        store.shared_dir(Cluster)


def test_tables_are_kept_and_removed(spark):
    kept = store.materialize(spark.range(10), "t")
    (place,) = {str(Path(f.removeprefix("file:")).parent) for f in kept.inputFiles()}
    assert place.startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) and kept.count() == 10
    assert store.materialize(spark.range(0), "t").columns == ["id"]
    store.clean()
    assert not Path(place).exists()


def test_tables_on_the_way_are_removed(spark):
    made = []

    def make():
        for i in range(3):
            frame = store.materialize(spark.range(i), "step")
            made.append(store._made[-1][1])
        return frame.selectExpr("id + 1 as id")

    earlier = store.materialize(spark.range(4), "t")
    out = store.finished(spark, make, "t")
    assert sorted(r.id for r in out.collect()) == [1, 2] and earlier.count() == 4
    assert len(made) == 3 and not any(Path(p.removeprefix("file:")).exists() for p in made)


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    batches = [pa.record_batch({"a": [i]}) for i in range(3)]
    calls = []
    monkeypatch.setattr(store, "give_back", lambda: calls.append(len(calls)))
    run = store.tidy(lambda given: (b for b in given))
    assert list(run(iter(batches))) == batches and calls == [0]
    ended = run(iter(batches))
    next(ended)
    ended.close()
    assert calls == [0, 1]


def test_freed_memory_is_given_back():
    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    blocks = [bytes(2000) for _ in range(50_000)]
    last = bytes(2000)  # above the others, so that the heap can't shrink by itself
    full = held()
    del blocks
    store.give_back()
    assert full - held() > 50 and len(last) == 2000
