"""What the pipeline's stages hold in the workers of an executor."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark import SparkContext

from marlstone.llm import common, decontaminate, lang_id, simhash
from marlstone.llm.sharding import shard_documents

from .conftest import rows


def texts(n, size=1000):
    rng = np.random.default_rng(n)
    found = [" ".join(f"w{x}" for x in rng.integers(50, size=size // 4)) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(found, pa.string())], names=["doc_id", "text"])


def test_no_kernel_feeds_another_one_in_its_task(documents, monkeypatch):
    plans = []
    components = simhash.components

    def noted(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    monkeypatch.setattr(simhash, "components", noted)
    assert 0 < simhash.drop_near_duplicates(documents).count() < documents.count()
    between = [x for p in plans for x in p.split("MapInArrow")[1:-1]]
    # an exchange that a join asks for goes where the join becomes a broadcast at run time
    assert between and all("REPARTITION_BY_NUM" in x for x in between)


def test_the_drivers_rows_do_not_pass_through_workers(spark, documents, monkeypatch):
    def refuse(*given, **named):
        raise AssertionError("rows of the driver went to Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    assert 0 < lang_id.keep_identified(documents).count() <= documents.count() == shard_documents(documents).count()


def test_rows_of_the_driver(spark):
    kind = "known string, below double"
    assert rows(common.local(spark, [("é", 1.5), (None, 2.0)], kind)) == [("é", 1.5), (None, 2.0)]
    assert rows(common.local(spark, [], kind)) == [] and common.local(spark, [], kind).columns == ["known", "below"]


def test_long_batches_are_taken_up_in_portions(monkeypatch):
    batch, item = texts(400), [(1, b"one two three four five six seven eight nine")]
    labels, profiles = ["x"], np.ones((1, lang_id.DIM)) / np.sqrt(lang_id.DIM)
    for kernel in (simhash._sets(5), simhash._sketches(5, 64), decontaminate._clean(item), lang_id._reject(labels, profiles)):
        monkeypatch.setattr(common, "PORTION", 4 << 20)
        whole = pa.Table.from_batches(list(kernel([batch])))
        monkeypatch.setattr(common, "PORTION", 50_000)
        parts = list(kernel([batch]))
        assert len(parts) > 5 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
    cut = list(common.portions([batch]))
    assert max(x.nbytes for x in cut) < 60_000 and pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
    assert [x.num_rows for x in common.portions([batch.slice(0, 0)])] == [0]


def test_keys_of_many_tables_are_made_in_parts():
    n, tables = 6000, simhash.sampled_tables(1024, 24, 235)
    fps = np.random.default_rng(3).integers(256, size=(n, 128), dtype=np.uint8)
    columns = [np.arange(n), np.arange(n), [x.tobytes() for x in fps]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["id", "c", "fp"])
    tracemalloc.start()
    total = 0
    for out in simhash._keys(tables)([batch]):
        total += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == n * 235 and peak < 20e6
    last = {(r["id"], r["key"] >> 40): r["key"] & (1 << 40) - 1 for r in out.to_pylist()}
    bits = np.unpackbits(fps[-1], bitorder="little")
    assert [last[n - 1, t] for t in range(235)] == [sum(int(bits[p]) << k for k, p in enumerate(x)) for t, x in enumerate(tables)]
