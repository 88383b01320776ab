"""What the operators leave in the driver."""

import time
import tracemalloc

import numpy as np

from parchmint.llm import common, quality
from parchmint.llm.components import components


def test_an_operator_that_begins_lets_spent_plans_go(spark, monkeypatch):
    monkeypatch.setattr(common, "USED", 0.0)
    jvm = spark.sparkContext._jvm
    spent = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    for _ in range(50):  # Python tells the JVM a little later that it has let go
        common.scratch(spark, "test")
        if spent.get() is None:
            return
        time.sleep(0.1)
    raise AssertionError("still held")


def test_native_memory_is_asked_for(spark):
    assert "rim" in common.commanded(spark, "systemTrimNativeHeap")
    assert common.commanded(spark, "noSuchCommand") is None


def test_components_need_no_job_to_see_that_they_are_settled(spark, monkeypatch):
    looked = []
    kind = type(spark.range(0))
    monkeypatch.setattr(kind, "isEmpty", lambda self, was=kind.isEmpty: looked.append(self) or was(self))
    labels = components(spark.createDataFrame([(k, k + 1) for k in range(5)], "a long, b long"))
    assert {(r.v, r.root) for r in labels.collect()} == {(k, 0) for k in range(6)}
    assert not looked


def test_quality_is_fitted_in_little_more_than_its_sample():
    rng = np.random.default_rng(1)
    rows = rng.random((2 * quality.SAMPLE, quality.TERMS), dtype=np.float32)
    labels = (np.arange(len(rows)) % 2).astype(np.int64)
    tracemalloc.start()
    model = quality.fitted(rows, labels, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(model.vectors, model.latent(rows), rtol=0, atol=1e-12)
    assert peak < 2.8 * rows.nbytes, peak / rows.nbytes
