"""What a job cost: the figures that Spark keeps of its stages."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The names of a stage's figures in Spark's status store, and whether they add up.
FIGURES = {"executorRunTime": True, "executorCpuTime": True, "jvmGcTime": True, "resultSize": True, "inputBytes": True, "outputBytes": True, "shuffleReadBytes": True, "shuffleWriteBytes": True, "memoryBytesSpilled": True, "diskBytesSpilled": True, "peakExecutionMemory": False}


class JobMetrics:
    """Sums (of peaks: the largest) over the stages that ended within a ``measured`` block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.values = spark, dict.fromkeys(("stages", "tasks", *FIGURES), 0)

    def _stages(self) -> dict[tuple[int, int], object]:
        sc = self.spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()  # figures arrive after a job's end
        jvm = sc._jvm
        found = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s for s in (found.apply(i) for i in range(found.size())) if s.status().toString() in ("COMPLETE", "FAILED")}

    def frame(self) -> DataFrame:
        """(metric, value): times in ms, but for executorCpuTime in ns, and sizes in bytes."""
        return self.spark.createDataFrame([(k, int(v)) for k, v in self.values.items()], "metric string, value long")


@contextmanager
def measured(spark: SparkSession) -> Iterator[JobMetrics]:
    """The figures of the jobs that run in the block, this session's or not.

    The store keeps ``spark.ui.retainedStages`` stages, so a block with more is told too low.
    """
    out = JobMetrics(spark)
    before = set(out._stages())
    yield out
    for key, stage in out._stages().items():
        if key in before:
            continue
        out.values["stages"] += 1
        out.values["tasks"] += stage.numCompleteTasks() + stage.numFailedTasks()
        for name, adds in FIGURES.items():
            value = getattr(stage, name)()
            out.values[name] = out.values[name] + value if adds else max(out.values[name], value)
