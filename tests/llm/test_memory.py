import os
from pathlib import Path

import pyarrow as pa

from helixframe.llm.common import map_batches


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


class Table:
    """Runs the function that a table would hand to its workers."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_a_worker_gives_back_what_a_task_took(spark):
    last = []

    def make():
        def step(batch):
            held = [bytes(10_000) for _ in range(30_000)]
            last.append(bytes(10_000))  # what stays above keeps the C library from it
            yield {"n": [len(held)]}

        return step

    before = resident()
    run = map_batches(Table(), make, "n long")
    assert [x.column(0).to_pylist() for x in run(iter([pa.RecordBatch.from_pydict({"n": [1]})]))] == [[30_000]]
    assert resident() < before + 100
