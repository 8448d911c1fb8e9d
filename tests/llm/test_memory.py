"""What a Python worker keeps after its task."""

import re
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa

from tickloom.llm.common import by_batch


def _used() -> int:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024


def test_tasks_give_memory_back():
    seen, last = [], []

    def takes(batch):
        held = [(b"%d" % k).ljust(1500, b"x") for k in range(200_000)]  # about 300 MB
        last.append(held[-1])  # holds the end of the heap, so that what is free lies below it
        seen.append(_used())
        yield batch

    task = by_batch(SimpleNamespace(mapInArrow=lambda each, schema: each), takes, "k long")
    before = _used()
    rows = list(task(iter([pa.record_batch({"k": [1, 2]})])))
    assert rows[0].num_rows == 2
    assert seen[0] > before + 250 and _used() < before + 50, (before, seen, _used())
