"""What the driver's JVM has freed doesn't stay with it."""

import re
from pathlib import Path

import pytest
from veridock.llm.common import release_shuffles


def test_freed_memory_of_the_driver_goes_back(spark):
    jvm = spark._jvm
    rollup = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not rollup.exists():
        pytest.skip("memory can't be read here")

    def held() -> float:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", rollup.read_text()))) / 1024

    # Compressors hold memory outside the heap; the last one stays, so that what the others free lies below it.
    made = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    for deflater in made[:-1]:
        deflater.end()
    jvm.System.gc()
    before = held()
    release_shuffles(spark)
    after = held()
    made[-1].end()
    assert after < before - 50
