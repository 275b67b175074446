import os
import threading
from pathlib import Path

from plumbline.sources import scratch
from plumbline.sources.scratch import materialize


def helpers_of(pid, done, found):
    """Collects the processes that ``pid`` starts."""
    old = set(os.listdir("/proc"))
    while not done.is_set():
        now = set(os.listdir("/proc"))
        for new in filter(str.isdigit, now - old):
            try:
                if int(Path(f"/proc/{new}/stat").read_text().rpartition(")")[2].split()[1]) == pid:
                    found.add(new)
            except OSError:
                pass
        old = now


def test_intermediate_tables_start_few_helper_processes(spark):
    """A helper shares its JVM's memory until it runs: two for each task, where files with checksums take five."""
    tasks = 40
    materialize(spark.range(1), "warm")
    done, found = threading.Event(), set()
    watch = threading.Thread(target=helpers_of, args=(spark._jvm.ProcessHandle.current().pid(), done, found))
    watch.start()
    try:
        back = materialize(spark.range(0, 1000, 1, tasks), "helpers")
    finally:
        done.set()
        watch.join()
    assert len(found) <= 2 * tasks + 8
    assert sorted(r["id"] for r in back.collect()) == list(range(1000))
    (folder,) = {Path(f.removeprefix("file://")).parent for f in back.inputFiles()}
    assert len(os.listdir(folder)) == tasks and all(f.endswith(".parquet") for f in os.listdir(folder))


def test_tables_of_one_name_stay_apart_and_every_session_reads_them(spark):
    first, second, none = (materialize(spark.range(n), "same") for n in (3, 5, 0))
    assert (first.count(), second.count(), none.count()) == (3, 5, 0)
    assert spark.newSession().read.parquet(first.inputFiles()[0].rpartition("/")[0]).count() == 3


def test_every_table_gives_freed_native_memory_back(spark, monkeypatch):
    said, trim = [], scratch.trim
    monkeypatch.setattr(scratch, "trim", lambda s: said.append(trim(s)))
    materialize(spark.range(3), "one")
    materialize(spark.range(3), "two")
    assert len(said) == 2 and all(x.startswith("Trim native heap") for x in said)


def test_a_jvm_without_the_command_keeps_its_memory(spark, monkeypatch):
    monkeypatch.setattr(scratch, "COMMAND", "noSuchCommand")
    assert scratch.trim(spark) == ""
    assert materialize(spark.range(3), "kept").count() == 3


def test_a_heap_that_has_grown_is_collected_and_given_back(spark):
    factory = spark._jvm.java.lang.management.ManagementFactory
    heap = lambda: factory.getMemoryMXBean().getHeapMemoryUsage()
    full = lambda: sum(b.getCollectionCount() for b in factory.getGarbageCollectorMXBeans() if "Old" in b.getName())
    most = heap().getMax()
    held = [spark._jvm.java.lang.StringBuilder() for _ in range(10)]
    for x in held:
        x.ensureCapacity(most // 16)
    assert 2 * heap().getCommitted() > most
    before = full()
    materialize(spark.range(3), "grown")
    assert full() > before
    for x in held:
        x.trimToSize()
    assert scratch.shrink(spark)
    assert 2 * heap().getCommitted() < most
    before = full()
    assert materialize(spark.range(3), "small").count() == 3
    assert full() == before
