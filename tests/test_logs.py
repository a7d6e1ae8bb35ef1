"""Log lines whatever the cuts, and logs that grow."""

import os

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from shardloom.functions.text_metrics import line_metrics, log_metrics, read_logs
from shardloom.session import fresh_dir
from shardloom.sources.loglines import MANY_TASKS, LogReader, growing_lines, lengths, lines_between, log_lines
from shardloom.sources.storage import locate
from shardloom.streaming.sinks import finish, latest, start, versions

CONTENT = b"one\n\n  two\r\nlonger than a block of seven\n\xff\xfe\nlast"
# The wording of the run logs.
LOG = ("Epoch 1: Processed 10 samples in 4.00s (2.50 images/sec)\nEpoch 2: Processed 12 samples in 3.00s (4.00 images/sec)\n"
       "  Total samples: 22\n  Time to first batch: 1.25s\n")


@pytest.mark.parametrize("block", [1, 7, 64])
@pytest.mark.parametrize("size", [1, 2, 5, 13, 100])
@pytest.mark.parametrize("content", [CONTENT, CONTENT + b"\n", b"", b"\n\n", b"no end"])
def test_every_line_once_for_any_cuts(tmp_path, content, size, block):
    (tmp_path / "log").write_bytes(content)
    found = []
    with pa.OSFile(str(tmp_path / "log")) as source:
        for low in range(0, len(content), size):
            high = min(len(content), low + size)
            found += lines_between(source, low, high, tail=high == len(content), block=block)
    expected, at = [], 0
    for line in content.splitlines(keepends=True) if b"\r" not in content else [p + b"\n" for p in content.split(b"\n")]:
        expected.append((at, line.rstrip(b"\n")))
        at += len(line)
    if content.endswith(b"\n") and b"\r" in content:
        expected.pop()
    assert found == expected


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "deep" / "x.log").write_bytes(CONTENT)
    (tmp_path / "y.log").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"no\n")
    (tmp_path / ".state").write_bytes(b"no\n")
    assert lengths(str(tmp_path)) == {"a/deep/x.log": len(CONTENT), "y.log": 0}
    for size in ("3", "1000"):
        rows = sorted(map(tuple, log_lines(spark, str(tmp_path), bytes_per_task=size).collect()))
        assert rows == [("a/deep/x.log", 0, "one"), ("a/deep/x.log", 4, ""), ("a/deep/x.log", 5, "  two\r"),
                        ("a/deep/x.log", 12, "longer than a block of seven"), ("a/deep/x.log", 41, "��"),
                        ("a/deep/x.log", 44, "last")]
    assert log_lines(spark, str(tmp_path / "absent")).count() == 0


def test_metrics_of_lines_are_those_of_the_text(spark, tmp_path):
    logs = {"all": LOG, "stopped": LOG[:LOG.index("  Total")], "zero": "Total samples: 0\n" + LOG, "none": "out of memory\n",
            "twice": LOG + "Average throughput: 9.5 images/sec\nTotal samples: 7\n" + LOG, "no end": LOG.rstrip("\n")}
    for name, text in logs.items():
        (tmp_path / name).write_text(text)
    whole = {r.file.replace("%20", " "): r[1:] for r in log_metrics(read_logs(spark, str(tmp_path))).collect()}
    lines = {r.file: r[1:] for r in line_metrics(log_lines(spark, str(tmp_path), bytes_per_task="11")).collect()}
    assert lines == whole and lines["twice"] == (9.5, 22, 3.0, 1.25, 4.0, 3.0)


def test_growing_logs(spark):
    logs, out, state = (fresh_dir(spark, label) for label in ("src", "out", "state"))
    base = locate(logs)[1]
    os.makedirs(base)

    def drain():
        metrics = line_metrics(growing_lines(spark, logs, bytes_per_task="9"))
        finish(start(metrics, versions(out), state, "update", available_now=True))
        return {r.file: (r.samples, r.epoch1_s, r.epoch2_s, r.time_to_first_batch) for r in latest(spark, out, ["file"]).collect()}

    def put(name, text):
        with open(f"{base}/{name}", "w") as log:
            log.write(text)

    cut = LOG.index("12 samples")
    put("a", LOG[:cut])
    put("b", LOG)
    assert drain() == {"a": (10, 4.0, 0.0, 0.0), "b": (22, 4.0, 3.0, 1.25)}
    put("a", LOG[:-1])  # the last line has no end yet
    assert drain()["a"] == (22, 4.0, 3.0, 0.0)
    put("a", LOG)
    put("c", "nothing\n")
    assert drain() == {"a": (22, 4.0, 3.0, 1.25), "b": (22, 4.0, 3.0, 1.25), "c": (0, 0.0, 0.0, 0.0)}
    files = {r.file for r in spark.read.parquet(out).filter("version = (select 2)").select("file").collect()}
    assert files == {"a", "c"}  # a batch tells only the files that grew
    put("a", "cut off\n")
    with pytest.raises(PySparkException, match="were read"):
        drain()


def test_lines_are_added_up_before_the_shuffle(spark, tmp_path):
    (tmp_path / "a").write_text(LOG * 100)
    plan = line_metrics(log_lines(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning(file")
    assert "partial_min_by" in plan[shuffle:] and plan.count("Exchange ") == 1
    assert line_metrics(log_lines(spark, str(tmp_path), bytes_per_task="999")).count() == 1


def test_tasks_of_small_cuts_stay_few(tmp_path):
    expected = []
    for name in ("a", "b", "c"):
        text = "".join(f"line {i} of {name}\n" for i in range(1000))
        (tmp_path / name).write_text(text + "no end")
        expected += [(name, line) for line in [*text.splitlines(), "no end"]]
    reader = LogReader({"path": str(tmp_path), "bytes_per_task": "7"})
    tasks = reader.partitions()
    assert len(tasks) <= 2 * MANY_TASKS < sum(lengths(str(tmp_path)).values()) / 7
    assert all(p["high"] - p["low"] > 7 for task in tasks[:-1] for p in task.portions if not p["tail"])
    found = [(row["file"], row["line"]) for task in tasks for batch in reader.read(task) for row in batch.to_pylist()]
    assert found == expected
