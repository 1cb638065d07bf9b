"""The job is killed in the middle of its work and started again."""

import json
import os
import random
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest
from conftest import land, trip

from tripflow.sinks import JdbcSink, ParquetSink
from tripflow.sources import JdbcTable

FILES, ROWS = 8, 300
ROOT = Path(__file__).resolve().parent.parent
DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def start(root, env):
    command = [sys.executable, "-m", "tripflow", "--config", str(root / "job.json")]
    env = os.environ | env | {"PYTHONPATH": str(ROOT)}
    with open(root / "log", "a") as log:
        return subprocess.Popen(command, cwd=root, env=env, stdout=log, stderr=log)


def children(process):
    listed = subprocess.run(["ps", "--ppid", str(process.pid), "-o", "pid="], capture_output=True, text=True)
    return [int(pid) for pid in listed.stdout.split()]


def kill(process):
    """The JVM first, so that it gets no chance to tidy up."""
    jvm = children(process)
    for pid in (*jvm, process.pid):
        try:
            os.kill(pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
    gone(process, jvm)


def gone(process, jvm):
    """Wait for the process and its JVM, which closes the database last."""
    code = process.wait(120)
    wait_for(lambda: not any(Path(f"/proc/{pid}").exists() for pid in jvm))
    return code


def wait_for(condition):
    end = time.monotonic() + 120
    while not condition():
        assert time.monotonic() < end
        time.sleep(0.01)


@pytest.fixture(params=["parquet", "jdbc"])
def job(request, tmp_path):
    settings = {
        "input.csv.path": str(tmp_path / "in"),
        "checkpoint.dir": str(tmp_path / "checkpoint"),
        "spark.master": "local[2]",
        "spark.ui.enabled": "false",
    }
    if request.param == "parquet":
        env, sink = {}, ParquetSink(str(tmp_path / "out"))
        settings["parquet.path"] = sink.path
    else:
        url = f"jdbc:derby:{tmp_path}/db"
        env = {"DB_URL": f"{url};create=true", "DB_DRIVER": DRIVER}
        settings["db.table"] = "trips"
        sink = JdbcSink(JdbcTable(url, "trips", DRIVER))
    (tmp_path / "job.json").write_text(json.dumps(settings))
    for file in range(FILES):
        land(tmp_path / "in" / f"{file}.csv", *(trip(pickup_longitude=f"{file}-{row}") for row in range(ROWS)))
    return tmp_path, env, sink


def committed(root):
    return sum(not path.name.startswith(".") for path in (root / "checkpoint" / "commits").glob("*"))


def test_killed_job_loses_and_repeats_nothing(spark, job):
    root, env, sink = job
    first = start(root, env)
    wait_for(lambda: committed(root) >= 3 or first.poll() is not None)
    time.sleep(random.random() / 2)
    kill(first)
    last, jvm = start(root, env), set()

    def ended():
        # The JVM outlives the process by a little, and then is nobody's child.
        jvm.update(children(last))
        return last.poll() is not None

    wait_for(ended)
    assert gone(last, jvm) == 0, (root / "log").read_text()[-2000:]
    stored = [(r.Id, r.pickup_longitude) for r in sink.read(spark).collect()]
    everything = sorted(f"{file}-{row}" for file in range(FILES) for row in range(ROWS))
    assert sorted(name for _, name in stored) == everything, (root / "log").read_text()[-4000:]
    # A kill after a file was admitted and before its batch was noted puts it together with the next one.
    batches = sorted({(name.split("-")[0], batch) for batch, name in stored})
    assert len(batches) == FILES and [batch for _, batch in batches] == sorted(batch for _, batch in batches)
    assert len({batch for _, batch in batches}) >= FILES - 1
