from types import SimpleNamespace

import pytest

from sightline import session


def _session(conf: dict, master: str, checkpoint: str | None = None, app: str = "a"):
    context = SimpleNamespace(applicationId=app, master=master, getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d)), sparkContext=context)


def test_shared_folder():
    assert session.shared_dir(_session({"spark.checkpoint.dir": "file:///shared"}, "yarn")) == "file:///shared"
    assert session.shared_dir(_session({}, "yarn", "hdfs:///points")) == "hdfs:///points"
    first = session.shared_dir(_session({}, "local[2]"))
    assert first.startswith("file:///") and session.shared_dir(_session({}, "local[2]")) == first
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(_session({}, master, app="b"))


def test_written_tables_are_released(spark):
    kept = session.materialize(spark.range(5), "kept")
    gone = session.materialize(spark.range(7), "gone")
    assert kept.count() == 5 and gone.count() == 7
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone.inputFiles()[0])
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(path)
    session.release(gone, gone)
    assert not fs.exists(path) and kept.count() == 5
