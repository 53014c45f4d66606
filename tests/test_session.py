"""The shared folder and the stage tables."""

import os
import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once
from busloom.plans.stages import forget, staged
from busloom.session import shared_dir

ROOT = str(Path(__file__).resolve().parents[1])


def test_a_cluster_session_must_name_the_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="app-x", master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_a_local_session_needs_no_setting_and_leaves_nothing(tmp_path):
    """In a process of its own, without the folder that this machine's Spark settings name."""
    (tmp_path / "conf").mkdir()
    (tmp_path / "tmp").mkdir()
    code = (
        "from busloom.session import local_session, shared_dir; from busloom.functions.reuse import written_once; s = local_session(2);"
        "assert s.conf.get('spark.checkpoint.dir', None) is None; print('rows', written_once(s.range(7)).count()); print('in', shared_dir(s)); s.stop()")
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path / "tmp"), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180)
    assert "rows 7" in out.stdout, out.stderr[-2000:]
    folder = out.stdout.split("in ")[1].split()[0]
    assert folder.startswith(str(tmp_path / "tmp"))
    for _ in range(40):  # the JVM ends a moment after the process that started it
        if not Path(folder).exists():
            return
        time.sleep(0.25)
    raise AssertionError("the folder is still there")


def test_written_once_reads_back_the_same(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    back = written_once(df)
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert shared_dir(spark) in back.inputFiles()[0]


def test_stages_follow_their_input(spark, tmp_path):
    built = []

    @staged
    def total(s, folder):
        built.append(1)
        return s.read.parquet(f"{folder}/t.parquet").agg(F.sum("id").alias("n"))

    folder = str(tmp_path)
    spark.range(4).write.parquet(f"{folder}/t.parquet")
    assert [total(spark, folder).first().n for _ in range(2)] == [6, 6] and len(built) == 1
    spark.range(10, 11).write.mode("append").parquet(f"{folder}/t.parquet")
    assert total(spark, folder).first().n == 16 and len(built) == 2
    forget()
    assert total(spark, folder).first().n == 16 and len(built) == 3
