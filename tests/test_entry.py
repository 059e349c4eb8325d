"""The driver's entry: core queries stay when the training-data subpackage cannot be imported; where shared files go."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from docweave import shared
from docweave.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_core_queries_without_a_dependency_of_the_subpackage():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert got == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]


def test_no_machine_local_folder_on_a_cluster():
    empty = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared.base_folder(SimpleNamespace(sparkContext=sc))
    sc.master = "local-cluster[3,2,3000]"
    with pytest.raises(RuntimeError):
        shared.base_folder(SimpleNamespace(sparkContext=sc))


def test_shared_folders_stand_beside_the_checkpoints(spark):
    folder = shared.shared_folder(spark, "x")
    assert folder.startswith(spark.sparkContext._jsc.sc().getCheckpointDir().get()) and folder != shared.shared_folder(spark, "x")
