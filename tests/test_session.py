import os
from types import SimpleNamespace

import pytest

from retailloom import session


def fake(master, folder=None, app="app-1"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: folder),
        sparkContext=SimpleNamespace(master=master, applicationId=app),
    )


def test_the_cluster_names_the_folder():
    assert session.shared_dir(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.scratch_path(fake("yarn", "hdfs:///shared/"), "x").startswith(
        "hdfs:///shared/app-1/x-"
    )


def test_a_cluster_without_the_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://host:7077"))


def test_a_local_session_makes_its_own_folder_once():
    folder = session.shared_dir(fake("local[2]"))
    assert os.path.isdir(folder) and session.shared_dir(fake("local[2]")) == folder


def test_stored_intermediates_keep_their_schema(spark):
    frame = spark.range(5).selectExpr("id", "cast(id AS decimal(12,4)) AS p", "id % 2 AS part")
    stored = session.materialise(frame, "x", partition_by=("part",))
    assert stored.schema == frame.schema.__class__(
        [type(f)(f.name, f.dataType, True) for f in frame.schema.fields]
    )
    assert sorted(stored.collect()) == sorted(frame.collect())


def test_a_submitted_program_keeps_what_its_user_has_set(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    assert session.submitted_session().conf.get(name) == "false"
