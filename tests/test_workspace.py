import os
from types import SimpleNamespace

import pytest

from local_session import name_folder
from tilerank.sources import checkpoint_folder, scratch_path, stored, workspace


def _session(setting=None, folder=None, master="local[2]"):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context.folder)
    context.folder = folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", path)
    conf = SimpleNamespace(get=lambda key, default=None: setting or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_named_folder_is_used():
    assert checkpoint_folder(_session("hdfs://shared/x")) == "hdfs://shared/x"
    assert checkpoint_folder(_session(folder="s3a://b/c", master="yarn")) == "s3a://b/c"


@pytest.mark.parametrize("master", ["yarn", "local[2]"])
def test_a_session_must_name_a_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_folder(_session(master=master))


def test_a_trial_gets_one_folder_and_a_cluster_none():
    session = _session()
    name_folder(session)
    folder = checkpoint_folder(session)
    name_folder(session)
    assert folder and checkpoint_folder(session) == folder
    for master in ("yarn", "local-cluster[2,1,1024]"):
        session = _session(master=master)
        name_folder(session)
        assert session.sparkContext.folder is None


def test_a_workspace_takes_its_tables_with_it(spark):
    with workspace(spark) as folder:
        kept = stored(spark.range(5), "numbers")
        assert kept.count() == 5
        assert folder in kept.inputFiles()[0]
    where = folder.removeprefix("file:")
    assert not os.path.exists(where)
    assert not scratch_path(spark, "a").startswith(folder)


def test_stored_tables_keep_rows_and_do_not_collide(spark):
    df = spark.range(10)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    one, other = stored(df, "numbers"), stored(df.where("id > 7"), "numbers")
    assert (one.count(), other.count()) == (10, 2)
    assert one.schema.simpleString() == df.schema.simpleString()
