from __future__ import annotations

import pytest

from feedloom import session


def test_stage_tables_live_in_the_shared_folder(spark):
    staged = session.stage(spark.range(5), "probe")
    folder = session._stage_folder(spark)
    assert folder.startswith(session.scratch_folder(spark)) and staged.count() == 5
    assert all(folder in path for path in staged.inputFiles())


def test_drop_stages_removes_only_this_application(spark):
    session.stage(spark.range(5), "probe")
    folder = session._stage_folder(spark)
    assert session.path_exists(spark, folder)
    session.drop_stages(spark)
    assert not session.path_exists(spark, folder) and session.path_exists(spark, session.scratch_folder(spark))


class _Cluster:
    """A session on a cluster without a checkpoint folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)


def test_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_folder(_Cluster)


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(100, numPartitions=16)
    assert session.spread(wide, "id") is wide
    assert session.spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == 4
