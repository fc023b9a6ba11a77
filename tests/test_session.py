import types

import pytest

from tianguis.session import cluster_settings, shared_dir


def test_cluster_settings_scale_with_the_biggest_shuffle():
    big = cluster_settings(30 * 10**12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == -(-30 * 10**12 // (256 << 20))
    small = cluster_settings(10 << 20, 64)
    assert int(small["spark.sql.shuffle.partitions"]) == 128          # two waves of all cores
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


@pytest.mark.parametrize("master, fails", [("local[4]", False), ("local", False), ("yarn", True), ("spark://h:7077", True),
                                           ("local-cluster[3,2,1000]", True)])
def test_no_machine_local_folder_on_a_cluster(master, fails):
    found = []
    sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=found.append)
    spark = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda key, default: default))
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(spark)
    else:
        assert [shared_dir(spark)] == found
