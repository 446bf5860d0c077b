from __future__ import annotations

import pytest

from tiercurve.llm import common


class Session:
    """What ``scratch`` asks of a session."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.scratch(Session(spark_master=master))
    assert common.scratch(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///x")) == "hdfs:///x"
    assert common.scratch(Session(spark_master="local[4]")) == common.scratch(Session(spark_master="local"))
