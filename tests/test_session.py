import pytest

from funnelkit.session import checkpoint_dir


def test_checkpoint_dir_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured                                   # set by the cluster, or by the tests
    assert checkpoint_dir(spark) == configured
    assert spark.conf.get("spark.checkpoint.dir") == configured   # never overridden once set
    assert configured in spark.sparkContext.getCheckpointDir()


class _Unset:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.conf = {"spark.sql.warehouse.dir": "/shared/warehouse"}
        self.sparkContext = self
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_an_unset_folder_is_an_error_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(ValueError):
            checkpoint_dir(_Unset(master))


def test_a_local_session_takes_its_warehouse():
    own = _Unset("local[4]")
    assert checkpoint_dir(own) == own.folder == "/shared/warehouse/_checkpoints"
