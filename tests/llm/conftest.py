import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from consensa.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return s
