import pytest

from tests.check import make_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from factloom.session import tune

    session = make_spark(cpus=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return tune(session)
