import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tunekit.sources.session import local_session

    session = local_session("8", app="tunekit-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def wide(spark, sf_dir):
    from tunekit.catalog.views import train_wide

    df = train_wide(spark, sf_dir).persist()
    df.count()
    return df


@pytest.fixture(scope="session")
def log(spark, sf_dir):
    from tunekit.catalog.views import trials

    df = trials(spark, sf_dir).persist()
    df.count()
    return df
