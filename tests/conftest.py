import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpuslab.plans import skew
from corpuslab.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("corpuslab-tests", memory="8g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="module", autouse=True)
def interpreted(request, spark):
    """Tables of a few rows: compiling plans would take most of the time. The oracle tests compile."""
    tiny = "test_oracle" not in request.module.__name__
    spark.conf.set("spark.sql.codegen.wholeStage", str(not tiny).lower())
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN" if tiny else "FALLBACK")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def large(monkeypatch):
    """Treat every key as hot and nothing as small, so that the paths for large data run."""
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 1)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
