import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twinscript.session import build_session, drop_stages, open_stages  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": str(shared)},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_stages(session)
    assert not open_stages() and not list(shared.glob("twinscript/*"))
    session.stop()


@pytest.fixture(autouse=True)
def no_stage_is_left(request):
    """Whatever a test staged goes when it is done."""
    yield
    if "spark" in request.fixturenames:
        drop_stages(request.getfixturevalue("spark"))


@pytest.fixture
def values(spark):
    """Evaluate column functions on literal rows: ``values(rows, ddl, lambda c: ...)``."""
    from pyspark.sql import functions as F

    def run(rows, ddl, expression):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {ddl}")
        return [r[0] for r in df.orderBy("_i").select(expression(F.col).alias("v")).collect()]

    return run
