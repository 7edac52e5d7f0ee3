import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelmill.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("panelmill-tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def loans(spark):
    """What a tool library lent: six loans of three tools, dates as text."""
    rows = [("Saw", "2021-05-03", 7, "North"), ("Drill", "2021-05-03", 2, "South"), ("Saw", "2021-06-20", 12, "South"),
            ("Ladder", "2021-04-18", 5, "South"), ("Drill", "2021-05-09", 30, "North"), ("Saw", "2021-06-20", 1, "North")]
    return spark.createDataFrame(rows, "tool string, lent string, days long, branch string")


@pytest.fixture(scope="session")
def gaps(spark):
    """Null keys, null values, one group without any value, NaN."""
    rows = [("a", 1.0, 1), ("a", 3.0, 2), ("a", None, 3), ("b", None, 4), ("b", float("nan"), 5), (None, 7.0, 6), ("c", -2.0, 7)]
    return spark.createDataFrame(rows, "k string, v double, i long")
