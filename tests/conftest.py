import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from relfeat.session import local_session
    s = local_session(8, shuffle_partitions=8, app="relfeat-tests")
    yield s


@pytest.fixture(scope="session")
def shop(spark):
    """Customers and orders of the smallest test tables as a database."""
    from relfeat.sources.testdb import load_test_db
    return load_test_db(spark, SF, tables=("customer", "orders"))


@pytest.fixture(scope="session")
def segment_task(spark):
    """(train, test): is a customer's next quarter free of orders; 1,200 rows before 1999 and 150
    rows at one later cutoff."""
    from pyspark.sql import functions as F

    from relfeat.sources.testdb import customer_quarter_task
    full = customer_quarter_task(spark, SF).select("c_custkey", "cutoff_time", "churn", "spend")
    year = F.year("cutoff_time")
    return full.where(year < 1999), full.where((year == 2000) & (F.month("cutoff_time") == 1)).drop("churn", "spend")
