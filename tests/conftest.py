import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales(spark):
    """A small messy export: sixteen bookings, two of them repeats of earlier ones."""
    rows = [
        ("B-101", "2023-03-02", "Alps", "Cabin", "€420.00", "12%", "2", "No"),
        ("B-102", "2023-03-18", "coast", "Tent", "€95.50", "0%", "4", "No"),
        ("B-103", "04/21/2023", "Coast", "Cabin", "€1,310.00", "8%", "6", "Yes"),
        ("B-104", "2023-04-25", "Coast ", "Loft", "€288.25", "0%", "2", "No"),
        ("B-105", "2023-05-06", "Lakes", "Tent", "n/a", "0%", "3", "No"),
        ("B-106", "2023-05-30", "Alps", "Loft", "€640.00", "5%", "2", "No"),
        ("B-107", "2023-06-11", "", "Cabin", "€777.00", "10%", "5", "Yes"),
        ("B-108", "2023-06-12", "Alps", "Tent", "€110.75", "0%", "1", "No"),
        ("B-109", "2023-07-04", "Lakes", "Cabin", "€2,045.50", "20%", "8", "No"),
        ("B-110", "2023-07-19", "Heath", "Loft", "€305.00", "0%", "2", "Yes"),
        ("B-111", "2023-08-01", "Heath", "Tent", "€88.00", "0%", "2", "No"),
        ("B-112", "2023-08-15", "Lakes", "Cabin", "€990.00", "6%", "4", "Yes"),
        ("B-113", "2023-08-28", "Alps", "Loft", "€512.25", "0%", "3", "No"),
        ("B-114", "2023-09-09", "Coast", "Tent", "€130.00", "4%", "2", "No"),
    ]
    names = ["order_id", "order_date", "region", "product", "revenue", "discount_pct", "quantity", "returned"]
    return spark.createDataFrame(rows + [rows[5], rows[8]], names)


@pytest.fixture(scope="session")
def prepared(sales):
    from tabscope.plans.prepare import prepare

    return prepare(sales)
