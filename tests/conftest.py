import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "millrace-tests", "6g")
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


def rows(df, *order):
    """Rows as tuples, sorted by the given columns."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture
def delivery(spark):
    """Two-row instance of the three related tables; every check passes on it."""
    restaurants = spark.createDataFrame(
        [
            (1, "Pizza Place", 12.97, 77.59, "Italian", 4.5, 15),
            (2, "Burger Hub", 13.01, 77.61, "Indian", 4.2, 20),
        ],
        "id long, name string, lat double, lon double, cuisine string, avg_rating double, prep_capacity long",
    )
    riders = spark.createDataFrame(
        [(1, 12.98, 77.60, "bike", 10, 6.0, 1, "R-001"), (2, 13.00, 77.62, "bike", 20, 6.5, 0, "R-002")],
        "id long, lat double, lon double, vehicle_type string, completed_orders long, shift_hours double, "
        "current_load long, rider_call_sign string",
    )
    orders = spark.createDataFrame(
        [
            (1, 1, 1, 12.99, 77.58, 2, 35.0, "2026-01-01T10:00:00Z", 15, 35.0, "delivered", "BLR10"),
            (2, 2, 2, 13.02, 77.63, 1, 30.0, "2026-01-01T11:00:00Z", 20, 30.0, "delivered", "WELCOME50"),
        ],
        "id long, restaurant_id long, rider_id long, drop_lat double, drop_lon double, order_size long, "
        "order_value double, timestamp string, promised_eta long, actual_delivery_time_min double, "
        "order_status string, promo_code_used string",
    )
    return {"restaurants": restaurants, "riders": riders, "orders": orders}
