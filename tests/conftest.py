import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ebbtide import settings as S  # noqa: E402
from ebbtide.session import local_session  # noqa: E402

# A plain customer; tests override single fields.
DEFAULTS = {
    "customer_id": "nobody",
    "region": "Harbour",
    "device_type": "Kiosk",
    "subscription_plan": "Gold",
    "account_age_days": 731,
    "monthly_spend": 62.5,
    "num_orders_last_90d": 3,
    "avg_order_value": 31.25,
    "support_tickets_raised": 2,
    "days_since_last_login": 41,
    "pages_per_session": 5.5,
    "churned": 0,
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, app="tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def customers(spark):
    """Build a customer table from a list of field overrides."""

    def build(*overrides):
        rows = []
        for i, change in enumerate(overrides):
            row = {**DEFAULTS, "customer_id": f"c{i}", **change}
            rows.append(tuple(row[f.name] for f in S.CUSTOMER_SCHEMA))
        return spark.createDataFrame(rows, S.CUSTOMER_SCHEMA)

    return build


@pytest.fixture(scope="session")
def population(spark):
    """240 seeded customers whose label depends on recency and plan, with missing and impossible values."""
    import numpy as np

    rng = np.random.default_rng(7)
    plans = ["Free", "Basic", "Premium", "Enterprise"]
    rows = []
    for i in range(240):
        plan = plans[rng.integers(4)]
        login = int(rng.integers(0, 366))
        odds = 0.01 * (login - 180) + (0.8 if plan == "Free" else -0.2)
        churned = int(rng.random() < 1 / (1 + np.exp(-odds)))
        rows.append(
            (
                f"id{i:04d}",
                ["North", "South", "East"][rng.integers(3)],
                ["Mobile", "Desktop", "Tablet"][rng.integers(3)],
                plan,
                -1 if i % 50 == 0 else int(rng.integers(1, 1500)),
                None if i % 17 == 0 else float(rng.lognormal(4, 1)),
                int(rng.integers(0, 8)),
                None if i % 19 == 0 else float(rng.lognormal(4.5, 0.6)),
                int(rng.integers(0, 6)),
                999 if i % 60 == 1 else login,
                None if i % 23 == 0 else float(rng.uniform(1, 15)),
                churned,
            )
        )
    return spark.createDataFrame(rows, S.CUSTOMER_SCHEMA).persist()
