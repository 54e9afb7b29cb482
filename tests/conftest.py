import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from foldcast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def daily_full(spark):
    """2007-01-01 to 2013-12-31, y = 10 + day of year % 7."""
    return spark.sql(
        "SELECT d, CAST(10 + dayofyear(d) % 7 AS BIGINT) AS y FROM "
        "(SELECT explode(sequence(DATE '2007-01-01', DATE '2013-12-31')) AS d)"
    )


@pytest.fixture
def daily_gap(daily_full):
    return daily_full.where("d NOT IN (DATE '2008-02-29', DATE '2009-07-01')")


@pytest.fixture
def panel_small(spark):
    """Three entities; the last starts ten days late."""
    return spark.sql(
        "SELECT entity, d, CAST(100 * e + datediff(d, DATE '2020-01-01') AS BIGINT) AS y FROM "
        "(SELECT e, concat('e', e) AS entity, explode(sequence("
        "date_add(DATE '2020-01-01', IF(e = 3, 10, 0)), DATE '2020-02-09')) AS d "
        "FROM VALUES (1), (2), (3) t(e))"
    )


@pytest.fixture
def skewed(spark):
    """3,000 rows, a third of them of one key; (key, t) is unique."""
    return spark.range(3000).selectExpr(
        "IF(id < 1000, 0, 1 + id % 50) AS key", "id AS t", "CAST(id * 7 % 101 AS DOUBLE) AS v"
    )


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def rows_of(df, *names):
    """Rows as sorted tuples."""
    chosen = df.select(*[f"`{n}`" for n in names]) if names else df
    return sorted(
        (tuple(r) for r in chosen.collect()),
        key=lambda row: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row),
    )
