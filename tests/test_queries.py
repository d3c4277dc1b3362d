"""Every catalog query against its SQL, and those without SQL against their shape."""

import pytest
from compare import SF, same

from quarry.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
