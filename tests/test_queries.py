import pytest

from halocline.oracles import ORACLES
from halocline.queries import QUERIES
from tests.compare import against_oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    against_oracle(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
