import pytest

from halocline.llm.oracles import ORACLES
from halocline.llm.queries import QUERIES
from tests.compare import against_oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    against_oracle(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
