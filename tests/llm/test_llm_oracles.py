from pathlib import Path

import pytest
from test_oracles import same_rows

from helixframe.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name])
