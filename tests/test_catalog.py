import pytest
from oracle import assert_same

from helixloom.plans import catalog, catalog_calls  # noqa: F401 (its queries join the catalogue)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.SQL:
        assert_same(spark, catalog.QUERIES[name], catalog.SQL[name], SF)
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0
