"""Each reader over a miniature file gives the rows written down for it."""

import pytest

from . import miniatures


@pytest.mark.parametrize("name", sorted(miniatures.oracle_sql()))
def test_reader(name, same):
    same(miniatures.queries()[name], miniatures.oracle_sql()[name])


def test_all_have_rows():
    assert set(miniatures.queries()) == set(miniatures.oracle_sql())
