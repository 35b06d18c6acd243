"""Worked examples of names, citations, sources, letters and reading views give their known rows."""

import pytest

from tests.test_oracle import duck, same_rows  # noqa: F401
from tests.worked import laws, sourcing  # noqa: F401
from tests.worked.registry import EXAMPLES, SQL


@pytest.mark.parametrize("name", EXAMPLES)
def test_example(spark, sf, duck, name):  # noqa: F811
    same_rows(EXAMPLES[name](spark, sf), duck, SQL[name])
