import pytest

from earshot import llm
from tests.oracle import connect, rows

ORACLE = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, name):
    got, want = llm.queries()[name](spark, sf).toPandas(), connect(sf).sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: df.astype({c: "float64" for c in df if str(df[c].dtype) in ("Int64", "float64")})  # noqa: E731  nullable numbers
    assert rows(plain(got)) == rows(plain(want))


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in llm.queries()) == list(range(1, 14))
