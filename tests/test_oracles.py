"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import pytest

from routestats.queries import REGISTRY

duckdb = pytest.importorskip("duckdb")

# The rest of the list runs with tools/check_oracles.py; modelling has its own tests.
CHOSEN = [
    name
    for name, query in REGISTRY.items()
    if query.sql and name.startswith(("src", "snk01", "flt", "cln", "join", "agg", "win", "srt", "st0", "prf", "evl"))
]


@pytest.fixture(scope="module")
def con(sf):
    from tools.check_oracles import connect

    return connect(sf)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, sf, name):
    from tools.check_oracles import compare

    rows, message = compare(spark, con, sf, REGISTRY[name].run, REGISTRY[name].sql)
    assert not message
    assert rows


def test_every_operator_is_registered():
    """Each id of the operator list has a query, under its id or in a query that names it."""
    ids = {name.split("_")[0] for name in REGISTRY}
    listed = {"src": 6, "snk": 5, "flt": 13, "prj": 5, "cln": 9, "sca": 12, "join": 6, "agg": 21, "win": 5,
              "srt": 3, "top": 3, "lim": 1, "smp": 1, "set": 1, "prf": 3, "st": 9, "ml": 12, "evl": 7, "q": 54}
    # CLN08 is the default of JOIN04; its query is q45_dest_state.
    missing = {f"{k}{i:02d}" for k, n in listed.items() for i in range(1, n + 1)} - ids - {"cln08"}
    assert not missing
