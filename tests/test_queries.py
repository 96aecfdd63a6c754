"""Every registered query against its SQL at the smallest scale."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"

sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry  # noqa: E402

from bandstream.plans.oracle import oracle  # noqa: E402
from bandstream.plans.queries import REGISTRY  # noqa: E402

spec = importlib.util.spec_from_file_location("check", ROOT / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_sql():
    assert set(REGISTRY) == set(oracle())
    assert set(REGISTRY) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    answer = db.execute(entry.oracle_sql()[name])
    assert check.type_gaps(df, answer) == []
    want = check.rows_of([c[0] for c in answer.description], answer.fetchall())
    assert check.rows_of(df.columns, df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
