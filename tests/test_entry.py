"""Registered queries against their SQL on the smallest tables, a few per family."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, norm  # noqa: E402

SF = "/root/testdata/sf0.001"
PICKED = ["a05_average_precision", "a12_ratio_metrics", "a26_bootstrap_ci", "j06_resolve_ids", "k02_reverse_map", "u01_pairwise_overlap", "g01_connected_components",
          "w04_rolling_mean_strict", "x13_hydrophobicity", "d08_crop", "e06_promotion", "s07_xml_chains", "f03_safe_token", "t01_streaming_confusion"]

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables are absent")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 190


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), cols)


def test_flagship(spark):
    assert entry.entry(spark).count() == 2
