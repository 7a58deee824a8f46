"""Queries over texts against their SQL where some texts are empty or null."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
from check import norm  # noqa: E402

TEXTS = ["", "ACD efg\nMI", None, "x" * 700 + "Q" * 513, "", "W", "two words and  blanks\n", "é" * 512]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'en', ?, ?)", [(i, t, f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)])
    con.execute(f"copy documents to '{path}/documents.parquet' (format parquet)")
    return con, str(path)


@pytest.mark.parametrize("name", ["d11_slices", "d11_unslice", "s11_aliases", "f21_alignment_stats", "f19_cigar", "f20_map_positions", "f17_pos_features", "f16_pos_encoding"])
def test_query_matches_sql_on_empty_texts(spark, odd, name):
    con, path = odd
    df = entry.queries()[name](spark, path)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), cols)
