"""Queries against their SQL on small tables of odd rows."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from convoke import queries as core


def held(spark, folder, name, table, rows):
    """The query's rows and the SQL's over one table."""
    pq.write_table(pa.Table.from_pylist(rows), folder / f"{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    found = con.execute(core.ORACLES[name])
    names = [d[0] for d in found.description]
    own = core.QUERIES[name](spark, str(folder)).select(*names).collect()
    return sorted(map(tuple, own)), sorted(found.fetchall())


HEADS = ["cut &amp;&amp;&amp", "cut &am", "token = &quot;a", "&copy; 2026", "&amp;quot; &amp;lt; &lt;b&gt;", "A &#65; &eacute;", "plain &", "a &lt b"]


@pytest.mark.parametrize("name", ["event_ids", "page_titles"])
def test_heading_references(spark, tmp_path, name):
    pages = [{"page_id": k, "url": f"https://www.h.org/{k}/", "html": f"<html><title>t</title><h1>{h}</h1></html>"} for k, h in enumerate(HEADS)]
    own, sql = held(spark, tmp_path, name, "pages", pages)
    assert own == sql


def test_blocks_keep_addresses_and_headings_apart(spark, tmp_path):
    """Trailing slashes, white space and letters in other forms are other addresses and headings to the SQL; case is not."""
    rows = [
        ("http://a.org/x/", "One"), ("http://a.org/x", "One"), ("http://b.org/", "One"), ("http://b.org", "Two  words"), ("https://www.c.org/p?q=1", "Two words"), ("http://C.org/P#x", "two  words"),
        ("http://d.org/1", "Two words"), ("http://d.org/2", "caf\u00e9"), ("http://d.org:80/3", "cafe\u0301"), ("http://d.org/3?a", "cafe\u0301"), ("http://d.org/3", None), ("http://e.org/4", None),
    ]
    pages = [{"page_id": k, "url": u, "html": f"<h1>{t}</h1>" if t else "<p>"} for k, (u, t) in enumerate(rows)]
    own, sql = held(spark, tmp_path, "dedup_blocks", "pages", pages)
    assert own == sql
