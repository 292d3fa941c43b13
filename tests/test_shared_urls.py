"""Pages that share a url, or have none."""

import os

import duckdb
from compare import DATA, agrees

from rollcall.queries import ORACLE, QUERIES


def test_pages_that_share_a_url_are_attached_by_their_own_id(spark, tmp_path):
    con = duckdb.connect()
    own = "CASE WHEN page_id % 5 > 0 THEN concat('https://example.org/', page_id % 3) END AS url"
    con.execute(f"COPY (SELECT page_id, {own}, html FROM '{DATA}/pages.parquet') TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    os.symlink(f"{DATA}/orders.parquet", tmp_path / "orders.parquet")
    agrees(spark, QUERIES["JN-12"], ORACLE["JN-12"], str(tmp_path))
