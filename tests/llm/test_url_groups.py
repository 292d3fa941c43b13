"""Beyond the broadcast, rows stream past the levels of their shard in groups of bounded size."""

import pytest

from rollcall.llm import url_filter


@pytest.mark.parametrize("rows, batch", [(2_000_000, 10_000), (40, 7), (1, 3)])
def test_groups_of_bounded_size(spark, monkeypatch, rows, batch):
    hosts = [f"h{i}.{'com' if i % 3 else 'org'}" for i in range(300)]
    urls = [(i, f"http://{hosts[i % 300]}/{'en/' if i % 5 == 0 else 'x/'}{i}") for i in range(900)] + [(1000 + i, f"http://hot.com/{'en/1' if i == 0 else i}") for i in range(1500)] + [(5000 + i, None) for i in range(20)]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(5)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 64 << 20)
    want = {(r.page_id, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(url_filter, "ROWS_PER_GROUP", rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = url_filter.judge_urls(pages)
        assert {(r.page_id, r.verdict) for r in got.collect()} == want and got.count() == len(urls)
        assert {v for _, v in want} == {"allow", "block"} and all(v == "block" for i, v in want if 1000 <= i < 5000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
