"""The pipeline against a version that follows each stage by hand on a small corpus."""

import re
import zlib

import pytest
from test_llm_operators import check_packing, components_by_hand, hits_by_hand

pipeline = pytest.importorskip("corpus_pipeline")
TABLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    odd = spark.createDataFrame([(100_000, None, "en", "odd", 0), (100_001, "", "en", "odd", 0), (100_002, "12 34", "en", "odd", 5), (100_003, "the of and password=abcdefgh1 in a of the", "en", None, 40), (100_003, "the of and password=abcdefgh1 in a of the", "en", None, 40)], docs.schema)
    docs, out = docs.unionByName(odd), []
    for _, stage in pipeline.STAGES:
        done = stage(spark, docs, TABLE)
        rows = done.collect()
        out.append((docs, done, rows))
        docs = spark.createDataFrame(rows, done.schema)
    return out


def test_columns_stay(stages):
    for docs, done, _ in stages[:-1]:
        assert done.schema.names == docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_id(stages):
    docs, _, rows = stages[0]
    want = sorted(r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text)))
    assert sorted(r.doc_id for r in rows) == want


def test_language_id_rejects_what_no_language_claims(spark):
    """The score decides: junk with letters and texts in languages that were not learned go, with a label or without."""
    docs = spark.read.parquet(f"{TABLE}/documents.parquet")
    texts = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由在尊严和权利上一律平等",
        "#### 123 456 x 789 $$$ 000",
        "12 34 56 a " * 30,
        "kq0zv8x7jw3qxz kzxq vvwk jjqx zzkw qxjv",
    ]
    # a row with a label that is not held out would be learned from
    odd = [(i, t, "en" if zlib.crc32(str(i).encode()) % 4 == 2 else None, "odd", len(t)) for i, t in enumerate(texts, 100_000)]
    assert {r[2] for r in odd} == {"en", None}
    got = pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), TABLE)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text)))


def test_near_duplicates(stages):
    docs, _, rows = stages[1]
    before = sorted(docs.collect(), key=lambda r: r.doc_id)
    comp = components_by_hand([r.text for r in before], 5, 4, 5)
    assert sorted(r.doc_id for r in rows) == [r.doc_id for i, r in enumerate(before) if comp[i][1] == i]


def test_decontamination(spark, stages):
    docs, _, rows = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{TABLE}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect() if not hits_by_hand(r.text, items)[4])


def test_secret_scans(stages):
    docs, _, rows = stages[3]
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in rows}
    assert set(before) == set(after) and after[100_003].text == "the of and [secret] in a of the"
    odd = re.compile(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")
    for i, t in before.items():
        assert not odd.search(after[i].text) and after[i].n_chars == len(after[i].text)
        assert after[i].text == t or "[secret]" in after[i].text


def test_packing(stages):
    docs, _, rows = stages[4]
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 2048)


def corpus(spark, at, docs, bench):
    docs.write.parquet(f"{at}/documents.parquet")
    bench.write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_run_is_the_stages(spark, stages, tmp_path):
    sf_dir = corpus(spark, tmp_path, stages[0][0], spark.read.parquet(f"{TABLE}/benchmark.parquet"))
    rows, by_hand = pipeline.run(spark, sf_dir).collect(), stages[4][2]
    check_packing(rows, {r.doc_id: r.text for r in stages[4][0].collect()}, 2048)
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(r.doc_id, r.doc_tokens) for r in by_hand}
    assert pipeline.ORACLE_SQL is None


def test_run_on_empty_tables(spark, stages, tmp_path):
    docs, bench = stages[0][0], spark.read.parquet(f"{TABLE}/benchmark.parquet")
    none = pipeline.run(spark, corpus(spark, tmp_path / "docs", docs.limit(0), bench))
    assert none.count() == 0 and none.schema.names == stages[4][1].schema.names
    rows = pipeline.run(spark, corpus(spark, tmp_path / "bench", docs, bench.limit(0))).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages[1][2]}  # nothing to decontaminate: all that the second stage kept
