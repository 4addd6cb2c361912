"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from phonoscope import queries as library
from tests.compare import ROOT, same

SIZE = f"{ROOT}/sf0.001"


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_same_as_sql(spark, name):
    same(library.QUERIES[name], library.ORACLES[name], spark, SIZE)


def test_entry(spark):
    views = entry.entry(spark)
    assert views.columns[:4] == ["word", "text", "code", "mass"]
    assert views.where("place = 1").limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lookup_of_documents_against_all_pairs(spark, tmp_path):
    texts = ["Banana bandana benin cat", "cut kit dog dig, banana", "strength string a", None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.word, r.entry): float(r.score) for r in library.QUERIES["phonetic_lookup_documents"](spark, str(tmp_path)).collect()}
    words = sorted({w for t in texts if t for w in t.lower().replace(",", " ").split()})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    keys = {r.word: {v.text: v.mass for v in r.views} for r in frame.select("word", library.simplify.simplify(library.F.col("word")).alias("views")).collect()}
    wanted = {}
    for a in words:
        for b in words:
            both = [min(keys[a][k], keys[b][k]) for k in keys[a].keys() & keys[b].keys() if k]
            if both:
                wanted[a, b] = max(both)
    assert found.keys() == wanted.keys() and all(abs(found[p] - wanted[p]) < 1e-3 for p in wanted)
    assert any(s < 0.5 for s in wanted.values())
