"""Columns that bear an operator's output or inner names, in any case."""

from tallyframe.llm import decontaminate, extract, licenses, mixing, quality, sharding

SCHEMA = "doc_id long, text string, source string, `__src` string, `__norm` string, N_Words string, Size int, SHARD int, `a.b` int"


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "MIT License one two", "a", "x", "y", "z", 1, 2, 3), (2, None, None, None, None, None, None, None, None)], SCHEMA)
    other = ["doc_id", "text", "source", "__src", "__norm"]
    m = mixing.mix_sources(d).orderBy("doc_id").collect()
    assert m[0].asDict()["size"] == 4 and m[0]["__src"] == "x" and m[0]["N_Words"] == "z" and m[0]["a.b"] == 3
    assert m[0].__fields__ == [*other, "N_Words", "SHARD", "a.b", "size", "source_size", "target", "taken"]
    x = licenses.scan_licenses(d).orderBy("doc_id").collect()
    assert x[0]["n_words"] == 4 and x[0]["__norm"] == "y" and x[0]["base_labels"] == "mit" and x[1]["n_words"] == 0
    assert "N_Words" not in x[0].__fields__ and x[0]["a.b"] == 3
    q = quality.quality(d)
    assert "N_Words" not in q.columns and {r["doc_id"]: r["n_words"] for r in q.collect()} == {1: 4, 2: 0}
    assert len(mixing.mixed_documents(d).collect()) <= 2 and quality.filter_quality(d).columns == d.columns
    s = sharding.assign_shards(d, "doc_id", sharding.shard_names(3), 11)
    assert "SHARD" not in s.columns and s.count() == 2
    b = spark.createDataFrame([(5, "license one two")], "item_id long, text string")
    c = decontaminate.contamination(d, b)
    assert c.columns == [*d.columns, "n_items", "items", "contaminated"]
    assert {r["doc_id"]: r["items"] for r in c.collect()} == {1: [5], 2: []}
    pages = d.selectExpr("doc_id as page_id", "concat('<article><p>', text, '</p></article>') as HTML", "1 as TEXT", "`a.b`")
    e = extract.extract(pages)
    assert e.columns == ["page_id", "a.b", "text", "n_chars"] and e.count() == 2
