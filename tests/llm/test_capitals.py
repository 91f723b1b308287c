"""A line whose only letter is a capital fails, whatever the rest of the document has."""

from veritile.llm import quality_rules


def test_one_capital_is_shouting(spark):
    rows = [(1, "some words in a line of prose.\n7 8 9 X.\nand more words in a line."), (2, "some words in a line of prose.\n7 8 9 Abc.")]
    got = {r["doc_id"]: r["clean_text"] for r in quality_rules.evaluate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "X." not in got[1] and "some words" in got[1] and "Abc." in got[2]
