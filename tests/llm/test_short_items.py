"""Operator 5 on items too short for edits."""

from cataloom.llm import decontaminate


def test_short_items_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Who is it?"), (2, "art"), (3, "twenty-three characters"), (4, "")], "item_id long, text string")
    rows = [(0, "start of parts"), (1, "modern ART."), (2, 'He said "who\n is  it?" twice: who is it?'), (3, "twenty-three charakters"), (4, "x twenty-three characters"), (5, ""), (6, None), (7, "who is it"), (8, "art")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.distance, r.end, r.budget) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 2, 0, 10, 0), (2, 1, 0, 19, 0), (3, 3, 1, 23, 1), (4, 3, 0, 25, 1), (8, 2, 0, 3, 0)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {0, 5, 6, 7}
