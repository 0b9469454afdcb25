"""keep_first where ids repeat."""

from semlode.llm import jaccard

A, B = "a b c d e f g h i j", "k l m n o p q r s t"


def test_repeated_ids(spark):
    rows = [(1, A), (5, A), (5, B), (6, "x y"), (6, "x y"), (7, None), (7, None), (None, A), (9, "x y")]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, A), (5, B), (6, "x y"), (7, None), (7, None), (None, A)], key=repr)
