"""Joins of strings against brute force."""

from hiresift.operators import matching


def test_containment_inside_words_and_of_short_texts(spark):
    lefts = ["JavaScript", "java", "r", "", "data base", "ab", None, "react native", "İx", "java"]
    rights = ["java", "script", "R", "base", "abacus", "", None, "act nat", "javascript developer", "i̇x"]
    left = spark.createDataFrame([(x,) for x in lefts], "name string")
    right = spark.createDataFrame([(x,) for x in rights], "part string")
    got = [tuple(r) for r in matching.contains_either(left, right, "name", "part").collect()]
    want = {(x, y) for x in lefts for y in rights if x is not None and y is not None and (x.lower() in y.lower() or y.lower() in x.lower())}
    assert ("JavaScript", "java") in want and len(got) == len(set(got)) and set(got) == want
