from pyspark.sql import functions as F

from shelfwise.operators.joins import containment_join, disjunctive_join, lookup_with_fallback, not_in_anti_join, phrase_hits


def test_not_in_semantics(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,)], "r int")
    with_null = spark.createDataFrame([(2,), (None,)], "r int")
    empty = spark.createDataFrame([], "r int")
    assert sorted(r.k for r in not_in_anti_join(left, right, "k", "r").collect()) == [1]
    assert not_in_anti_join(left, with_null, "k", "r").count() == 0
    assert sorted((r.k is None, r.k) for r in not_in_anti_join(left, empty, "k", "r").collect()) == \
        [(False, 1), (False, 2), (True, None)]


def test_disjunctive_equals_or_join(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "y", 20), (3, "z", 30), (4, None, 40)], "id int, k1 string, k2 int")
    b = spark.createDataFrame([("x", "bx"), ("20", "b20"), ("y", "by"), ("10", "b10")], "code string, attr string")
    a2 = a.withColumn("k2s", F.col("k2").cast("string"))
    ours = disjunctive_join(a2, b, ("k1", "code"), ("k2s", "code"), how="left")
    ref = a2.join(b, (a2.k1 == b.code) | (a2.k2s == b.code), "left")
    key = lambda r: (r.id, r.attr or "")
    assert sorted(map(key, ours.collect())) == sorted(map(key, ref.collect()))


def test_containment_equals_nested_loop(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "a lazy dog sleeps here"),
                                  (3, "foxes are quick"), (4, "xbrownx")], "doc_id int, text string")
    items = spark.createDataFrame([(10, "quick brown fox"), (11, "dog sleeps here"), (12, "rown"),
                                   (13, "quick"), (14, "brown fox jumps now"), (15, "ps her"),
                                   (16, "x y the lazy")], "item_id int, item_text string")
    ours = containment_join(docs, "doc_id", "text", items, "item_id", "item_text").select("doc_id", "item_id")
    ref = docs.crossJoin(items).filter(F.col("text").contains(F.col("item_text"))).select("doc_id", "item_id")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


def test_containment_hot_tokens_and_one_letter_items(spark):
    # "the" is in every document and is the only interior token of an item; "e" is in nearly every token.
    docs = spark.createDataFrame([(i, f"see the tree{i % 7} here") for i in range(400)] + [(900, "of the"), (901, ""), (902, None)],
                                 "doc_id int, text string").repartition(5)
    items = spark.createDataFrame([(1, "see the tree3"), (2, "e"), (3, "q"), (4, " "), (5, ""), (6, "ee3 h"), (7, None), (8, "of the")],
                                  "item_id int, item_text string")
    ours = containment_join(docs, "doc_id", "text", items, "item_id", "item_text").select("doc_id", "item_id")
    ref = (docs.crossJoin(items).filter(F.col("text").contains(F.col("item_text")) & (F.trim("item_text") != ""))
           .select("doc_id", "item_id"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))
    none_short = items.filter(F.col("item_id") == 1)
    assert containment_join(docs, "doc_id", "text", none_short, "item_id", "item_text").count() == 57
    assert containment_join(docs, "doc_id", "text", items.limit(0), "item_id", "item_text").count() == 0


def test_lookup_with_fallback(spark):
    rows = spark.createDataFrame([(1, 100, "n1"), (2, 200, "n1"), (3, 300, "n9")], "o int, c int, nation string")
    exact = spark.createDataFrame([(100, "BUILDING")], "c int, seg string")
    fb = spark.createDataFrame([("n1", "MACHINERY")], "nation string, seg string")
    out = {r.o: (r.segment, r.matched_by) for r in
           lookup_with_fallback(rows, exact, ("c", "c"), fb, ("nation", "nation"), "seg", "segment").collect()}
    assert out == {1: ("BUILDING", "exact"), 2: ("MACHINERY", "nation"), 3: (None, None)}


def _phrase_cases(spark):
    docs = spark.createDataFrame([(i, "x", f"see the tree{i % 7} here", "k") for i in range(60)]
                                 + [(100, None, "the quick brown fox; foxes", "k"), (101, "y", "", "k"), (102, "y", None, "k"),
                                    (103, "z", "书名在这里 ab\u0301 AbAbAb", "k"), (104, "z", "word " * 30_000 + "needle in it", "k")],
                                 "doc_id int, kind string, text string, item_text string").repartition(5)
    # Phrases within phrases, overlapping, repeated under several keys, of one letter, of other scripts, blank and null.
    items = spark.createDataFrame([(1, "tree3"), (2, "e"), (3, "see the tree3 here"), (4, " "), (5, ""), (6, None), (7, "quick brown fox"),
                                   (8, "brown"), (9, "own f"), (10, "brown"), (11, "书名"), (12, "bA"), (13, "AbAb"), (14, "needle in it"),
                                   (15, "absent phrase of words"), (1, "tree3"), (1, "fox;"), (16, "zq")], "item_id int, phrase string")
    return docs, items


def test_phrase_hits_equal_nested_loop_by_either_way(spark):
    docs, items = _phrase_cases(spark)
    want = (docs.crossJoin(items.select("item_id", "phrase")).filter(F.col("text").contains(F.col("phrase")) & (F.trim("phrase") != ""))
            .select("doc_id", "kind", "item_text", "item_id").distinct())
    want = sorted(map(tuple, want.collect()), key=str)
    by_automaton = phrase_hits(docs, "doc_id", "text", items, "item_id", "phrase")
    assert by_automaton.columns == ["doc_id", "kind", "item_text", "item_id"]
    assert "MapInArrow" in by_automaton._jdf.queryExecution().toString()
    by_join = phrase_hits(docs.drop("item_text"), "doc_id", "text", items, "item_id", "phrase", most_bytes=10)
    assert "MapInArrow" not in by_join._jdf.queryExecution().toString()
    assert sorted(map(tuple, by_automaton.collect()), key=str) == want
    assert sorted(map(tuple, by_join.collect()), key=str) == sorted([(d, k, i) for d, k, _, i in want], key=str)


def test_phrase_hits_of_repeated_documents_and_no_phrases(spark):
    docs, items = _phrase_cases(spark)
    assert phrase_hits(docs, "doc_id", "text", items.limit(0), "item_id", "phrase").collect() == []
    assert phrase_hits(docs.limit(0), "doc_id", "text", items, "item_id", "phrase").collect() == []
    one = phrase_hits(docs, "doc_id", "text", items, "item_id", "phrase").count()
    assert phrase_hits(docs.unionByName(docs), "doc_id", "text", items, "item_id", "phrase").count() == 2 * one


def test_short_items_are_looked_up_by_grams_not_substrings(spark):
    """The short-key lookup makes as many rows as a token has letters, however many lengths the keys have."""
    docs = spark.createDataFrame([(1, "a" * 2_000 + "bcd" + "e" * 2_000), (2, "abc")], "doc_id int, text string")
    items = spark.createDataFrame([(k, "a" * k + "b") for k in range(0, 300, 7)] + [(1000, "cde"), (1001, "zz"), (1002, "a" * 2_001)],
                                  "item_id int, item_text string")
    got = containment_join(docs, "doc_id", "text", items, "item_id", "item_text").select("doc_id", "item_id")
    want = [(1, k) for k in range(0, 300, 7)] + [(1, 1000), (2, 0)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
