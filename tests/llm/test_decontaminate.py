"""Items that decontamination lost: slot-heavy ones, ones with a few deviating slots, and names that open sentences."""

from pagemill.llm import decontaminate


def judged(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {r.doc_id: r.item_ids for r in decontaminate.judge(rows, bench).collect()}


def test_dense_items_word_for_word(spark):
    items = ["12 34 + 56 78 - 9 10 * 11 12 / 13 14", "WHAT IS THE CAPITAL OF THE LARGEST STATE IN NORTH AMERICA", "7 8 9"]
    docs = [f"some text, and {items[0]} then more", f"he said {items[1]} and left", "he wrote 7 8 9 there", "12 35 + 56 79 - 9 11 * 11 13 / 13 15", "he said WHERE IS THE BORDER OF THE SMALLEST TOWN IN SOUTH ASIA today"]
    assert judged(spark, items, docs) == {0: "0", 1: "1", 2: "2", 3: "", 4: ""}


def test_dense_windows_take_nothing_from_templates(spark):
    item = "we know that every buyer pays the same price for 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24"
    assert judged(spark, [item], [item.translate(str.maketrans("0123456789", "5678901234"))]) == {0: "0"}


LONG = "then we see that {0} gave away {1} ripe pears to the old man by the gate and later on that day {2} sold some {3} sweet plums to a tall woman on the bridge before {4} walked all the way home with nothing left"


def test_a_deviating_slot_costs_its_windows_only(spark):
    item = LONG.format("Anna", 3, "Anna", 3, "Anna")
    docs = [LONG.format("Anna", 3, "Bert", 3, "Anna"), LONG.format("Carl", 5, "Carl", 7, "Carl"), LONG.format("Carl", 5, "Dora", 7, "Emil").replace(" ripe ", " bad ").replace(" tall ", " short ")]
    assert judged(spark, [item], docs) == {0: "0", 1: "0", 2: ""}


def test_names_that_open_sentences(spark):
    story = "{0} sold 48 clips in April. {0} sold half as many in May. {0} then gave the rest to a friend. {0} wants to know how many were sold in all."
    short = "Which river runs past the old town?"
    docs = [story.format("Natalia"), story.format("Maria").replace("48", "52"), 'They were asked, "Which river runs past the old town?" and left', "Nothing here"]
    assert judged(spark, [story.format("Natalia"), short], docs) == {0: "0", 1: "0", 2: "1", 3: ""}


def test_typographic_marks_hide_no_copy(spark):
    item = "Natalia sold 48 clips to her friend's shop - and said, \"it's enough\" - before she didn't sell any more of them in May."
    marks = item.replace("'", "’").replace(' "', " “").replace('"', "”").replace(" - ", "—")
    docs = spark.createDataFrame([(1, f"Before. {marks} After."), (2, f"Before. {item} After."), (3, "Natalia’s shop sold nothing.")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, marks)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contamination(docs, bench).collect()}
    assert {(1, 7), (1, 8), (2, 7), (2, 8)} == set(found)


def test_apostrophes_and_single_letters_are_no_units():
    import numpy as np

    raw = np.frombuffer("don't it's I'm 5 m s 3 l".encode(), np.uint8)
    words, _, readings = decontaminate.canonical(raw, np.array([0, len(raw)]))
    assert [bytes(raw[a:b]).decode() for a, b in zip(words.start, words.end)] == ["don't", "it's", "I'm", "5", "m", "s", "3", "l"]
    assert (readings[0][0] == decontaminate.UNIT).tolist() == [False, False, False, False, True, False, False, True]
