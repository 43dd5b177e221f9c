"""Copies of benchmark items that a rule for the whole alignment, or for some windows, would lose."""

from phraseloom.llm import decontamination


def held(spark, docs, items):
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontamination.matches(table, bench).collect()}


def test_a_clash_drops_only_its_windows(spark):
    goats = "Question 2: a farmer keeps 2 goats and some sheep on a wide green field near the river and sells the milk of all his animals at the market in town so how much milk does the farmer bring there on every day of one long week in spring"
    sums = "so we put 3 red balls and then 4 blue balls into the old bag on the table and draw from it without a look until nothing is left in there"
    docs = [
        goats.replace("2 goats", "7 goats"),
        sums.replace("3", "5").replace("4", "5"),  # two numbers of the item become one
        "so that she has 3 red balls and 3 blue balls in all",
    ]
    found = held(spark, docs, [goats, sums])
    assert set(found) == {(0, 0), (1, 1)}
    assert 3 <= found[0, 0]["n_matched"] < found[0, 0]["n_windows"]
    assert found[1, 1]["coverage"] == 1.0 and found[1, 1]["n_slots"] == 2


def test_windows_of_slots_are_matched_by_their_words(spark):
    sums = "Is 17 + 25 + 31 + 44 equal to 117 or 118 ?"
    names = "we met Anna Berta Carla Doris Emma Frieda Greta Hanna and Ida Julia Karla Lena Maria Nora Olga Paula"
    one = "add 5 6 7 8 9 10 to the sum now"  # a single window is plain words for half
    items = [sums, names, one, "3 4 5 6"]
    docs = [
        "They ask: " + sums + " Nobody knows.",
        sums.replace("25", "26").replace("44", "45").replace("118", "119"),
        "now " + names.lower(),
        names.replace("Anna", "Xenia").replace("Frieda", "Yvonne").replace("Karla", "Zita").replace("Olga", "Ute"),
        one.replace("10", "12"),
    ]
    found = held(spark, docs, items)
    assert {(0, 0), (2, 1)} <= set(found) and not {(1, 0), (3, 1)} & set(found)
    assert found[0, 0]["coverage"] == found[2, 1]["coverage"] == 1.0
    assert (4, 2) in found and found[4, 2]["coverage"] < 1


def test_a_name_that_begins_a_sentence_may_change(spark):
    items = [
        "Peter buys 12 apples at the market in town today",
        "Max runs fast. Eva sits. Tom eats his bread on the old bench",  # three such words in a window
        "the old farmer then asked Anna for a bag of red apples",
    ]
    docs = [
        "Anna buys 15 apples at the market in town today",
        "we saw that Anna buys 15 apples at the market in town today",
        "peter buys 12 apples at the market in town today",
        "Jan runs fast. Ada sits. Ole eats his bread on the old bench",
        "Jan runs fast, and Ada sits, but he eats his bread on the old bench",
        "The old farmer then asked Berta for a bag of red apples",
        "Peter sells 12 pears at the market in town today",
    ]
    found = held(spark, docs, items)
    assert set(found) == {(0, 0), (1, 0), (2, 0), (3, 1), (5, 2)}
    assert all(r["coverage"] == 1.0 for r in found.values())
    assert found[0, 0]["n_slots"] == 2 and found[5, 2]["n_slots"] == 1
