"""Template decontamination: exact items, other parameters, inconsistent slots; no Python on the way."""

import pytest
from plumbspark.llm.decontamination import contaminated

ITEM = "Anna has 3 apples and buys 5 kg of pears at the big market, then Anna gives 3 apples to her friend Boris today."


@pytest.fixture
def items(spark):
    def make(pairs):
        return spark.createDataFrame([(i, t, "x") for i, t in pairs], "item_id long, text string, doc_id string")

    return make


def found(docs, items, pairs, benchmark):
    return sorted((r.doc_id, r.item_id) for r in contaminated(docs(pairs), items(benchmark)).collect())


def test_items_are_found(docs, items):
    other = ITEM.replace("Anna", "Maria").replace("3", "12").replace("5 kg", "8 pounds").replace("Boris", "Igor")
    mixed = ITEM.replace("gives 3 apples", "gives 4 apples")  # 3 stands for 3 and for 4
    pairs = [
        (1, "Some words first. " + ITEM + " And more words after it."),
        (2, "Lead in, " + other),
        (3, "Lead in, " + mixed),
        (4, "Nothing of the kind is in this text, which is long enough to hold a few windows of its own."),
        (5, ITEM + " " + other),
        (6, "she " + ITEM.lower().replace(",", "")),
        (None, ITEM),
    ]
    got = found(docs, items, pairs, [(10, ITEM)])
    assert (1, 10) in got and (2, 10) in got and (5, 10) in got
    assert not {3, 4, None} & {d for d, _ in got}


def test_a_long_part_is_enough_and_a_short_one_is_not(docs, items):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    item = " ".join(words)
    pairs = [(1, "x y z " + " ".join(words[10:23]) + " q r s"), (2, "x y z " + " ".join(words[10:22]) + " q r s"), (3, " ".join(words[:30] + ["new"] + words[30:]))]
    assert found(docs, items, pairs, [(1, item)]) == [(1, 1), (3, 1)]


def test_odd_rows(docs, items, odd):
    benchmark = [(1, None), (2, ""), (None, ITEM), (3, "short one here"), (3, "short one here"), (4, "12 34 56 78 90 12 34 56 78"), (5, ITEM)]
    pairs = odd + [(20, "a short one here now"), (21, "12 34 56 78 90 12 34 56 78"), (22, ITEM), (22, ITEM)]
    assert found(docs, items, pairs, benchmark) == [(20, 3), (22, 5)]
    assert found(docs, items, [], benchmark) == [] == found(docs, items, pairs, [])


def test_copies_in_other_case_are_found(docs, items):
    plain = "the Straße of anna has three apples and buys pears at the big market before Noon"
    pairs = [
        (1, ITEM.upper()), (2, "well " + ITEM.lower()), (3, "x " + plain.upper()), (4, plain.title()),
        (5, ITEM.upper().replace("PEARS", "PLUMS").replace("FRIEND", "SISTER").replace("BUYS", "SELLS").replace("GIVES", "TAKES")),
    ]
    got = contaminated(docs(pairs), items([(10, ITEM), (11, plain)])).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 10), (2, 10), (3, 11), (4, 11)]
    assert all(r.n_matched == r.n_windows for r in got)


def test_items_of_numbers_and_names_are_found_by_their_values(docs, items):
    sums, names = "12 34 56 78 90 12 34 56 78", "Anna Boris Clara Doris Emil Frida Gustav Hanna"
    pairs = [(1, "x " + sums), (2, "x " + sums.replace("56", "57")), (3, names.upper() + " y"), (4, names.replace("Emil", "Igor")), (5, ITEM), (6, " ".join(ITEM.split()[:13]))]
    benchmark = [(1, sums), (2, names), (3, ITEM), (4, "1 2 3 4 5 6 " + " ".join(ITEM.lower().split()[8:14]))]
    got = contaminated(docs(pairs), items(benchmark), slot_heavy=True).collect()
    assert sorted((r.doc_id, r.item_id, r.n_matched, r.n_windows) for r in got) == [(1, 1, 2, 2), (3, 2, 1, 1), (5, 3, 17, 17), (6, 3, 6, 17)]


def test_no_python(docs, items, plan):
    text = plan(contaminated(docs([(1, ITEM)]), items([(1, ITEM)])))
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text and "NestedLoop" not in text
