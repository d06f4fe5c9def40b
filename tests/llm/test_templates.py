"""Template decontamination: re-parameterised questions, capitals, clashes, and a plain computation of its windows."""

import random

from loomstat.llm import decontamination as dec

QUESTION = "Tom has 12 apples and 7 pears. Tom eats 3 apples. How many are left?"


def found(spark, texts, items, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in dec.find_contamination(df, bench, **options).collect()}


def test_names_at_the_start_of_sentences(spark):
    texts = [QUESTION, QUESTION.replace("Tom", "Ann"), QUESTION.replace("Tom", "Ann").replace("12", "15").replace("7", "8"), QUESTION.lower(), QUESTION.upper(), "so: tom has 12 apples and 7 pears", "Ann has 12 apples and 7 pears. Bob eats 3 apples. How many are left?"]
    got = found(spark, texts, [QUESTION])
    assert {d for d, _ in got} >= {0, 1, 2, 3, 4}
    assert [got[d, 0].changed_slots for d in (0, 1, 2)] == [0, 1, 3]
    # Tom stands for Ann and for Bob: what agrees verbatim is too short
    assert (6, 0) not in got
    assert set(found(spark, texts, [QUESTION], broadcast_windows=0)) == set(got)


def test_clashing_slots_leave_the_verbatim_windows(spark):
    item = "If the farmer buys 12 apples and 7 pears and then sells most of the fruit for 12 coins how many are left over"
    got = found(spark, [item.replace("12 coins", "6 coins"), item.replace("12", "5").replace("7", "5")], [item])
    assert (0, 0) in got and (1, 0) in got and got[1, 0].changed_slots == 2


def test_recall_on_questions_with_new_values(spark):
    rng = random.Random(4)
    names = ["Tom", "Ann", "Bob", "Eve", "Kim", "Zoe"]
    verbs = ["buys", "sells", "finds", "counts", "paints", "carries"]
    items = [f"{a} {rng.choice(verbs)} {rng.randint(2, 90)} {t} and {b} {rng.choice(verbs)} {rng.randint(2, 90)} {u}. How many more {t} does {a} have after {rng.randint(2, 9)} days?" for t, u in [("apples", "pears"), ("red cars", "blue cars"), ("old books", "new books"), ("small fish", "large fish")] for a, b in [rng.sample(names, 2) for _ in range(5)]]
    others = ["Lou", "Max", "Pam", "Sue", "Tim", "Vic"]
    texts = []
    for item in items:
        new = dict(zip(names, others, strict=True))
        numbers: dict[str, str] = {}
        words = []
        for w in item.split():
            core = w.strip(".?")
            if core.isdigit():
                w = w.replace(core, numbers.setdefault(core, str(rng.randint(100, 999))))
            words.append(w.replace(core, new.get(core, core)) if core in new else w)
        texts.append("some words before. " + " ".join(words) + " and some after")
    got = found(spark, texts, items)
    assert sum((i, i) in got for i in range(len(items))) >= 0.9 * len(items)
    clean = [f"The {x} of the {y} stood near a {x} while nobody spoke of the {y} at all" for x in ("house", "river", "tree") for y in ("road", "hill")]
    assert not found(spark, clean, items)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, QUESTION, 5, "x"), (2, "nothing of the kind", 6, "y"), (None, None, 7, "z")], "doc_id long, text string, found_id int, FOUND_ID_ string")
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    got = dec.decontaminated(docs, bench)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {2, None}


def test_numbers_of_any_length_keep_their_units(spark):
    item = "the long wall is " + "9" * 60 + " km long and nobody has ever walked along all of it"
    assert (0, 0) in found(spark, [item.replace("9" * 60, "8" * 61).replace(" km ", " mi ")], [item])
