import random

from llm_data import awkward, empty, sentence, table

from gleaner.llm import decontaminate
from gleaner.llm.decontaminate import Matcher, Settings, normal


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_distances_equal_dynamic_programming():
    chance = random.Random(2)
    for _ in range(500):
        item = "".join(chance.choice("abcd ") for _ in range(chance.randrange(1, 60)))
        text = "".join(chance.choice("abcd ") for _ in range(chance.randrange(0, 90)))
        if chance.random() < 0.7:
            copy = list(item)
            for _ in range(chance.randrange(0, 8)):
                copy[chance.randrange(len(copy))] = chance.choice(["", "e", "ab"])
            text = text[:20] + "".join(copy) + text[20:]
        if not normal(item):
            continue
        distance, budget = least_distance(normal(item), normal(text)), int(0.15 * len(normal(item)))
        want = [{"item_id": 1, "distance": distance}] if distance <= budget and normal(text) else []
        assert Matcher([(1, item)], 0.15)(text) == want


def test_awkward_rows_items_and_blocks(spark):
    chance = random.Random(4)
    frame = awkward(spark)
    docs = [r["text"] for r in frame.collect()]
    long_text = max((d for d in docs if d), key=len)
    items = [(0, None), (1, ""), (2, " \n"), (3, docs[20][:60]), (4, long_text[5000:5300].upper()), (4, "other text of four"), (5, sentence(chance, 30, 10**6)), (None, docs[21]), (3, docs[20][:60])]
    tests = spark.createDataFrame(items, "item_id int, text string")
    whole = decontaminate.match(frame, tests, keep=("doc_id", "score"))
    blocks = decontaminate.match(frame, tests, keep=("doc_id", "score"), settings=Settings(block_bytes=40))

    def plain(x):
        return sorted(((r["doc_id"], r["score"], sorted(map(str, r["leaks"]))) for r in x.collect()), key=str)

    assert plain(whole) == plain(blocks)
    by_text = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in whole.collect()}
    assert 3 in by_text[20] and 4 in by_text[max(i for i in by_text if i is not None and docs[i] == long_text)]
    assert not any(5 in x or 0 in x for x in by_text.values())
    assert decontaminate.match(empty(spark), tests).collect() == []
    assert {str(r["leaks"]) for r in decontaminate.match(frame, tests.limit(0)).collect()} == {"[]"}


def test_edited_passage_is_found_and_clean_text_left(spark):
    chance = random.Random(8)
    item = sentence(chance, 40, 10**6)
    words = item.split()
    words[7] = "zzz"
    docs = [f"{sentence(chance, 50)} {' '.join(words)}\n{sentence(chance, 50)}", sentence(chance, 200), item[: len(item) // 2]]
    tests = spark.createDataFrame([(9, item)], "item_id int, text string")
    assert [len(r["leaks"]) for r in decontaminate.match(table(spark, docs), tests).orderBy("doc_id").collect()] == [1, 0, 0]
