import random

from llm_data import AWKWARD, awkward, empty, table

from gleaner.llm import langid
from gleaner.llm.queries import QUERIES


def prose(lang, chance, words):
    parts = {"en": "th er on ing the and tion wh ed".split(), "de": "sch ung ein ich der und keit ü ä".split()}[lang]
    return " ".join("".join(chance.choice(parts) for _ in range(chance.randrange(1, 4))) for _ in range(words))


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_learns_languages_and_rejects_narrow_margins(spark):
    chance = random.Random(1)
    train = [(i, prose(lang, chance, 120), lang) for i, lang in enumerate(["en", "de"] * 30)]
    model = langid.fit(frame_of(spark, train))
    tests = [(i, prose(lang, chance, chance.choice([6, 40, 3000])), lang) for i, lang in enumerate(["en", "de"] * 20)]
    got = {r["doc_id"]: r for r in langid.predict(frame_of(spark, tests), model).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in tests)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    mixed = frame_of(spark, [(1, "qqq", None), (2, "", None), (3, None, None), (4, "12 .. !", None)])
    rows = {r["doc_id"]: r for r in langid.predict(mixed, model).collect()}
    assert all(rows[i]["rejected"] for i in rows)
    assert [rows[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and rows[1]["lang_pred"] in ("en", "de")


def test_gibberish_and_unlearned_languages_are_rejected(spark):
    chance = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("lang IN ('en', 'de', 'fr')"))
    score = langid.Scorer(model)
    unlearned = [r["text"] for r in docs.where("lang = 'es' AND length(text) BETWEEN 200 AND 2000").collect()]
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(chance.choices(letters, k=chance.randrange(2, 10))) for _ in range(n // 6)) for n in (200, 600, 1200, 2000) * 25]
    for texts, share in ((unlearned, 0.8), (noise, 0.97)):
        assert sum(score(t)[3] for t in texts) >= share * len(texts) > 20
    learned = [r["text"] for r in docs.where("lang IN ('en', 'de', 'fr') AND length(text) BETWEEN 200 AND 2000").collect()]
    assert sum(score(t)[3] for t in learned) < 0.05 * len(learned)


def test_all_sampled_texts_are_learned_from_and_not_their_starts_only(spark):
    rows = [(i, " ".join(f"start{chr(97 + i % 26)}" for _ in range(600)) + " " + " ".join(chr(0x4E00 + i) * 3 for _ in range(600)), "en") for i in range(200)]
    data = langid.fit(frame_of(spark, rows)).dictionaries[0][1]
    assert 0.9 * 131_072 < len(data) <= 131_072 + 100
    marks = sum(chr(0x4E00 + i).encode() in data for i in range(200))
    assert marks > 60  # a third of each text's bytes and more, at places spread over it
    assert langid._shared_out([b"aa", b"b" * 90, b"c" * 90], 63).count(b"c") == langid._shared_out([b"aa", b"b" * 90, b"c" * 90], 63).count(b"b") == 29


def test_whole_text_counts(spark):
    chance = random.Random(3)
    model = langid.fit(frame_of(spark, [(i, prose(lang, chance, 100), lang) for i, lang in enumerate(["en", "de"] * 20)]))
    text = prose("en", chance, 900) + " " + prose("de", chance, 9000)
    assert langid.predict(frame_of(spark, [(1, text, None)]), model).first()["lang_pred"] == "de"


def test_awkward_rows(spark):
    frame = awkward(spark)
    model = langid.fit(frame)
    rows = langid.predict(frame, model, keep=("doc_id", "node")).collect()
    assert len(rows) == frame.count()
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    assert langid.predict(empty(spark), model).collect() == []
    nothing = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(frame, nothing).collect()} == {"und"}
    assert len(AWKWARD) < len(rows)


def test_repeated_rows_and_ties_are_stable(spark):
    frame = table(spark, ["zzz", "zzz", "same text here", "same text here"])
    model = langid.fit(frame)
    rows = [tuple(r)[1:] for r in langid.predict(frame, model).orderBy("doc_id").collect()]
    assert rows[0] == rows[1] and rows[2] == rows[3]


def test_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language_id"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)
