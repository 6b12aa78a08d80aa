import hashlib
import random
import re
from collections import defaultdict

import pytest
from llm_data import awkward, empty, table
from pyspark.sql import functions as F

from gleaner.llm import identifiers
from gleaner.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = re.compile(r"[^\x20\x09-\x0D=:\"'()\[\]{}<>,;]+")
ODD = [
    "a@b.c_x@y.z a@b@c.d x@y @ a@b. q@w.e.r-t._%+-@a.b",
    "1.2.3.4.5.6.7.8 1.2.3.400 01.002.0003.4 1.2.3 99999999999999999999.1.1.1 .1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 4 1 4111  1111 4222222222222222220",
    "+1 (499) 555-6503 +12 ()-- 7 +1234567 +1-2345678-) +44 20 7946 0958. ++4912345678",
    "é😀 mail é.a@b.de 😀+1 499 5556503 ü10.0.0.1",
    "d64111111111111111cf k4111111111111111",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def base(text):
    text = text or ""
    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m.group())] for k, p in PATTERNS.items()}


def words(text):
    return re.sub("[0-9]+", "0", text.lower()).encode().split()


def contexts(text, start, end, reach=40):
    left, right = words(text[max(start - reach, 0) : start]), words(text[end : end + reach])
    out = [("L", left[-2], left[-1])] if len(left) > 1 else []
    return out + ([("B", left[-1], right[0])] if left and right else [])


def brute(texts, s=identifiers.Settings()):  # noqa: B008
    """Base spans and learned spans of each text, with plain dictionaries."""
    found, places, edges = [], [], defaultdict(set)
    for n, text in enumerate(texts):
        text = text or ""
        spans = base(text)
        found.append([(k, a, b) for k in PATTERNS for a, b in spans[k]])
        for kind, a, b in found[-1]:
            if not re.search("[A-Za-z0-9]$", text[max(a - 1, 0) : a]) and not re.match("[A-Za-z0-9]", text[b : b + 1]):
                for c in contexts(text, a, b):
                    edges[c].add((kind, text[a:b].lower()))
        for m in TOKEN.finditer(text):
            value = m.group().rstrip(".!?")
            a, b = m.start(), m.start() + len(value)
            if re.search("[0-9]", value) and not any(x < b and y > a for _, x, y in found[-1]):
                places.append((n, a, b, value.lower(), contexts(text, a, b)))
                for c in places[-1][-1]:
                    edges[c].add((None, value.lower()))
    accepted = {}
    for _ in range(s.rounds):
        trusted = defaultdict(dict)
        for c, members in edges.items():
            known = defaultdict(float)
            for kind, value in members:
                if kind:
                    known[kind] += 1
                elif value in accepted:
                    known[accepted[value][0]] += accepted[value][1]
            for kind, k in known.items():
                if k >= s.support and k / (len(members) + 1) >= s.trust:
                    trusted[c][kind] = k / (len(members) + 1)
        left = defaultdict(lambda: 1.0)
        for c, scores in trusted.items():
            for kind, value in edges[c]:
                for k, score in scores.items():
                    if kind is None:
                        left[value, k] *= 1 - score
        accepted = {}
        for (value, kind), rest in left.items():
            if 1 - rest >= s.accept and (value not in accepted or 1 - rest > accepted[value][1]):
                accepted[value] = (kind, 1 - rest)
    new = defaultdict(set)
    for n, a, b, value, around in places:
        if value in accepted and any(accepted[value][0] in trusted.get(c, {}) for c in around):
            new[n].add((accepted[value][0], a, b))
    order = list(PATTERNS)
    return [(f, sorted([*f, *new[n]], key=lambda x: (order.index(x[0]), *x[1:]))) for n, f in enumerate(found)]


def check(frame, s=None):
    rows = frame.collect()
    want = [
        (str(r["doc_id"]), *[sum(x[0] == k for x in b) for k in PATTERNS], b, every)
        for r, (b, every) in zip(rows, brute([r["text"] for r in rows], s or identifiers.Settings()), strict=True)
    ]
    got = [
        (str(r["doc_id"]), *r[1:5], [tuple(x) for x in r["base"]], [tuple(x) for x in r["spans"]]) for r in identifiers.find(frame, settings=s).collect()
    ]
    assert sorted(got) == sorted(want)
    return got


def taught():
    """Phones and mail addresses behind known words, and others in forms that no rule has."""
    chance = random.Random(3)
    pick = lambda: " ".join(chance.choice(["the", "of", "blue", "tree", "stone", "wave"]) for _ in range(4))
    out = [f"{pick()} please call +1 ({200 + i}) 555-{1000 + i} today {pick()}" for i in range(12)]
    out += [f"{pick()} please call 555-77{i}0 today {pick()}" for i in range(5)]
    out += [f"{pick()} ring me under 555-77{i}0 or {pick()}" for i in range(5)] + [f"{pick()} ring me under 555-8801 or {pick()}"]
    out += [f"{pick()} mail: user{i}@example.com, {pick()}" for i in range(6)] + [f"{pick()} in {1990 + i} {pick()}" for i in range(9)]
    return out


def test_learns_forms_without_a_rule(spark):
    got = check(table(spark, taught()))
    found = {r[0]: r[-1] for r in got}
    assert all(found[str(i)][0][0] == "phone" for i in range(23))
    assert not any(found[str(i)] for i in range(29, 38))


def test_awkward_and_odd_rows(spark):
    frame = awkward(spark)
    check(frame)
    check(table(spark, [*ODD, *ODD, *taught(), *long_runs(1000)]))
    assert identifiers.find(empty(spark)).collect() == []


def long_runs(n):
    return ["x" * n + "@", "1" * n, "1." * n, "a@b" + ".c" * n, "+1 " + "2 (" * n]


def test_long_runs_take_linear_time(spark):
    found = identifiers.find(table(spark, long_runs(200_000))).collect()
    assert sorted(sum(r[1:5]) for r in found) == [0, 0, 0, 1, 50_000]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = []
    for r, (b, every) in zip(rows, brute([r["text"] for r in rows]), strict=True):
        text, all_text = (",".join(":".join(map(str, x)) for x in spans) for spans in (b, every))
        want.append((r["doc_id"], *[sum(x[0] == k for x in b) for k in PATTERNS], hashlib.sha256(text.encode()).hexdigest(), all_text))
    assert sorted(map(tuple, QUERIES["op13_identifiers"](spark, folder).collect())) == sorted(want)


def test_plan_has_no_python(spark):
    plan = identifiers.find(table(spark, taught()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("copies", [1, 40])
def test_copies_teach_nothing_twice(spark, copies):
    texts = ["please call +1 (200) 555-1000 today", "please call 555-7700 today"] * copies
    assert not any(len(r["spans"]) > len(r["base"]) for r in identifiers.find(table(spark, texts).select("doc_id", F.col("text"))).collect())
