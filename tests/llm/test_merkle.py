import hashlib
import zlib

import pytest
from llm_data import awkward, empty, table
from pyspark.sql import functions as F

from gleaner.llm import merkle
from gleaner.llm.queries import QUERIES

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Levels from the leaves to the last node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, at):
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        yield "".join(run[: at % 8]), "".join(run[at % 8 + 1 :])
        at //= 8


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf([r[c] for c in COLUMNS]), r))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: tree([x[2] for x in sorted(groups[n], key=lambda x: x[:3])]) for n in names}
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for at, (_, _, mine, r) in enumerate(sorted(groups[name], key=lambda x: x[:3])):
            path = [*steps(trees[name], at), *steps(top, place)]
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf([r["doc_id"], r["source"], r["lang"], r["n_chars"], text])
            for before, after in path:
                node = h(before + node + after)
            out.append((str(r["doc_id"]), mine, trees[name][-1][0], top[-1][0], h("".join(b + a for b, a in path)), node, node == top[-1][0]))
    return sorted(out)


def audited(frame):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.audit(frame, COLUMNS, "lang", "doc_id", {"text": merkle.lowered(F.col("text"))}, hit)
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


def test_awkward_rows(spark):
    frame = awkward(spark)
    assert audited(frame) == brute(frame.collect())
    assert audited(empty(spark)) == []


@pytest.mark.parametrize("rows", [1, 9, 65])
def test_sizes(spark, rows):
    frame = table(spark, [f"Text {i}" for i in range(rows)]).withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "x"))
    assert audited(frame) == brute(frame.collect())


def test_many_groups(spark):
    frame = table(spark, [f"Text {i}" for i in range(200)]).withColumn("lang", (F.col("doc_id") % 70).cast("string"))
    assert audited(frame) == brute(frame.collect())


def test_query_is_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_merkle_manifest"](spark, folder)
    rows = sorted((str(r[0]), *r[1:]) for r in got.collect())
    assert rows == brute(spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert {r[-1] for r in rows} == {True, False}
