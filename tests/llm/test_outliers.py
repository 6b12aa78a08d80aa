import numpy as np
from llm_data import awkward, empty, table

from gleaner.llm import outliers


def base(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    chars = len(b"".join(words).decode())
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def quantile(values, share, width):
    """Upper border of the bin that reaches the share, as documented."""
    bins = np.sort(np.floor(np.asarray(values) / width))
    return (bins[int(np.ceil(share * len(bins) - 1e-9)) - 1] + 1) * width


def distances(x, s):
    """The same estimate with numpy: nearest share, means and floored covariances."""
    floors = np.array(s.floors) ** 2
    middle = np.array([quantile(c, 0.5, s.bin) for c in x.T])
    spread = np.array([quantile(c, 0.5, s.bin) for c in np.abs(x - middle).T])
    d = (((x - middle) ** 2) / ((1.4826 * spread) ** 2 + floors)).sum(axis=1)
    for _ in range(s.steps):
        log = np.log(d + 1e-6)
        near = x[log < quantile(log, s.share, s.bin)]
        centre = near.mean(axis=0)
        cov = np.cov(near.T, bias=True) + np.diag(floors)
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    scale = max(np.exp(quantile(np.log(d + 1e-6), 0.5, s.bin)) / s.middle, 1.0)
    return d / scale


def vector(b):
    n, chars, symbols, lines, repeat, _ = b
    n, chars = max(n, 1), max(chars, 1)
    return [np.log(n), np.log(chars / n), np.log1p(100 * symbols / chars), np.log1p(100 * repeat / n), np.log1p(lines)]


def check(frame, s=outliers.Settings()):  # noqa: B008
    rows = frame.collect()
    bases = [base(r["text"]) for r in rows]
    groups = {}
    for i, (r, b) in enumerate(zip(rows, bases, strict=True)):
        if not b[-1]:
            groups.setdefault((r["lang"], r["source"]), []).append(i)
    want = {}
    for members in groups.values():
        for i, d in zip(members, distances(np.array([vector(bases[i]) for i in members]), s), strict=True):
            want[i] = d
    expected = sorted((str(r["doc_id"]), *b, not b[-1] and want[i] <= s.cutoff, round(want.get(i, -1), 4)) for i, (r, b) in enumerate(zip(rows, bases, strict=True)))
    got = sorted(
        (str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], round(-1 if r["distance"] is None else r["distance"], 4))
        for r in outliers.judge(frame).collect()
    )
    assert [g[:-1] for g in got] == [e[:-1] for e in expected]
    assert np.allclose([g[-1] for g in got], [e[-1] for e in expected], rtol=1e-3, atol=1e-3)


def test_awkward_rows(spark):
    check(awkward(spark))
    assert outliers.judge(empty(spark)).collect() == []


def test_repeated_windows_overlap_and_lines(spark):
    texts = ["a b c d e a b c d e f", "x " * 40, "l1 a\n\n l1 a\nl1 a\n\tl1 a", "a b c d e f g h i j\na b c d e", "# * | < > $ % & q r s t"]
    check(table(spark, texts))


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_plan_has_no_python(spark):
    frame = outliers.judge(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert "Python" not in frame._jdf.queryExecution().toString() and "Arrow" not in frame._jdf.queryExecution().toString()
