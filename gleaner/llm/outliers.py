"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base statistics of every text come from column functions.  Their logarithms make a vector;
per language and source its centre and scatter are minimum-covariance-determinant estimates:
starting from medians and median deviations, the ``share`` of rows nearest to the centre give the
next mean and covariance, for a few concentration steps, each of which lowers the determinant.
Rows whose squared Mahalanobis distance to their group's estimate is above ``cutoff`` are
rejected.

Medians and the nearest share are read off histograms of fixed-width bins: counts by group and
bin, so a group with a third of all rows is summed in every task and no group is gathered.
Bins of one group are few whatever the number of rows.  Rows meet their group's estimate by a
join that Spark broadcasts or splits by size.

Variances have a floor, so that a statistic which is the same in most rows doesn't reject the
others, and groups of few rows, down to one, have an estimate.  Scatter is scaled to make the
median distance that of a normal vector.

Defined cases: null, empty and blank texts have no words and fail the base rule; null
languages and sources are groups like others; windows are told apart by 64-bit hashes inside
one text; repeated rows each get the result of their text; an empty table gives an empty
table; the statistics use only the named columns, so others don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.binding import let
from gleaner.llm.scan import stored

BLANKS = " \t\n\x0b\x0c\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMENSIONS = 5


@dataclass(frozen=True)
class Settings:
    window: int = 5  # words
    least_words: int = 10
    most_repeat: int = 20  # percent of words in repeated windows
    share: float = 0.75  # of a group's rows that its estimate is made of
    steps: int = 4
    bin: float = 0.01
    cutoff: float = 30.0
    floors: tuple[float, ...] = (0.3, 0.1, 0.5, 0.5, 0.5)  # least standard deviations
    middle: float = 4.351  # median of the chi-square distribution with 5 degrees of freedom


def _repeated(words: Column, size: int) -> Column:
    """Words in windows that the text has more than once."""

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            def same(x: Column, i: Column) -> Column:
                before, after = (F.coalesce(F.get(p, i + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1))
                return before | after

            return F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"]))

        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            let(pairs, places),
            start,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    found = let(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) >= size, found).otherwise(0)


def statistics(frame: DataFrame, text: str, keep: list[Column], s: Settings) -> DataFrame:
    """``keep`` and the five base statistics of each row."""
    value = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(value, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w, s.window).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.char_length(F.regexp_replace(value, r"[^#*$%&|<>]+", "")).cast("long")
    found = frame.select(*keep, of_words.alias("_w"), dup_lines.alias("n_dup_lines"), symbols.alias("n_symbols"))
    names = [c for c in found.columns if c not in ("_w", "n_dup_lines", "n_symbols")]
    return found.select(*names, "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")


def vector() -> list[Column]:
    """Logarithms of length, word length, symbol rate, repeat rate and repeated lines."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(words),
        F.log(chars / words),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(100 * F.col("n_repeat_words") / words),
        F.log1p("n_dup_lines"),
    ]


def _quantile(rows: DataFrame, keys: list[str], value: str, share: float, width: float, name: str) -> DataFrame:
    """Upper border of the bin in which a group's ``share`` of values is reached."""
    counts = rows.groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    running = F.sum("n").over(by.orderBy("bin"))
    reached = counts.select(*keys, "bin", running.alias("upto"), F.sum("n").over(by).alias("all"))
    return reached.where(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(((F.min("bin") + 1) * width).alias(name))


def _middle(rows: DataFrame, width: float, name: str) -> DataFrame:
    """Medians of the values ``x0`` … of each group, one row a group."""
    long = rows.select("group", F.posexplode(F.array(*[f"x{i}" for i in range(DIMENSIONS)])).alias("d", "x"))
    found = _quantile(long, ["group", "d"], "x", 0.5, width, "m")
    return found.groupBy("group").agg(*[F.max(F.when(F.col("d") == i, F.col("m"))).alias(f"{name}{i}") for i in range(DIMENSIONS)])


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution with the estimate's triangle."""
    out = rows.join(estimate, "group")
    solved: list[str] = []
    for i in range(DIMENSIONS):
        rest = F.col(f"x{i}") - F.col(f"c{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(solved[j])
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
        solved.append(f"y{i}")
    total = sum((F.col(y) * F.col(y) for y in solved[1:]), F.col(solved[0]) * F.col(solved[0]))
    return out.select(*rows.columns, (total / F.col("scale")).alias("distance"))


def _triangle(moments: DataFrame, s: Settings) -> DataFrame:
    """Means and the Cholesky factor of the floored covariance, from sums around ``o``."""
    out = moments
    for i in range(DIMENSIONS):
        out = out.withColumn(f"c{i}", F.col(f"o{i}") + F.col(f"s{i}") / F.col("n"))
    for i in range(DIMENSIONS):
        for j in range(i + 1):
            cell = F.col(f"s{i}_{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("n") * F.col("n"))
            if i == j:
                cell = cell + s.floors[i] ** 2
            for k in range(j):
                cell = cell - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            cell = F.sqrt(F.greatest(cell, F.lit(1e-9))) if i == j else cell / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", cell)
    triangle = [f"l{i}{j}" for i in range(DIMENSIONS) for j in range(i + 1)]
    return out.select("group", *[f"c{i}" for i in range(DIMENSIONS)], *triangle, F.lit(1.0).alias("scale"))


def estimate(rows: DataFrame, s: Settings) -> DataFrame:
    """One row a ``group``: centre ``c``, triangle ``l`` and ``scale`` of the values ``x0`` …"""
    x = [f"x{i}" for i in range(DIMENSIONS)]
    centre = stored(_middle(rows, s.bin, "c"))
    spread = rows.join(centre, "group").select("group", *[F.abs(F.col(f"x{i}") - F.col(f"c{i}")).alias(f"x{i}") for i in range(DIMENSIONS)])
    diagonal = {f"l{i}{i}": F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + s.floors[i] ** 2) for i in range(DIMENSIONS)}
    flat = {f"l{i}{j}": F.lit(0.0) for i in range(DIMENSIONS) for j in range(i)}
    current = stored(centre.join(_middle(spread, s.bin, "d"), "group").withColumns({**diagonal, **flat, "scale": F.lit(1.0)}))
    origin = centre.select("group", *[F.col(f"c{i}").alias(f"o{i}") for i in range(DIMENSIONS)])
    for _ in range(s.steps):
        near = _distance(rows.select("group", *x), current).withColumn("log", F.log(F.col("distance") + 1e-6))
        limit = stored(_quantile(near, ["group"], "log", s.share, s.bin, "limit"))
        chosen = near.join(limit, "group").where("log < limit").join(origin, "group")
        z = [F.col(f"x{i}") - F.col(f"o{i}") for i in range(DIMENSIONS)]
        sums = [F.sum(z[i]).alias(f"s{i}") for i in range(DIMENSIONS)]
        sums += [F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i in range(DIMENSIONS) for j in range(i + 1)]
        moments = chosen.groupBy("group").agg(F.count("*").cast("double").alias("n"), *sums)
        current = stored(_triangle(moments.join(origin, "group"), s))
    # The nearest rows understate the scatter: scale it by the median distance of all rows.
    near = _distance(rows.select("group", *x), current).withColumn("log", F.log(F.col("distance") + 1e-6))
    half = _quantile(near, ["group"], "log", 0.5, s.bin, "half")
    wider = F.greatest(F.exp("half") / s.middle, F.lit(1.0))
    return stored(current.drop("scale").join(half, "group").withColumn("scale", wider).drop("half"))


def judge(
    frame: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source"), settings: Settings | None = None
) -> DataFrame:
    """Per row: key, base statistics, ``base_failed``, ``distance`` and ``kept``."""
    s = settings or Settings()
    # Nulls are a group of their own, apart from the text "null".
    group = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(by)])).alias("group")
    found = stored(statistics(frame, text, [F.col(key).alias("_key"), group], s))
    failed = (F.col("n_words") < s.least_words) | (100 * F.col("n_repeat_words") > s.most_repeat * F.col("n_words"))
    rows = found.withColumns({**{f"x{i}": v for i, v in enumerate(vector())}, "base_failed": failed})
    sound = rows.where("NOT base_failed")
    judged = _distance(sound, estimate(sound, s))
    out = judged.unionByName(rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")))
    kept = (~F.col("base_failed")) & F.coalesce(F.col("distance") <= s.cutoff, F.lit(False))
    return out.select(F.col("_key").alias(key), *BASE, "base_failed", kept.alias("kept"), "distance")
