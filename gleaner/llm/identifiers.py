"""Personal identifiers by fixed rules and bootstrapped contexts, in DataFrame functions only.

One pass over the texts finds the base spans of every kind and all tokens that hold a digit, each
with its lexical context, the words around it.  Base spans are seeds.  Contexts are patterns:
the two words before, and the word before with the word after.  The graph of patterns and
instances (distinct values) is scored in rounds: a pattern's score for a kind is the sum of its known
instances' confidence over the number of its instances plus one; an unknown instance's
confidence is one minus the product of what the trusted patterns around it leave open.
Instances above ``accept`` count as known in the next round, so that they bring up new patterns.
At the end a token is a found identifier where its value is accepted and a trusted pattern for
that kind surrounds it.

Sums over the graph are partial aggregates of distinct edges: neither a frequent context nor
a value in thousands of copies is gathered, and copies don't raise a score.  Texts stay in the
first pass; what is shuffled later are the matches.  Spans are put together per row.

Patterns are matched left to right without retries of a failed start inside a run (possessive
runs behind a look-behind), so a long run of letters or digits takes linear time.

Defined cases: a null text is an empty one and has no spans; offsets count code points; texts
of any length are searched whole; equal rows each get their own result and teach nothing
twice; a base span glued to letters or digits is reported but is no seed; tokens over a base
span are no candidates; words of a context are cut to ``reach`` characters; an instance open
to two kinds takes the likelier, then the first in order; null keys stay; an empty table gives an
empty table; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.binding import let
from gleaner.llm.scan import stored

BLANKS = " \t\n\x0b\x0c\r"
# Kinds in their order, with the forms they must have.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
# A token ends at blanks and at the signs around values; it holds a digit.
_BORDER = r"\x20\x09-\x0D=:\x22'()\[\]{}<>,;"
TOKEN = rf"(?<![^{_BORDER}])[^{_BORDER}0-9]*+[0-9][^{_BORDER}]*+"
CANDIDATE = len(KINDS)


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    support: float = 3.0  # least sum of confidence of a trusted pattern's instances
    trust: float = 0.6  # least score of a trusted pattern
    accept: float = 0.7  # least confidence of an instance
    reach: int = 40  # characters of context on each side


def luhn(digits: Column) -> Column:
    """Whether the check digit of a short run of digits is right."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"))

    def add(a: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((a["i"] + 1).alias("i"), (a["sum"] + F.when(a["i"] % 2 == 1, twice).otherwise(d)).alias("sum"))

    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda a: a["sum"] % 10 == 0)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "email":
        return F.lit(True)
    least, most = (16, 19) if kind == "card" else (8, 15)
    digits = F.regexp_replace(match, "[^0-9]", "")
    fits = F.length(digits).between(least, most)
    return F.when(fits, let(digits, luhn) if kind == "card" else F.lit(True)).otherwise(False)


def _words(text: Column) -> Column:
    flat = F.btrim(F.regexp_replace(F.lower(text), "[0-9]+", "0"), F.lit(BLANKS))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, r"[\x20\x09-\x0D]+"))


def _patterns(left: Column, right: Column) -> Column:
    """Contexts of a place: two words before it, and one on each side."""
    before, after = F.try_element_at(_words(left), F.lit(-1)), F.get(_words(right), F.lit(0))
    two = F.when(F.size(_words(left)) > 1, F.concat(F.lit("L "), F.try_element_at(_words(left), F.lit(-2)), F.lit(" "), before))
    both = F.when(before.isNotNull() & after.isNotNull(), F.concat(F.lit("B "), before, F.lit(" "), after))
    return F.array_compact(F.array(two, both))


def _matches(text: Column, kind: str, number: int, pattern: str, reach: int) -> Column:
    """Matches of one kind in order, each with the length of the text since the last one."""

    def rows(found: Column, gaps: Column) -> Column:
        def row(match: Column, i: Column) -> Column:
            gap, next_gap = F.get(gaps, i), F.get(gaps, i + 1)
            last = F.when(i > 0, F.substring(F.get(found, i - 1), -reach, reach)).otherwise("")
            left = F.concat(last, F.substring(gap, -reach, reach))
            right = F.concat(F.substring(next_gap, 1, reach), F.coalesce(F.substring(F.get(found, i + 1), 1, reach), F.lit("")))
            value = F.rtrim(match, F.lit(".!?")) if number == CANDIDATE else match
            ok = F.lit(True) if number == CANDIDATE else _valid(kind, match)
            left, right = F.substring(left, -reach, reach), F.substring(F.concat(F.substring(match, F.length(value) + 1, F.lit(reach)), right), 1, reach)
            glued = F.lit(False) if number == CANDIDATE else left.rlike("[A-Za-z0-9]$") | right.rlike("^[A-Za-z0-9]")
            return F.struct(
                F.lit(number).alias("kind"), i.alias("i"), F.char_length(gap).cast("long").alias("gap"),
                F.char_length(match).cast("long").alias("whole"), F.char_length(value).cast("long").alias("size"), ok.alias("valid"),
                F.when(ok, F.lower(value)).alias("value"), F.when(ok & ~glued, _patterns(left, right)).alias("patterns"),
            )

        return F.transform(found, row)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.transform(F.array().cast("array<string>"), lambda m: F.lit(None))
    return let(found, lambda f: F.when(F.size(f) > 0, let(F.split(text, pattern, -1), lambda gaps: rows(f, gaps))).otherwise(none))


def scan(frame: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """``_row``, ``_key`` and ``_found``, all matches of every kind, for each row; written."""
    value = F.coalesce(F.col(text), F.lit(""))
    parts = [_matches(value, k, i, p, s.reach) for i, (k, p) in enumerate([*KINDS.items(), ("", TOKEN)])]
    out = frame.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.concat(*parts).alias("_found"))
    return stored(out)


def mentions(scanned: DataFrame) -> DataFrame:
    """One row a base span or candidate token: ``_row, kind, start, end, value, patterns``."""
    rows = scanned.select("_row", F.explode("_found").alias("m")).select("_row", "m.*").repartition("_row")
    upto = F.sum(F.col("gap") + F.col("whole")).over(Window.partitionBy("_row", "kind").orderBy("i")) - F.col("whole")
    rows = rows.withColumn("start", upto).where("valid").withColumn("end", F.col("start") + F.col("size"))
    order, back = (Window.partitionBy("_row").orderBy(*[f(c) for c in ("start", "kind", "i")]) for f in (F.asc, F.desc))
    base = F.col("kind") < CANDIDATE
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    apart = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end"))
    rows = rows.withColumns({"_before": before, "_after": after}).where(base | apart)
    return stored(rows.select("_row", "kind", "start", "end", "value", "patterns"))


def learn(found: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (``pattern, kind, score``) and accepted values (``value, kind, confidence``)."""
    edges = found.select(F.explode("patterns").alias("pattern"), "kind", "value").distinct()
    edges = stored(edges)
    sums = [F.count_if(F.col("kind") == k).cast("double").alias(f"k{k}") for k in range(CANDIDATE)]
    totals = stored(edges.groupBy("pattern").agg(F.count("*").alias("n"), *sums))
    unknown = edges.where(F.col("kind") == CANDIDATE).select("pattern", "value")
    accepted: DataFrame | None = None
    for _ in range(s.rounds):
        seeded = F.filter(
            F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("known")) for k in range(CANDIDATE)]), lambda x: x["known"] > 0
        )
        known = totals.select("pattern", F.explode(seeded).alias("x")).select("pattern", "x.*")
        if accepted is not None:
            more = unknown.join(accepted, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("known"))
            known = known.unionByName(more).groupBy("pattern", "kind").agg(F.sum("known").alias("known"))
        known = known.where(F.col("known") >= s.support).join(totals.select("pattern", "n"), "pattern")
        known = known.withColumn("score", F.col("known") / (F.col("n") + 1))
        trusted = stored(known.where(F.col("score") >= s.trust).select("pattern", "kind", "score"))
        open_ = unknown.join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("confidence"))
        best = open_.where(F.col("confidence") >= s.accept).groupBy("value")
        likelier = F.struct(F.col("confidence"), -F.col("kind"))
        accepted = stored(best.agg(F.max_by("kind", likelier).alias("kind"), F.max("confidence").alias("confidence")))
    return trusted, accepted


def find(frame: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """Per row its key, a count of base spans a kind, and ``base`` and ``spans``: (kind, start, end) in order."""
    s = settings or Settings()
    scanned = scan(frame, key, text, s)
    found = mentions(scanned)
    trusted, accepted = learn(found, s)
    value = accepted.select("value", F.col("kind").alias("as"))
    new = found.where(F.col("kind") == CANDIDATE).join(value, "value").select("_row", "start", "end", "as", F.explode("patterns").alias("pattern"))
    new = new.join(trusted.select("pattern", F.col("kind").alias("as")), ["pattern", "as"]).select("_row", F.col("as").alias("kind"), "start", "end").distinct()
    base = found.where(F.col("kind") < CANDIDATE).select("_row", "kind", "start", "end")
    every = base.withColumn("base", F.lit(True)).unionByName(new.withColumn("base", F.lit(False)))
    lists = every.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("_spans"))
    out = scanned.select("_row", "_key").join(lists, "_row", "left")
    spans = F.coalesce("_spans", F.array().cast("array<struct<kind: int, start: bigint, end: bigint, base: boolean>>"))
    out = out.select(F.col("_key").alias(key), spans.alias("_spans"))
    of_base = F.filter("_spans", lambda x: x["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter(of_base, lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(key, *counts, named(of_base).alias("base"), named(F.col("_spans")).alias("spans"))


def named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(spans, lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
