"""Number, term, currency and rate normalizers as pure column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.binding import let
from gleaner.functions.text import strip

# Words removed from amounts, currency codes and their aliases,
# and the days counted per month and year.
NOISE_WORDS = ("процента", "процентов", "годовых", "%")
CURRENCIES = ("BYN", "USD", "EUR", "RUB", "CNY")
CURRENCY_ALIASES = {
    "BR": "BYN",
    "БЕЛ. РУБ.": "BYN",
    "BYR": "BYN",
    "$": "USD",
    "€": "EUR",
    "₽": "RUB",
}
DAYS_PER_MONTH = 30
DAYS_PER_YEAR = 365

_AMOUNT = r"[-+]?[0-9]+(?:[\s.,][0-9]+)*"


def parse_decimal(value: Column) -> Column:
    """First amount in a text; malformed amounts give null instead of failing."""
    text = F.lower(strip(value.cast("string")))
    text = F.translate(text, "\u00a0", " ")
    text = reduce(lambda acc, word: F.replace(acc, F.lit(word), F.lit("")), NOISE_WORDS, text)
    amount = F.replace(F.regexp_extract(text, _AMOUNT, 0), F.lit(" "), F.lit(""))
    return let(amount, _plain_amount).try_cast("decimal(38,10)")


def _plain_amount(amount: Column) -> Column:
    """Of two kinds of separators the last one is the decimal mark."""
    both = amount.contains(",") & amount.contains(".")
    comma_last = F.instr(F.reverse(amount), ",") < F.instr(F.reverse(amount), ".")
    return (
        F.when(both & comma_last, F.translate(F.translate(amount, ".", ""), ",", "."))
        .when(both, F.translate(amount, ",", ""))
        .otherwise(F.translate(amount, ",", "."))
    )


def parse_double(value: Column) -> Column:
    return parse_decimal(value).cast("double")


def parse_integer(value: Column) -> Column:
    """Truncates toward zero."""
    return parse_decimal(value).try_cast("bigint")


def number_error(value: Column) -> Column:
    """Code for a text that holds digits but no readable amount."""
    has_digits = value.cast("string").rlike("[0-9]")
    return F.when(has_digits & parse_decimal(value).isNull(), F.lit("NUMBER_MALFORMED"))


def parse_term(value: Column, days_per_month: int = DAYS_PER_MONTH, days_per_year: int = DAYS_PER_YEAR) -> Column:
    """Struct ``(term_original, term_min_days, term_max_days)``."""
    text = F.translate(F.lower(strip(value)), "–—", "--")
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda n: n.try_cast("bigint")
    )
    bound = F.struct(value.alias("raw"), text.alias("text"), numbers.alias("numbers"))
    return let(bound, lambda b: _term(b["raw"], b["text"], b["numbers"], days_per_month, days_per_year))


def _term(value: Column, text: Column, numbers: Column, days_per_month: int, days_per_year: int) -> Column:
    unit = (
        F.when(text.contains("год") | text.contains("лет"), F.lit(days_per_year))
        .when(text.contains("мес"), F.lit(days_per_month))
        .otherwise(F.lit(1))
        .cast("bigint")
    )
    first = F.get(numbers, F.lit(0)) * unit
    second = F.get(numbers, F.lit(1)) * unit
    none = F.lit(None).cast("bigint")
    up_to = text.contains("до ")
    at_least = text.contains("свыше") | text.contains("от ")
    several = F.size(numbers) >= 2
    empty = F.size(numbers) == 0
    low = F.when(empty, none).when(up_to, F.lit(0).cast("bigint")).otherwise(first)
    high = F.when(empty, none).when(up_to, first).when(at_least, none).when(several, second).otherwise(first)
    return F.struct(value.alias("term_original"), low.alias("term_min_days"), high.alias("term_max_days"))


def parse_currency(value: Column) -> Column:
    text = strip(F.upper(value))
    result = F.when(text.isin(*CURRENCIES), text)
    for alias, code in CURRENCY_ALIASES.items():
        result = result.when(text == alias, F.lit(code))
    return result


def parse_rate(value: Column) -> Column:
    """Struct ``(rate_type, rate_value, rate_formula, spread_pp)``."""
    return let(strip(value), _rate)


def _rate(text: Column) -> Column:
    lower = F.lower(text)
    individual = lower.contains("индивидуал") | lower.contains("соглашению")
    benchmark = lower.contains("ср") | lower.contains("рефинанс")
    tail = F.when(text.contains("+"), F.substring_index(text, "+", -1)).otherwise(
        F.substring_index(text, "минус", -1)
    )
    spread = parse_double(tail) * F.when(lower.contains("минус"), F.lit(-1.0)).otherwise(F.lit(1.0))
    flags = F.struct(
        individual.alias("individual"), benchmark.alias("benchmark"), spread.alias("spread"), parse_double(text).alias("number")
    )
    return let(flags, lambda f: _rate_struct(text, f["individual"], f["benchmark"], f["spread"], f["number"]))


def _rate_struct(text: Column, individual: Column, benchmark: Column, spread: Column, number: Column) -> Column:
    kind = (
        F.when(individual, F.lit("INDIVIDUAL"))
        .when(benchmark, F.lit("BENCHMARK_SPREAD"))
        .when(number.isNotNull(), F.lit("FIXED"))
        .otherwise(F.lit("NOT_PUBLISHED"))
    )
    fixed = ~individual & ~benchmark & number.isNotNull()
    return F.struct(
        kind.alias("rate_type"),
        F.when(fixed, number).alias("rate_value"),
        F.when(~fixed, text).alias("rate_formula"),
        F.when(~individual & benchmark, spread).alias("spread_pp"),
    )
