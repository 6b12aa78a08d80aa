from pyspark.sql import functions as F

from gleaner.functions import dates, numbers, text, urls


def one(spark, value, build):
    row = spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("r")).first()
    return row["r"]


def test_numbers(spark):
    cases = {
        "1 234,56": 1234.56,
        "1.234,56": 1234.56,
        "1,234.56": 1234.56,
        "12,5% годовых": 12.5,
        "-3": -3.0,
        "1 000": 1000.0,
        "1.234.567": None,
        "нет": None,
        "": None,
    }
    for raw, wanted in cases.items():
        assert one(spark, raw, numbers.parse_double) == wanted, raw
    assert one(spark, "-7,9", numbers.parse_integer) == -7
    assert one(spark, "1.234.567", numbers.number_error) == "NUMBER_MALFORMED"


def test_terms(spark):
    cases = {
        "3 месяца": (90, 90),
        "31–60 дней": (31, 60),
        "от 3 до 6 мес": (0, 90),
        "свыше 2 лет": (730, None),
        "до 1 года": (0, 365),
        "бессрочно": (None, None),
    }
    for raw, wanted in cases.items():
        term = one(spark, raw, numbers.parse_term)
        assert (term["term_min_days"], term["term_max_days"]) == wanted, raw
        assert term["term_original"] == raw


def test_rates(spark):
    rate = one(spark, "СР + 1,25 п.п.", numbers.parse_rate)
    assert (rate["rate_type"], rate["spread_pp"]) == ("BENCHMARK_SPREAD", 1.25)
    assert one(spark, "СР минус 2", numbers.parse_rate)["spread_pp"] == -2.0
    assert one(spark, "14,5%", numbers.parse_rate)["rate_value"] == 14.5
    assert one(spark, "по соглашению", numbers.parse_rate)["rate_type"] == "INDIVIDUAL"
    assert one(spark, "срок 5", numbers.parse_rate)["rate_type"] == "BENCHMARK_SPREAD"
    assert one(spark, "—", numbers.parse_rate)["rate_type"] == "NOT_PUBLISHED"


def test_currency(spark):
    assert [one(spark, v, numbers.parse_currency) for v in ("byn", " $ ", "Бел. руб.", "gbp")] == ["BYN", "USD", "BYN", None]


def test_dates(spark):
    assert one(spark, "5 марта 2024 г.", dates.publication_date) == "2024-03-05"
    assert one(spark, "at 2024-03-05T10:00:00 today", dates.publication_date) == "2024-03-05T10:00:00"
    assert one(spark, "вчера", dates.publication_date) == "вчера"
    minsk = lambda c: dates.source_datetime(c, "Europe/Minsk")
    assert one(spark, "2024-03-05 10:00", minsk) == "2024-03-05T07:00:00Z"
    assert one(spark, "2024-03-05T10:00:00.5+01:00", minsk) == "2024-03-05T09:00:00.500000Z"
    assert one(spark, "05.03.2024 10:30", lambda c: dates.source_datetime(c, "UTC", "DD.MM.YYYY HH:mm")) == "2024-03-05T10:30:00Z"
    assert one(spark, "soon", minsk) is None
    assert one(spark, "2024-03-05T10:00:00", dates.aware_timestamp) is None
    assert str(one(spark, "2024-03-05T10:00:00+0200", dates.aware_timestamp)) == "2024-03-05 08:00:00"


def test_day_bounds_follow_daylight_saving(spark):
    moment = lambda c: c.cast("timestamp_ntz")
    start = one(spark, "2024-03-31 10:00:00", lambda c: dates.start_of_day(moment(c), "Europe/Berlin"))
    end = one(spark, "2024-03-31 10:00:00", lambda c: dates.end_of_day(moment(c), "Europe/Berlin"))
    assert (start, end) == ("2024-03-31T00:00:00+01:00", "2024-03-31T23:59:59.999999+02:00")


def test_text(spark):
    assert one(spark, " a \n b ", text.clean_inline) == "a b"
    assert one(spark, "a  b\r\n\n c ", text.clean_article) == "a b\n\nc"
    assert one(spark, " Ставка, % (год) ", text.field_name) == "ставка_год"
    assert one(spark, "Ставка 12", lambda c: text.regex_pick(c, r"СТАВКА (\d+)", 1, ignore_case=True)) == "12"


def test_canonical_url(spark):
    cases = {
        "HTTPS://Example.COM//a//b/?utm_source=x&b=2&a=1#top": "https://example.com/a/b?a=1&b=2",
        "http://x.org/": "http://x.org",
        "http://x.org/p?q=a+b&e=&t=~*": "http://x.org/p?e=&q=a+b&t=~%2A",
        "http://x.org?GCLID=1": "http://x.org",
        "http://x.org/путь/?k=ж": "http://x.org/путь?k=%D0%B6",
    }
    for raw, wanted in cases.items():
        assert one(spark, raw, urls.canonical_url) == wanted


def test_resolve(spark):
    base = "https://x.org/a/b/c?q=1#f"
    cases = {
        "d": "https://x.org/a/b/d",
        "../d?z": "https://x.org/a/d?z",
        "/r/./s/../t": "https://x.org/r/t",
        "//y.org/z": "https://y.org/z",
        "?p=2": "https://x.org/a/b/c?p=2",
        "#g": "https://x.org/a/b/c?q=1#g",
        "mailto:a@b": "mailto:a@b",
        "../../../../d": "https://x.org/d",
        "": base,
    }
    for raw, wanted in cases.items():
        assert one(spark, raw, lambda c: urls.resolve(F.lit(base), c)) == wanted, raw


def test_public_addresses(spark):
    cases = {"8.8.8.8": True, "10.0.0.1": False, "172.31.0.1": False, "172.32.0.1": True, "224.0.0.1": False, "300.1.1.1": False, "x": False}
    for raw, wanted in cases.items():
        assert one(spark, raw, urls.public_ipv4) is wanted, raw
