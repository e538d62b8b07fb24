"""Instruments: identifiers looked up in a mapping table, and exchange profiles by code or symbol suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code, market identifier, time zone, start and end of the regular session, currency of each exchange.
PROFILES = [
    ("NASDAQ", "XNAS", "America/New_York", "09:30", "16:00", "USD"),
    ("NYSE", "XNYS", "America/New_York", "09:30", "16:00", "USD"),
    ("AMEX", "XASE", "America/New_York", "09:30", "16:00", "USD"),
    ("TASE", "XTAE", "Asia/Jerusalem", "09:45", "17:25", "ILS"),
    ("LSE", "XLON", "Europe/London", "08:00", "16:30", "GBP"),
    ("TSX", "XTSE", "America/Toronto", "09:30", "16:00", "CAD"),
    ("ASX", "XASX", "Australia/Sydney", "10:00", "16:00", "AUD"),
]
FIELDS = ("exchange", "mic", "exchange_timezone", "session_start", "session_end", "currency")
#: Exchange of each symbol suffix, other names of exchanges, time zone where none is known.
SUFFIXES = {".TA": "TASE", ".L": "LSE", ".TO": "TSX", ".V": "TSX", ".AX": "ASX"}
ALIASES = {"NMS": "NASDAQ", "NAS": "NASDAQ", "NASDAQGS": "NASDAQ", "NASDAQGM": "NASDAQ", "NASDAQCM": "NASDAQ", "NYQ": "NYSE", "ASE": "AMEX", "TLV": "TASE", "TLV STOCK EXCHANGE": "TASE"}
DEFAULT_ZONE = "Asia/Jerusalem"
MAPPING = ("security_number", "yahoo_symbol", "name", "exchange", "currency", "timezone")


def filled(c: Column) -> Column:
    """The trimmed text, or null where it is blank or says unknown."""
    text = F.trim(c)
    return F.when((text != "") & (F.lower(text) != "unknown"), text)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A mapping file with a header; rows are numbered in the order of the file."""
    df = spark.read.option("header", True).csv(path)
    if missing := [c for c in MAPPING if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*MAPPING).withColumn("row", F.monotonically_increasing_id())


def resolve(identifiers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds symbol, name, exchange, currency, exchange_timezone and problem to the column ``identifier``.

    Digits alone are a security number, which takes the first row of the mapping in order of ``row``; anything else
    is a symbol. problem says why there is no symbol: unknown number, no symbol for it, or blank.
    The sizes of both sides decide how they are joined.
    """
    number = F.trim("security_number")
    first = mapping.withColumn("number", number).withColumn("_n", F.row_number().over(Window.partitionBy("number").orderBy("row"))).filter("_n = 1")
    known = first.select("number", filled(F.upper("yahoo_symbol")).alias("_symbol"), *[filled(F.col(c)).alias(f"_{c}") for c in MAPPING[2:]])
    own = F.upper(F.trim("identifier"))
    digits = own.rlike("^[0-9]+$")
    joined = identifiers.join(known, F.when(digits, own) == F.col("number"), "left")
    symbol = F.when(digits, F.col("_symbol")).otherwise(filled(own))
    problem = F.when(digits & F.col("number").isNull(), "unknown number").when(digits & F.col("_symbol").isNull(), "no symbol").when(symbol.isNull(), "blank")
    zone = F.when(digits & F.col("number").isNotNull(), F.coalesce("_timezone", F.lit(DEFAULT_ZONE)))
    return joined.select(*[F.col(f"`{c}`") for c in identifiers.columns], symbol.alias("symbol"), F.coalesce("_name", symbol).alias("name"), F.col("_exchange").alias("exchange"), F.col("_currency").alias("currency"), zone.alias("exchange_timezone"), problem.alias("problem"))


def with_profile(df: DataFrame, override: str = "timezone_override", provider_zone: str = "provider_timezone", provider_exchange: str = "provider_exchange") -> DataFrame:
    """Fills mic, session times, exchange, currency and time zone. A profile found by exchange goes before one found
    by the symbol's suffix; a time zone given by override, provider or instrument goes before a profile's."""
    have = lambda c: filled(F.col(c)) if c in df.columns else F.lit(None).cast("string")
    profiles = F.create_map(*[x for p in PROFILES for x in (F.lit(p[0]), F.struct(*[F.lit(v).alias(n) for v, n in zip(p, FIELDS)]))])
    names = F.create_map(*[F.lit(x) for kv in ({p[0]: p[0] for p in PROFILES} | ALIASES).items() for x in kv])
    tail = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    by_name = lambda c: F.try_element_at(profiles, F.try_element_at(names, F.upper(c)))
    suffix = F.try_element_at(profiles, F.try_element_at(tail, F.regexp_extract(F.upper("symbol"), r"(\.[A-Z]+)$", 1)))
    profile = F.coalesce(by_name(have(provider_exchange)), by_name(have("exchange")), suffix)
    zone = F.coalesce(have(override), have(provider_zone), have("exchange_timezone"), profile["exchange_timezone"])
    out = {"mic": profile["mic"], "session_start": profile["session_start"], "session_end": profile["session_end"], "exchange": F.coalesce(have(provider_exchange), have("exchange"), profile["exchange"]), "currency": F.coalesce(have("currency"), profile["currency"]), "exchange_timezone": zone}
    return df.withColumns(out)
