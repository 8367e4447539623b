"""Search parameters: time filters, regions, domain filters, safe search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of time filters and the ranges they mean.
RANGES = {"d": "day", "w": "week", "m": "month", "y": "year"}


def _date(tbs: Column, field: str) -> Column:
    found = rf"{field}:(\d{{2}})/(\d{{2}})/(\d{{4}})"
    iso = F.concat_ws("-", F.regexp_extract(tbs, found, 3), F.regexp_extract(tbs, found, 1), F.regexp_extract(tbs, found, 2))
    return F.when(tbs.rlike(found), iso)


def days_between(start: Column, end: Column) -> Column:
    """Days between two ISO dates; null if one is no date."""
    return F.datediff(end.try_cast("date"), start.try_cast("date"))


def range_for_span(days: Column) -> Column:
    """The range that covers a span; a span that is unknown counts as a year."""
    return F.when(days < 2, "day").when(days <= 14, "week").when(days < 60, "month").otherwise("year")


def time_filter(tbs: Column) -> Column:
    """Struct (df, time_range, warnings) of a time filter.

    In this order: a custom range of two dates, the unsupported hour, the four granularities inside
    the text, a bare word, a lone flag for sorting, and what is not recognised. Warnings are joined
    by "; ", and null if there are none.
    """
    low, high = _date(tbs, "cd_min"), _date(tbs, "cd_max")
    span = days_between(low, high)
    sort = F.contains(tbs, F.lit("sbd:1"))
    sort_note = F.when(sort, "sbd:1 sort-by-date unsupported")
    unknown = F.concat(F.lit('tbs "'), tbs, F.lit('" not recognized'))
    none = F.lit(None).cast("string")

    def out(df: Column | str | None, kind: Column | str | None, note: Column | None) -> Column:
        as_col = lambda v: none if v is None else F.lit(v) if isinstance(v, str) else v
        return F.struct(as_col(df).alias("df"), as_col(kind).alias("time_range"), (none if note is None else note).alias("warnings"))

    bare = F.lower(tbs)
    result = F.when(tbs.isNull() | (tbs == ""), out(None, None, None))
    custom = (
        F.when(low.isNull() | high.isNull(), out(None, None, unknown))
        .when(span < 0, out(None, None, F.lit("invalid cdr range (min after max)")))
        .otherwise(out(F.concat(low, F.lit(".."), high), range_for_span(span), F.lit("custom date range approximated for time_range")))
    )
    result = result.when(F.contains(tbs, F.lit("cdr:")), custom)
    result = result.when(F.contains(tbs, F.lit("qdr:h")), out("d", "day", F.concat_ws("; ", sort_note, F.lit("qdr:h unsupported, using day"))))
    for letter, name in RANGES.items():
        result = result.when(F.contains(tbs, F.lit(f"qdr:{letter}")), out(letter, name, sort_note))
    for letter, name in RANGES.items():
        result = result.when(~sort & bare.isin(letter, name), out(letter, name, None))
    return result.when(sort, out(None, None, sort_note)).otherwise(out(None, None, unknown))


def domain_query(query: Column, include: Column, exclude: Column) -> Column:
    """A query with sites to search and to leave out; null and empty lists add nothing."""
    wanted = F.when(F.size(include) > 0, F.array_join(F.transform(include, lambda d: F.concat(F.lit("site:"), d)), " OR "))
    unwanted = F.when(F.size(exclude) > 0, F.array_join(F.transform(exclude, lambda d: F.concat(F.lit("-site:"), d)), " "))
    return F.concat_ws(" ", query, wanted, unwanted)


def safe_code(safe: Column) -> Column:
    """The code of safe search: on only if asked for."""
    return F.when(safe, "1").otherwise("-2")


def media_safe_code(source: Column, safe: Column) -> Column:
    """The code of safe search for news and images: on, off, or the middle where it is left open."""
    news = F.when(safe, "1").when(~safe, "-2").otherwise("-1")
    return F.when(source == "news", news).otherwise(F.when(~safe, "-1").otherwise("1"))


def _norm(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def region_code(
    asks: DataFrame, locations: DataFrame, country_langs: DataFrame, countries: DataFrame, langs: DataFrame, default: str = "us-en"
) -> DataFrame:
    """``asks`` (country, lang, location and any further columns but code) with ``code``.

    The lookup tables are parameters: locations(name, code), country_langs(country, lang, code),
    countries(country, code), langs(lang, code), in lower case. Priority: exact location, the longest
    location name that stands as whole words in it, country with language, country, language,
    ``default``. Locations shorter than three letters or with other signs than letters, blank and
    ``,.'-`` are passed over. The tables hold a few hundred rows whatever the data; the phrase
    search goes by words: a location's words are exploded and met by the names' first words, so no
    pair of rows without a common word is compared.
    """
    keyed = asks.withColumn("ws_c", _norm(F.col("country"))).withColumn("ws_l", _norm(F.col("lang"))).withColumn("ws_p", _norm(F.col("location")))
    usable = (F.length("ws_p") >= 3) & F.col("ws_p").rlike(r"^[a-z ,.'-]+$")
    keyed = keyed.withColumn("ws_p", F.when(usable, F.col("ws_p")))
    first = lambda c: F.regexp_extract(c, r"[a-z]+", 0)
    names = locations.select(F.col("name").alias("ws_name"), F.col("code").alias("ws_code"), first(F.col("name")).alias("ws_first"))
    places = keyed.select("ws_p").where("ws_p is not null").distinct()
    words = places.select("ws_p", F.explode(F.array_distinct(F.split("ws_p", "[^a-z]+"))).alias("ws_first")).where("ws_first <> ''")
    edged = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, "[^a-z]", " "), F.lit(" "))
    whole = F.contains(F.col("ws_p"), F.col("ws_name")) & F.expr(
        "exists(sequence(1, length(ws_p) - length(ws_name) + 1), i -> substring(ws_p, i, length(ws_name)) = ws_name"
        " and (i = 1 or not substring(ws_p, i - 1, 1) rlike '[a-z]') and not substring(ws_p, i + length(ws_name), 1) rlike '[a-z]')"
    )
    found = words.join(names, "ws_first").where((F.length("ws_p") >= F.length("ws_name")) & whole)
    best = found.groupBy("ws_p").agg(F.max_by("ws_code", F.struct((F.col("ws_p") == F.col("ws_name")), F.length("ws_name"), "ws_name")).alias("ws_place"))
    out = (
        keyed.join(best, "ws_p", "left")
        .join(country_langs.select(F.col("country").alias("ws_c"), F.col("lang").alias("ws_l"), F.col("code").alias("ws_cl")), ["ws_c", "ws_l"], "left")
        .join(countries.select(F.col("country").alias("ws_c"), F.col("code").alias("ws_cc")), "ws_c", "left")
        .join(langs.select(F.col("lang").alias("ws_l"), F.col("code").alias("ws_ll")), "ws_l", "left")
    )
    code = F.coalesce("ws_place", "ws_cl", "ws_cc", "ws_ll", F.lit(default)).alias("code")
    return out.select(*asks.columns, code)
