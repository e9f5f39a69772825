"""Texts from outside: JSON answers of extraction services, forwarded addresses, error events, default currencies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.tables import THREE_DECIMAL_CURRENCIES
from tallyspark.functions.text import let

FIELDS = ("merchant", "date", "total", "subtotal", "tax", "currency", "invoiceNumber", "paymentMethod")
ANSWER = (
    ", ".join(f"{f} string" for f in FIELDS) + ", confidence struct<" + ", ".join(f"{f}:string" for f in FIELDS) + ">, items array<struct<description:string,quantity:string,unitPrice:string>>"
)
MAX_ITEMS = 100


def _object(text: str | None) -> str | None:
    """The first balanced braces of a text, strings and escapes respected."""
    start = -1 if text is None else text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text) if start >= 0 else -1):
        ch = text[i]
        if escaped or ch == "\\":
            escaped = not escaped and ch == "\\"
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{}":
            depth += 1 if ch == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def first_object(text: Column) -> Column:
    """The first JSON object in a text, as text; null without one."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_object(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def _number(text: Column) -> Column:
    """The number that a text begins with, all but digits, points and signs left out; null without."""
    return F.regexp_extract(F.regexp_replace(text, r"[^0-9.\-]", ""), r"^(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")


def coerce_answer(json: Column) -> Column:
    """An extraction service's answer as typed fields: numbers from texts, ISO dates only, three capitals for the currency,
    confidences between 0 and 1, 100 named items at most. Null where the JSON is malformed."""

    def typed(p: Column) -> Column:
        text = lambda c: F.nullif(F.trim(c), F.lit(""))
        sure = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), _number(c)))
        items = F.filter(F.transform(F.coalesce(p["items"], F.array()), lambda i: F.struct(text(i["description"]).alias("description"), _number(i["quantity"]).alias("quantity"), _number(i["unitPrice"]).alias("unit_price"))), lambda i: i["description"].isNotNull())
        date = F.when(text(p["date"]).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), text(p["date"]))
        confidence = F.struct(*(sure(p["confidence"][f]).alias(f) for f in FIELDS))
        return F.struct(
            text(p["merchant"]).alias("merchant"), date.alias("date"), *(_number(p[f]).alias(f) for f in ("total", "subtotal", "tax")), F.substring(F.upper(text(p["currency"])), 1, 3).alias("currency"),
            text(p["invoiceNumber"]).alias("invoice_number"), text(p["paymentMethod"]).alias("payment_method"), F.slice(items, 1, MAX_ITEMS).alias("items"), confidence.alias("confidence"),
        )

    parsed = F.from_json(json, ANSWER + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return let(parsed, lambda p: F.when(p["_bad"].isNull() & json.isNotNull(), typed(p)))


def client_ip(forwarded: Column, hops: int) -> Column:
    """The caller's address: the one that the outermost of `hops` trusted proxies added, counted from the right."""
    if hops <= 0:
        return F.lit("local")
    chain = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    return let(chain, lambda c: F.coalesce(F.try_element_at(c, F.lit(-hops)), F.lit("unknown")))


def scrub(message: Column) -> Column:
    """An error's message without a query's parameters."""
    return F.when(message.startswith("Failed query:"), "Database query failed").otherwise(message)


def scrub_event(event: Column) -> Column:
    """An error event (struct with user, server_name, request of method, url and more, exception values, message,
    breadcrumbs) without what is personal: who, where, headers, queries, parameters."""
    request = F.when(event["request"].isNotNull(), F.struct(event["request"]["method"].alias("method"), F.substring_index(event["request"]["url"], "?", 1).alias("url")))
    kept = event.dropFields("user", "server_name", "breadcrumbs")
    return kept.withField("request", request).withField("message", scrub(event["message"])).withField("exception", F.transform(event["exception"], scrub))


def default_currency(account: Column, common: Column, french: Column) -> Column:
    """The currency an import starts with: the account's, else the one of most receipts, else by language."""
    code = lambda c: F.when(F.upper(F.trim(c)).rlike(r"^[A-Z]{3}\z"), F.upper(F.trim(c)))
    return F.coalesce(code(account), code(common), F.when(french, "TND").otherwise("USD"))


def warns_of_dinars(three_decimals: Column, chosen: Column) -> Column:
    """Whether amounts look like thousandths while a currency of hundredths is chosen."""
    return three_decimals & ~F.upper(chosen).isin(*THREE_DECIMAL_CURRENCIES)
