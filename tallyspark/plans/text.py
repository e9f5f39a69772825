"""Queries of normalization, similarity, dates, money, statements and extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import similarity as sim
from tallyspark.functions.dates import parse_date
from tallyspark.functions.money import looks_three_decimal, minor_units, parse_amount
from tallyspark.functions.tables import (
    BRAND_ALIASES, CAPITALS_ONLY_CODES, CATEGORY_WORDS, CURRENCY_CODES, CURRENCY_SYMBOLS, KNOWN_BRANDS, NOISE_TOKENS, PAYMENT_WORDS, PROCESSOR_PREFIXES, STAR_AGGREGATORS,
)
from tallyspark.functions.text import normalize_description, normalize_merchant, payment_method, suggest_category
from tallyspark.operators.extract import currency_of, extract_receipts, line_items
from tallyspark.plans.registry import query
from tallyspark.plans.similar import SIMS
from tallyspark.sources.adapters import MERCHANTS, table
from tallyspark.sources.statements import fingerprint

#: Bank texts: the adapter's descriptions, with the pieces that normalization takes away, in ASCII.
_NAMES = "[" + ", ".join("'" + m.replace("é", "e") + "'" for m in MERCHANTS) + "]"
BANK = f"""WITH said AS (SELECT o_orderkey AS id, upper({_NAMES}[CAST(o_custkey % {len(MERCHANTS)} AS INTEGER) + 1]) AS name FROM orders),
  bank AS (SELECT id, CASE id % 6 WHEN 0 THEN 'POS ' || name || ' 2391' WHEN 1 THEN 'SQ *' || name WHEN 2 THEN name || ' #' || CAST(id % 50 AS VARCHAR)
    WHEN 3 THEN 'SEPA DD ' || name || ' 28/09/2026' WHEN 4 THEN name || ' XXXX4412 REF: A' || CAST(id AS VARCHAR) ELSE 'VISA DEBIT AMZN MKTP ' || name END AS raw FROM said)"""


def _bank(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.upper(F.element_at(F.array(*(F.lit(m.replace("é", "e")) for m in MERCHANTS)), (F.col("o_custkey") % len(MERCHANTS) + 1).cast("int")))
    number = k.cast("string")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("POS "), name, F.lit(" 2391"))).when(k % 6 == 1, F.concat(F.lit("SQ *"), name)).when(k % 6 == 2, F.concat(name, F.lit(" #"), (k % 50).cast("string")))
        .when(k % 6 == 3, F.concat(F.lit("SEPA DD "), name, F.lit(" 28/09/2026"))).when(k % 6 == 4, F.concat(name, F.lit(" XXXX4412 REF: A"), number)).otherwise(F.concat(F.lit("VISA DEBIT AMZN MKTP "), name))
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), raw.alias("raw"))


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _chain(column: str, patterns: list[str]) -> str:
    for pattern in patterns:
        column = f"regexp_replace({column}, '{pattern}', ' ', 'g')"
    return column


_STEPS = [
    r"\*+", r"\bx{2,}[0-9]{2,}\b", r"\b[0-9]{1,2}[/.\-][0-9]{1,2}([/.\-][0-9]{2,4})?\b", r"\b[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\b", r"#\s*[0-9]+",
    r"\b(ref|reference|auth|authcode|trn|trace|id|inv|invoice|order|ord|txn|tx)[:. ]*[a-z0-9\-]{3,}\b",
    r"\b([0-9][a-z0-9]{3,}|[a-z0-9][0-9][a-z0-9]{2,}|[a-z0-9]{2}[0-9][a-z0-9]+|[a-z0-9]{3,}[0-9][a-z0-9]*)\b", r"\b[a-z]{3}\s?[0-9.,]+\b", "[^a-z0-9]+",
]
_PREFIX = "|".join(PROCESSOR_PREFIXES)
NORMAL = BANK + rf""", starred AS (SELECT id, raw, CASE WHEN regexp_matches(lower(raw), '^({"|".join(STAR_AGGREGATORS)})\s*\*+\s*') THEN regexp_replace(lower(raw), '^[a-z]+\s*\*+\s*', '') ELSE lower(raw) END AS s FROM bank),
  plain AS (SELECT id, raw, trim({_chain("s", _STEPS)}) AS s FROM starred),
  stripped AS (SELECT id, raw, regexp_replace(s, '^(({_PREFIX}) )+', '') AS s FROM plain),
  normal AS (SELECT id, raw, CASE WHEN s IN ({_quoted(PROCESSOR_PREFIXES)}) THEN '' ELSE s END AS norm FROM stripped)"""
_ALIAS = lambda c: f"CASE {c} " + " ".join(f"WHEN '{a.replace(chr(39), chr(39) * 2)}' THEN '{b}'" for a, b in BRAND_ALIASES.items()) + " END"
_STARTS = "CASE " + " ".join(f"WHEN starts_with(norm, '{a} ') THEN '{b}'" for a, b in BRAND_ALIASES.items() if " " in a) + " END"
_BRAND = "CASE " + " ".join(f"WHEN contains(padded, ' {b} ') THEN '{b}'" for b in KNOWN_BRANDS) + " END"
MERCHANT = NORMAL + f""", words AS (SELECT id, norm, flatten(list_transform(string_split(norm, ' '), lambda t: string_split(coalesce({_ALIAS("t")}, t), ' '))) AS words FROM normal),
  keyed AS (SELECT id, norm, ' ' || array_to_string(words, ' ') || ' ' AS padded, array_to_string(list_filter(words, lambda t: length(t) > 1 AND t NOT IN ({_quoted(NOISE_TOKENS)})), ' ') AS rest FROM words)"""


@query(NORMAL + " SELECT id, norm FROM normal")
def normalized_descriptions(spark, sf_dir):
    """Bank texts without wording, references and dates."""
    return _bank(spark, sf_dir).select("id", normalize_description(F.col("raw")).alias("norm"))


@query(MERCHANT + f" SELECT id, CASE WHEN norm = '' THEN '' ELSE coalesce({_ALIAS('norm')}, {_STARTS}, {_BRAND}, nullif(rest, ''), norm) END AS merchant FROM keyed")
def normalized_merchants(spark, sf_dir):
    """Merchant keys of bank texts."""
    return _bank(spark, sf_dir).select("id", normalize_merchant(F.col("raw")).alias("merchant"))


#: Names as banks write them, and what is left of each, written out by hand.
MARKED_NAMES = (
    ("ŠKODA AUTO", "skoda auto"), ("Bșc Țara", "bsc tara"), ("ŽABKA POLSKA", "zabka polska"), ("PHỞ HÀ NỘI", "pho ha noi"), ("ÉPICERIE ÇA", "epicerie ca"), ("İZMİR ÇAY", "izmir cay"), ("ŐRSÉG ŰR", "orseg ur"),
    ("ĀBOLS RĪGA", "abols riga"), ("ČESKÁ POŠTA", "ceska posta"), ("Běijīng Lǜ", "beijing lu"), ("ȚIRIAC ĂUTO", "tiriac auto"),
)


@query("SELECT o_orderkey AS id, [" + ", ".join(f"'{bare}'" for _, bare in MARKED_NAMES) + f"][CAST(o_orderkey % {len(MARKED_NAMES)} AS INTEGER) + 1] AS norm FROM orders")
def marked_names(spark, sf_dir):
    """Names with marks, most in capitals, normalized."""
    names = F.array(*(F.lit(name) for name, _ in MARKED_NAMES))
    said = F.concat(F.lit("POS "), F.element_at(names, (F.col("o_orderkey") % len(MARKED_NAMES) + 1).cast("int")), F.lit(" #"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), normalize_description(said).alias("norm"))


def _first(rules, column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '\\b({p})\\b') THEN '{n}'" for n, p in rules) + " END"


@query(BANK + f" SELECT id, {_first(PAYMENT_WORDS, 'lower(raw)')} AS method FROM bank")
def payment_method_rule(spark, sf_dir):
    """The payment method that bank texts tell."""
    return _bank(spark, sf_dir).select("id", payment_method(F.col("raw")).alias("method"))


@query(BANK + f" SELECT id, {_first(CATEGORY_WORDS, 'lower(raw)')} AS category FROM bank")
def category_rule(spark, sf_dir):
    """The category that bank texts suggest."""
    return _bank(spark, sf_dir).select("id", suggest_category(F.col("raw")).alias("category"))


#: Each part name with the next one's.
NAMES = "WITH pairs AS (SELECT a.p_partkey AS id, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _names(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("b")), "id")


@query(NAMES + " SELECT id, CAST(floor((1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) * 10000 + 0.5) AS BIGINT) AS ratio FROM pairs")
def levenshtein_ratio(spark, sf_dir):
    """Edit similarity of neighbouring names, in ten-thousandths."""
    return _names(spark, sf_dir).select("id", F.floor(sim.levenshtein_ratio(F.col("a"), F.col("b")) * 10000 + F.lit(0.5)).cast("long").alias("ratio"))


@query(NAMES + " SELECT id, contains(' ' || a || ' ', ' ' || split_part(b, ' ', 1) || ' ') AS contained FROM pairs")
def containment_similarity(spark, sf_dir):
    """Whether a name has its neighbour's first word."""
    return _names(spark, sf_dir).select("id", sim.containment(F.col("a"), F.element_at(F.split("b", " "), 1)).alias("contained"))


@query(NAMES + """ SELECT id, CAST(floor(2.0::DOUBLE * len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) /
    (len(list_distinct(string_split(a, ' '))) + len(list_distinct(string_split(b, ' ')))) * 10000 + 0.5) AS BIGINT) AS dice FROM pairs""")
def token_dice(spark, sf_dir):
    """Dice coefficient of the words of neighbouring names, in ten-thousandths."""
    return _names(spark, sf_dir).select("id", F.floor(sim.token_dice(F.col("a"), F.col("b")) * 10000 + F.lit(0.5)).cast("long").alias("dice"))


@query(NAMES + f", np AS (SELECT DISTINCT a, b FROM pairs), {SIMS} SELECT id, CAST(floor(jw * 1000000 + 0.5) AS BIGINT) AS jaro_winkler, CAST(floor(sim * 1000000 + 0.5) AS BIGINT) AS merchant FROM pairs JOIN sims USING (a, b)")
def merchant_similarity(spark, sf_dir):
    """Jaro-Winkler and merchant similarity of neighbouring names in millionths, once per distinct pair."""
    pairs = sim.add_similarity(_names(spark, sf_dir), "a", "b", "jaro_winkler", sim.jaro_winkler_column)
    pairs = sim.add_similarity(pairs, "a", "b", "merchant")
    ppm = lambda c: F.floor(F.col(c) * 1000000 + F.lit(0.5)).cast("long").alias(c)
    return pairs.select("id", ppm("jaro_winkler"), ppm("merchant"))


#: Part names with a short form each: initials, the words' first three letters, or all consonants.
SHORT = """WITH pairs AS (SELECT p_partkey AS id, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN left(split_part(p_name, ' ', 1), 1) || left(split_part(p_name, ' ', 2), 1)
    WHEN 1 THEN left(split_part(p_name, ' ', 1), 3) || ' ' || left(split_part(p_name, ' ', 2), 3) ELSE regexp_replace(p_name, '[aeiou ]', '', 'g') END AS b FROM part),
  np AS (SELECT DISTINCT a, b FROM pairs)"""
#: What each rule gives, 0 where it doesn't fire.
LIKENESS = """, ruled AS (SELECT a, b, sim, string_split(a, ' ') AS w, string_split(b, ' ') AS v, regexp_replace(a, '[aeiou ]', '', 'g') AS x, regexp_replace(b, '[aeiou ]', '', 'g') AS y FROM sims),
  likely AS (SELECT a, b, greatest(sim, CASE WHEN len(v) = 2 AND starts_with(w[1], v[1]) AND starts_with(w[2], v[2]) THEN 0.8::DOUBLE + 0.15::DOUBLE * (length(v[1])::DOUBLE / length(w[1]) + length(v[2])::DOUBLE / length(w[2])) / 2 ELSE 0 END,
    CASE WHEN replace(b, ' ', '') = left(w[1], 1) || left(w[2], 1) THEN 0.9::DOUBLE ELSE 0 END, CASE WHEN length(y) >= 3 AND starts_with(x, y) THEN 0.75::DOUBLE + 0.15::DOUBLE * length(y)::DOUBLE / length(x) ELSE 0 END) AS best FROM ruled)"""


@query(SHORT + f", {SIMS}" + LIKENESS + " SELECT id, b AS short, CAST(floor(least(1.0::DOUBLE, floor(best * 100 + 0.5) / 100) * 100 + 0.5) AS INTEGER) AS likeness FROM pairs JOIN likely USING (a, b)")
def semantic_similarity(spark, sf_dir):
    """How alike part names and short forms of them are, in hundredths: initials, prefixes and skeletons."""
    name, k = F.col("p_name"), F.col("p_partkey")
    word = lambda i, n: F.substring(F.split_part(name, F.lit(" "), F.lit(i)), 1, n)
    form = F.when(k % 3 == 0, F.concat(word(1, 1), word(2, 1))).when(k % 3 == 1, F.concat(word(1, 3), F.lit(" "), word(2, 3))).otherwise(F.regexp_replace(name, "[aeiou ]", ""))
    found = sim.add_similarity(table(spark, sf_dir, "part").select(k.alias("id"), name.alias("a"), form.alias("b")), "a", "b", "likeness", sim.semantic_similarity_column)
    return found.select("id", F.col("b").alias("short"), F.floor(F.col("likeness") * 100 + F.lit(0.5)).cast("int").alias("likeness"))


AMOUNTS = """WITH cents AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders),
  cut AS (SELECT id, c, CAST(c // 100000 AS VARCHAR) AS k, lpad(CAST(c // 100 % 1000 AS VARCHAR), 3, '0') AS u, lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS f FROM cents)"""


@query(AMOUNTS + " SELECT id, CASE WHEN id % 5 = 4 THEN NULL WHEN id % 2 = 0 THEN c::DOUBLE / 100 ELSE -(c::DOUBLE / 100) END AS value FROM cut")
def parsed_amounts(spark, sf_dir):
    """Amounts written in five ways, read back."""
    c = F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("long")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), c.alias("c"))
    k, u, f = F.expr("c div 100000").cast("string"), F.lpad(F.expr("c div 100 % 1000").cast("string"), 3, "0"), F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    sign = F.when(F.col("id") % 2 == 1, "-").otherwise("")
    raw = (
        F.when(F.col("id") % 5 == 0, F.concat(sign, k, F.lit("."), u, F.lit(","), f)).when(F.col("id") % 5 == 1, F.concat(sign, k, F.lit(","), u, F.lit("."), f))
        .when(F.col("id") % 5 == 2, F.concat(F.lit("€ "), sign, k, u, F.lit("."), f)).when(F.col("id") % 5 == 3, F.concat(sign, k, F.lit(" "), u, F.lit(","), f, F.lit(" EUR"))).otherwise("n/a")
    )
    return df.select("id", parse_amount(raw).alias("value"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 7 = 5 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def parsed_statement_dates(spark, sf_dir):
    """Dates written in six ways and one that is none, read back; month-first ones misread where both parts allow."""
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate")
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd", "MM/dd/yyyy")
    raw = F.lit("32/13/2026")
    for i, form in enumerate(formats):
        raw = F.when(k == i, F.date_format(d, form)).otherwise(raw)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), parse_date(raw).alias("date"))


@query("SELECT o_custkey AS id, count(*) >= 2 AND o_custkey % 2 = 0 AS three FROM orders GROUP BY o_custkey")
def three_decimal_flag(spark, sf_dir):
    """Whether a customer's amounts, written with two or three decimals, look like thousandths."""
    c = F.floor(F.col("o_totalprice")).cast("string")
    text = F.concat(c, F.when(F.col("o_custkey") % 2 == 0, ".125").otherwise(".12"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(text).alias("v"), F.count(F.lit(1)).alias("n")).select("id", (looks_three_decimal(F.concat("v", "v")) & (F.col("n") >= 2)).alias("three"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS cents FROM lineitem")
def minor_unit_amounts(spark, sf_dir):
    """Discounted prices in whole cents."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", minor_units(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cents"))


FINGER = """WITH c AS (SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS date, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c, o_orderpriority FROM orders),
  prints AS (SELECT id, sha256(strftime(date, '%Y-%m-%d') || '|' || CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '|' || lower(o_orderpriority) || '|none') AS fingerprint FROM c)"""


@query(FINGER + " SELECT id, fingerprint FROM prints")
def fingerprint_sha256(spark, sf_dir):
    """The fingerprint of each order as a bank line."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fingerprint(F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_orderpriority")).alias("fingerprint"))


def _receipt_texts(spark, sf_dir) -> DataFrame:
    """(id, text): a receipt for each order, in one of four layouts by its key."""
    cents = F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5)).cast("long")
    price = F.concat(F.expr("_c div 100").cast("string"), F.lit("."), F.lpad((F.col("_c") % 100).cast("string"), 2, "0"))
    line = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" x Part "), "l_returnflag", F.lit("  "), price)
    lines = table(spark, sf_dir, "lineitem").withColumn("_c", cents).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("rows"), F.sum("_c").alias("c"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    k, day = F.col("o_orderkey").cast("string"), F.col("o_orderdate")

    def money(cents: str, dot: str = ".", tail: str = "") -> Column:
        whole, rest = F.expr(f"({cents}) div 100").cast("string"), F.lpad(F.expr(f"({cents}) % 100").cast("string"), 2, "0")
        return F.concat(whole, F.lit(dot), rest, F.lit(tail))

    def text(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    fifth = "c - c div 5"
    layouts = (
        text("CARREFOUR MARKET\n12 Avenue Habib\nInvoice No: INV-", k, "\nDate: ", F.date_format(day, "yyyy-MM-dd"), "\n", F.array_join(F.transform("rows", lambda r: r["t"]), "\n"), "\nSubtotal EUR ", money(fifth), "\nVAT EUR ", money("c div 5"), "\nTOTAL EUR ", money("c"), "\nPaid by VISA"),
        text("Monoprix\nFacture N° 2026-", k, "\nDate : ", F.date_format(day, "dd-MM-yyyy"), "\nSous-total HT  ", money(fifth, ",", "0"), " DT\nTimbre fiscal  1,000 DT\nTotal TTC  ", money("c + 100", ",", "0"), " DT\nPayé en espèces"),
        text("SHOP A\n", F.date_format(day, "MM/dd/yyyy"), "\nCoffee  12.50\nTea  ", money("c"), "\nThanks USD"),
        text("Boulangerie du Coin\nle ", F.date_format(day, "d MMM yyyy"), "\nAmount due\n", money("c"), "\nVirement EUR"),
    )
    out = layouts[3]
    for i in (2, 1, 0):
        out = F.when(F.col("o_orderkey") % 4 == i, layouts[i]).otherwise(out)
    return o.select(F.col("o_orderkey").alias("id"), out.alias("text"))


#: What was written into each receipt, and how sure its reading is.
WRITTEN = """WITH sums AS (SELECT l_orderkey, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS c, count(*) AS n FROM lineitem GROUP BY l_orderkey),
  o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS date, c, n FROM orders JOIN sums ON o_orderkey = l_orderkey),
  written AS (SELECT id, date, CASE k WHEN 0 THEN 'CARREFOUR MARKET' WHEN 1 THEN 'Monoprix' WHEN 2 THEN 'SHOP A' ELSE 'Boulangerie du Coin' END AS merchant,
    CASE k WHEN 1 THEN c + 100 WHEN 2 THEN greatest(c, 1250, year(date) * 100) ELSE c END AS total, CASE WHEN k < 2 THEN c - c // 5 END AS subtotal, CASE WHEN k < 2 THEN c // 5 END AS tax,
    CASE k WHEN 0 THEN 'EUR' WHEN 1 THEN 'TND' WHEN 2 THEN 'USD' ELSE 'EUR' END AS currency, CASE k WHEN 0 THEN 'INV-' || id WHEN 1 THEN '2026-' || id END AS invoice_number,
    CASE k WHEN 0 THEN 'card' WHEN 1 THEN 'cash' WHEN 3 THEN 'transfer' END AS payment_method, CASE k WHEN 0 THEN n WHEN 2 THEN 2 ELSE 0 END AS n_items,
    CASE k WHEN 0 THEN 99 WHEN 1 THEN 98 WHEN 2 THEN 45 ELSE 86 END AS s_total, CASE WHEN k IN (0, 2) THEN 93 ELSE 82 END AS s_merchant, CASE k WHEN 1 THEN 90 ELSE 96 END AS s_currency,
    CASE k WHEN 0 THEN 99 WHEN 3 THEN 97 ELSE CASE WHEN day(date) > 12 THEN 96 ELSE 72 END END AS s_date, CASE k WHEN 0 THEN 97 WHEN 1 THEN 60 END AS s_tax FROM o)"""


@query(WRITTEN + """ SELECT id, merchant, date, total, subtotal, tax, currency, invoice_number, payment_method, CAST(n_items AS BIGINT) AS n_items, CAST(s_total AS BIGINT) AS s_total, CAST(s_date AS BIGINT) AS s_date,
    CAST(s_merchant AS BIGINT) AS s_merchant, CAST(s_currency AS BIGINT) AS s_currency, CAST(s_tax AS BIGINT) AS s_tax, CAST((s_total * 400 + s_date * 250 + s_merchant * 250 + s_currency * 100 + 50) // 100 AS BIGINT) AS overall FROM written""")
def extract_receipt_fields(spark, sf_dir):
    """The fields of receipts in four layouts, in cents and hundredths of confidence: what was written is read."""
    found = extract_receipts(_receipt_texts(spark, sf_dir))
    sure = [F.floor(F.col(f"confidence.{f}") * 100 + F.lit(0.5)).cast("long").alias(f"s_{f}") for f in ("total", "date", "merchant", "currency", "tax")]
    cents = [minor_units(F.col(f)).alias(f) for f in ("total", "subtotal", "tax")]
    return found.select("id", "merchant", "date", *cents, "currency", "invoice_number", "payment_method", F.size("items").cast("long").alias("n_items"), *sure, F.floor(F.col("overall") * 1000 + F.lit(0.5)).cast("long").alias("overall"))


@query("""SELECT o_orderkey AS id, 'Part ' || l_returnflag AS description, CAST(l_quantity AS BIGINT) AS quantity,
    CAST(floor(floor(floor(l_extendedprice * 100 + 0.5) / 100 / CAST(l_quantity AS BIGINT) * 100 + 0.5) / 100 * 100 + 0.5) AS BIGINT) AS unit_cents
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 4 = 0""")
def receipt_line_items(spark, sf_dir):
    """The line items of the receipts that list theirs, a row each."""
    items = line_items(extract_receipts(_receipt_texts(spark, sf_dir).where("id % 4 = 0")))
    return items.select("id", "description", F.col("quantity").cast("long"), minor_units(F.col("unit_price")).alias("unit_cents"))


_CURRENCIES = (
    [(rf"(?i)\b{c}\b", c) for c in CURRENCY_CODES] + [(rf"\b{c}\b", c) for c in CAPITALS_ONLY_CODES] + [(re.escape(s), c) for s, c in CURRENCY_SYMBOLS]
    + [(r"[0-9]\s*DTN?([^A-Za-z0-9_]|$)", "TND"), (r"(?i)\bdinars?\s+tunisiens?\b", "TND")]
)


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for p, c in _CURRENCIES) + " END AS currency FROM documents")
def detected_currency(spark, sf_dir):
    """The currency that each document names, if any."""
    return table(spark, sf_dir, "documents").select("doc_id", currency_of(F.col("text")).alias("currency"))
