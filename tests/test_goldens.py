import random

import pytest
from pyspark.sql import functions as F

from tallyspark.config import MatchingConfig
from tallyspark.functions.dates import parse_date
from tallyspark.functions.money import csv_cell, fixed2, parse_amount
from tallyspark.functions.similarity import jaro_winkler, merchant_likeness, token_set_ratio
from tallyspark.functions.text import extract_reference, normalize_description, normalize_merchant
from tallyspark.operators.assign import flag_duplicates, greedy_assignment
from tallyspark.operators.extract import extract_receipts
from tallyspark.sources.statements import parse_statements, statement_rows


def column(spark, values, function):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.select(function(F.col("v")).alias("out"), "i").orderBy("i").collect()]


def test_descriptions(spark):
    raw = ["POS CARREFOUR", "SQ *BLUE BOTTLE COFFEE", "PAYPAL *STEAM GAMES", "CARREFOUR #2391", "UBER TRIP XXXX4412", "MONOPRIX 28/09/2026", None, "CAFÉ DE FLORE"]
    assert column(spark, raw, normalize_description) == ["carrefour", "blue bottle coffee", "steam games", "carrefour", "uber trip", "monoprix", "", "cafe de flore"]
    names = ["CARREFOUR TUNIS", "CARREFOUR MARKET", "POS CARREFOUR", "SBUX STORE 1123"]
    assert column(spark, names, normalize_merchant) == ["carrefour", "carrefour", "carrefour", "starbucks"]
    assert column(spark, ["THE CO", "PAYMENT REF INV-48291"], extract_reference)[1] == "INV-48291"


def test_similarity():
    assert jaro_winkler("carrefour", "carefour") > 0.85
    assert merchant_likeness("carrefour", "carrefour market tunis") > 0.85
    assert merchant_likeness("carrefour", "netflix") < 0.5
    assert token_set_ratio("", "a") == 0 and jaro_winkler("", "") == 1


def test_money(spark):
    raw = ["1.234,56", "1,234.56", "47,85", "-47.85", "€ 47.85", "abc", "", "54.600", "1,234", "12-5"]
    assert column(spark, raw, parse_amount) == [1234.56, 1234.56, 47.85, -47.85, 47.85, None, None, 54600.0, 1.234, 12.0]
    assert column(spark, ["47,850", "54.600", "1.234,567"], lambda c: parse_amount(c, True)) == [47.85, 54.6, 1234.567]
    assert column(spark, ["=1+1", "-12.5", "-a", 'a"b,c', None], csv_cell) == ["'=1+1", "-12.5", "'-a", '"a""b,c"', ""]
    assert column(spark, ["-47.85", "2500", "0.1"], lambda c: fixed2(c.cast("double"))) == ["-47.85", "2500.00", "0.10"]


def test_dates(spark):
    raw = ["28/09/2026", "09/28/2026", "28 Sep 2026", "20260928", "2026-09-28T10:00:00", "32/13/2026", "01/02/2026", "30.02.2026", None]
    got = [str(d) if d else None for d in column(spark, raw, parse_date)]
    assert got == ["2026-09-28"] * 5 + [None, "2026-02-01", None, None]
    assert str(column(spark, ["01/02/2026"], lambda c: parse_date(c, "mdy"))[0]) == "2026-01-02"


STATEMENT = 'date,description,amount,currency\n2026-09-28,"POS CARREFOUR, TUNIS",-47.85,EUR\n\n2026-09-29,SPOTIFY AB,-39.99,EUR\nsoon,UBER,-18.20,EUR\n2026-09-29,SPOTIFY AB,-39.99,EUR\n2026-09-30,NOTHING,0.00,EUR\n'
FRENCH = "Date operation;Libelle;Debit;Credit\n28/09/2026;Monoprix Tunis;47,850;\n29/09/2026;Salaire;;1 800,000\n30/09/2026;Cafe;54,600;\n"


def test_statements(spark):
    files = spark.createDataFrame([("a", STATEMENT), ("b", FRENCH), ("c", ""), ("d", None)], "file string, content string")
    rows = statement_rows(files)
    parsed = parse_statements(rows, "TND").orderBy("file", "row_number").collect()
    a = [(r.row_number, r.amount, r.issue) for r in parsed if r.file == "a"]
    assert a == [(2, -47.85, None), (3, -39.99, None), (4, -18.2, "date"), (5, -39.99, "repeated row"), (6, 0.0, "zero")]
    assert parsed[0].merchant_norm == "carrefour" and parsed[0].payment_method == "card"
    assert [(r.amount, r.issue) for r in parsed if r.file == "b"] == [(-47.85, None), (1800.0, None), (-54.6, None)]
    assert {r.file for r in parsed} == {"a", "b"}


RECEIPT = """CARREFOUR MARKET
12 Avenue Habib
Invoice: INV-48291
Date: 28/09/2026
2 x Coffee  8.00
Bread  3.20
Subtotal  40.21
VAT  7.64
TOTAL  47.85
Paid by VISA"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, RECEIPT), (2, ""), (3, None), (4, "asdf qwer")], "id int, text string")
    one, empty, none, junk = extract_receipts(df).orderBy("id").collect()
    assert (one.merchant, str(one.date), one.total, one.subtotal, one.tax, one.invoice_number, one.payment_method) == ("CARREFOUR MARKET", "2026-09-28", 47.85, 40.21, 7.64, "INV-48291", "card")
    assert one.confidence.total >= 0.99 and one["items"][0].description == "Coffee" and one["items"][0].quantity == 2 and one["items"][0].unit_price == 4.0
    assert empty.total is None and none.total is None and junk.total is None and none.overall == 0


SUPERMARKET = """MONOPRIX
Av. Habib Bourguiba, Tunis
MF: 1234567/A/M/000
Date: 12/10/2026
Ticket N° 4521

Total HT          40,210 DT
TVA 19%            7,640 DT
Total TTC         47,850 DT

Payé par carte bancaire"""


def test_extraction_of_dinars(spark):
    stamp = "RESTAURANT DAR EL JELD\nSous-total HT      40,210 DT\n{}Timbre fiscal       1,000 DT\nTotal TTC          48,850 DT"
    texts = [SUPERMARKET, stamp.format("TVA 19%             7,640 DT\n"), stamp.format(""), "MAGASIN\nTotal TTC 54.600 DT", "MAGASIN\nSous-total 40,210\nTVA 19,00 % 7,640\nTotal TTC 47,850", "SHOP\nItem            12.50\nItem          1.500\nTotal         1.500", "SHOP\nTOTAL OMR 3,250"]
    a, b, c, d, e, f, g = extract_receipts(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    assert (a.merchant, str(a.date), a.invoice_number, a.payment_method, a.currency, a.total, a.subtotal, a.tax) == ("MONOPRIX", "2026-10-12", "4521", "card", "TND", 47.85, 40.21, 7.64)
    assert a.confidence.total >= 0.97 and a.confidence.tax >= 0.9 and a.overall > 0.85
    assert (b.total, b.tax) == (48.85, 7.64) and b.confidence.tax >= 0.9
    assert c.tax == 7.64 and c.confidence.tax < 0.7
    assert (d.total, e.total, e.tax, e.currency, f.total, g.total) == (54.6, 47.85, 7.64, None, 1500, 3.25)


def test_extraction_reads_words_not_parts_of_them(spark):
    texts = ["Shop\nCardigan 5.00\nCASH", "Shop\nMinibar 3.00\npaid in coins", "Shop\nAPPLE PAY", "Shop\nTicket DT-4521\nTotal 12.50", "Shop\nTotal 47,850DT", "Shop\nMontant en Dinars Tunisiens : 47,850", "Shop\nOUTDT 5\nTotal 12.50", "Shop\ntotal 5 dt"]
    rows = extract_receipts(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    assert [(r.payment_method, r.confidence.payment_method) for r in rows[:3]] == [("cash", 0.88), (None, None), ("card", 0.8)]
    assert [r.currency for r in rows[3:]] == [None, "TND", "TND", None, None]


def test_assignment_is_sequential_greedy(spark):
    r = random.Random(3)
    pairs = [(g, a, b, float(r.randint(1, 4)), False, r.randint(1, 3)) for g in range(3) for a in range(7) for b in range(7) if r.random() < 0.4]
    df = spark.createDataFrame(pairs, "org int, r_id int, t_id int, score double, escalated boolean, position int")
    got = {(x.org, x.r_id, x.t_id) for x in greedy_assignment(df).where("best").collect()}
    want, used = set(), set()
    for g, a, b, *_ in sorted(pairs, key=lambda p: (-p[3], p[1], p[4], p[5], p[2])):
        if not {(g, "r", a), (g, "t", b)} & used:
            used |= {(g, "r", a), (g, "t", b)}
            want.add((g, a, b))
    assert got == want


def test_duplicate_chain(spark):
    rows = [(1, i, None, "m", None, 10.0 + 0.01 * i, None, f"2026-01-0{i + 1}") for i in range(3)]
    df = spark.createDataFrame(rows, "org int, id int, checksum string, merchant string, date date, total double, invoice string, created_at string").withColumn("date", F.to_date("created_at"))
    assert [(x.id, x.original) for x in flag_duplicates(df).collect()] == [(1, 0)]


@pytest.mark.parametrize("text", [None, "", "{", "null", "[]"])
def test_config_defaults(text):
    assert MatchingConfig.from_json(text) == MatchingConfig()


def test_config_overrides():
    c = MatchingConfig.from_json('{"weights": {"amount": 0.1, "merchant": 0.6}, "extra": 1}')
    assert c.weights.amount == 0.1 and c.weights.date == 0.2 and not c.problems()


def test_labels_that_others_hold_are_not_sought():
    from tallyspark.operators.extract import shortest

    assert shortest(("total ttc", "grand total", "total", "totale", "sous-total", "paid")) == ("total", "paid")
    # as words of their own: total is none in totale
    assert shortest(("total ttc", "grand total", "total", "totale", "sous-total", "paid"), whole=True) == ("total", "totale", "paid")
