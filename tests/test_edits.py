import datetime

from tallyspark.operators.actions import edit_receipts
from tallyspark.operators.extract import recomputed

AT = datetime.datetime(2026, 1, 5)
DAY = datetime.date(2026, 1, 5)
RECEIPTS = "org long, id long, checksum string, merchant string, merchant_raw string, date date, total double, currency string, payment string, invoice string, category string, is_duplicate boolean, duplicate_of long, status string, created_at timestamp_ntz"
EDITS = "org long, id long, merchant string, total double, cleared array<string>, is_duplicate boolean, rematch boolean"


def receipts(spark):
    names = ["", "alpha bakery", "bravo", "cedar", "delta garage", "echo"]
    rows = [(1, i, f"c{i}", names[i], names[i].title(), DAY, 10.0 * i, "EUR", "card", None, "Food", False, None, "unmatched", AT + datetime.timedelta(hours=i)) for i in range(1, 6)]
    rows[4] = (*rows[4][:11], True, 1, "needs_review", rows[4][14])
    other = (2, 3, "c3", "alpha bakery", "Alpha Bakery", DAY, 10.0, "EUR", "card", None, None, False, None, "unmatched", AT)
    return spark.createDataFrame([*rows, other], RECEIPTS)


def test_an_edit_as_the_product_has_it(spark):
    edits = [
        (1, 1, None, 11.5, None, None, None),  # another amount
        (1, 2, None, None, ["total", "payment"], None, None),  # emptied
        (1, 3, "POS ALPHA BAKERY #22", 11.5, None, None, None),  # now a repeat of 1
        (1, 4, None, 11.5, None, None, False),  # not matched again
        (1, 5, None, None, None, False, None),  # the flag is lowered, nothing else
    ]
    t = spark.createDataFrame([(1, 100, "alpha bakery", DAY, -11.5, "EUR", "card"), (1, 101, "delta garage", DAY, -11.5, "EUR", "card"), (1, 102, None, DAY, -50.0, "EUR", "card")], "org long, id long, merchant string, date date, amount double, currency string, payment string")
    none = spark.createDataFrame([], "org long, r_id long, t_id long, score double, status string")
    out = edit_receipts(receipts(spark), spark.createDataFrame(edits, EDITS), "ann", transactions=t, matches=none)
    rows = {(r.org, r.id): r for r in out["receipts"].collect()}
    assert len(rows) == 6
    assert (rows[1, 1].total, rows[1, 1].edited_by_user, rows[1, 1].status) == (11.5, True, "completed")
    assert (rows[1, 2].total, rows[1, 2].payment, rows[1, 2].merchant) == (None, None, "bravo")
    assert (rows[1, 3].merchant, rows[1, 3].merchant_raw, rows[1, 3].is_duplicate, rows[1, 3].duplicate_of) == ("alpha bakery", "POS ALPHA BAKERY #22", True, 1)
    assert not rows[1, 4].is_duplicate and rows[1, 4].status == "unmatched"
    assert (rows[1, 5].is_duplicate, rows[1, 5].duplicate_of, rows[1, 5].edited_by_user) == (False, None, False)
    assert (rows[2, 3].total, rows[2, 3].edited_by_user) == (10.0, False)
    trail = sorted((int(r.entity_id), r.action, r.detail) for r in out["audit"].where("action like 'receipt%'").collect())
    assert trail == [(1, "receipt.edited", "edited total"), (2, "receipt.edited", "edited total, payment"), (3, "receipt.edited", "edited merchant, total"), (4, "receipt.edited", "edited total"), (5, "receipt.duplicate_cleared", None)]
    assert sorted(r.id for r in out["rematch"].collect()) == [1, 2, 3]
    assert (1, 100) in {(r.r_id, r.t_id) for r in out["matches"].where("status = 'auto'").collect()} and out["matches"].where("r_id in (3, 4, 5)").count() == 0


def test_confidence_after_an_edit(spark):
    schema = "org long, r_id long, merchant string, date date, total double, currency string, confidence struct<merchant double, date double, total double, currency double>, overall double"
    rows = [(1, 1, "a", DAY, 5.0, "EUR", (0.5, 0.8, 0.4, 0.9), 0.5), (1, 2, "a", DAY, 5.0, "EUR", (0.5, 0.8, None, 0.9), 0.5), (1, 3, "a", DAY, 5.0, "EUR", (0.5, 0.8, 0.4, 0.9), 0.5)]
    edits = spark.createDataFrame([(1, 1, 7.0, None), (1, 2, None, ["merchant"])], "org long, r_id long, total double, cleared array<string>")
    got = {r.r_id: r for r in recomputed(spark.createDataFrame(rows, schema), edits, ("merchant", "date", "total", "currency")).collect()}
    assert (got[1].total, got[1].overall, got[1].edited_by_user) == (7.0, 0.815, True)
    # merchant counts 0, total without confidence a half
    assert (got[2].merchant, got[2].overall) == (None, 0.49)
    assert (got[3].overall, got[3].edited_by_user) == (0.5, False)
