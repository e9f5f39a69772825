import sys
import unicodedata

from pyspark.sql import functions as F

from tallyspark.functions.text import MARKED, normalize_description, normalize_merchant, strip_marks
from tallyspark.sources import statements
from tallyspark.sources.documents import extract_documents, receipt_pdf
from tallyspark.sources.statements import commit_imports, parse_files, preview_statements, read_layouts

FILES = "org long, file string, content string, account_name string"
ONE = "date,description,amount\n2026-01-02,SHOP A,-5.00\n2026-01-03,SHOP B,-6.00\n"
TWO = "Date operation;Libelle;Debit;Credit\n02/01/2026;Boulangerie;7,50;\n"


def bring_in(spark, rows, force=False, known=()):
    none = lambda schema: spark.createDataFrame([], schema)
    seen = spark.createDataFrame(list(known), "org long, checksum string")
    return commit_imports(spark.createDataFrame(rows, FILES), seen, none("org long, fingerprint string"), none("org long, account_name string"), none("org long, name string"), force=force)


def test_files_of_one_name_do_not_mix(spark):
    out = bring_in(spark, [(1, "statement.csv", ONE, None), (2, "statement.csv", TWO, "Card"), (1, "statement.csv", TWO, None)])
    got = sorted((r.org, r.description_raw, r.amount, r.account_name) for r in out["transactions"].collect())
    assert got == [(1, "Boulangerie", -7.5, "Main account"), (1, "SHOP A", -5.0, "Main account"), (1, "SHOP B", -6.0, "Main account"), (2, "Boulangerie", -7.5, "Card")]
    assert sorted((r.org, r.row_count, r.imported) for r in out["imports"].collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    assert out["issues"].count() == 0


def test_equal_files_of_a_batch_are_blocked_unless_forced(spark):
    rows = [(1, "a.csv", ONE, None), (1, "b.csv", ONE, None), (2, "a.csv", ONE, None), (1, "a.csv", ONE, None)]
    out = bring_in(spark, rows)
    assert sorted((r.org, r.file, r.imported) for r in out["imports"].collect()) == [(1, "a.csv", 2), (2, "a.csv", 2)]
    assert sorted(r.action for r in out["audit"].where("org = 1").collect()) == ["import.blocked_duplicate", "import.blocked_duplicate", "import.created"]
    # what made no import blocks nothing: each copy is told its issues
    empty = bring_in(spark, [(1, "a.csv", " ", None), (1, "b.csv", " ", None), (1, "c.csv", "Foo;Bar\nx;y\n", None), (1, "d.csv", "Foo;Bar\nx;y\n", None)])
    assert empty["audit"].count() == 0 and sorted((r.file, r.issue) for r in empty["issues"].collect()) == [("a.csv", "empty"), ("b.csv", "empty"), ("c.csv", "missing column"), ("d.csv", "missing column")]
    forced = bring_in(spark, rows, force=True)
    # rows that another file of the batch has are skipped, none is an issue
    assert sorted((r.org, r.file, r.imported, r.skipped) for r in forced["imports"].collect()) == [(1, "a.csv", 0, 2), (1, "a.csv", 2, 0), (1, "b.csv", 0, 2), (2, "a.csv", 2, 0)]
    assert forced["issues"].count() == 0


def test_statements_carry_what_tells_them_apart_and_a_mapping_of_their_own(spark):
    frame = spark.createDataFrame([(1, "x", ONE), (2, "x", TWO), (3, "x", "date,amount\n")], "tenant long, file string, content string")
    got = sorted((r.tenant, r.row_number, r.amount) for r in parse_files(frame).collect())
    assert got == [(1, 2, -5.0), (1, 3, -6.0), (2, 2, -7.5)]
    shown = {r.tenant: (r.total_rows, [x.cells[1] for x in r.first_rows]) for r in preview_statements(frame).collect()}
    assert shown == {1: (2, ["SHOP A", "SHOP B"]), 2: (1, ["Boulangerie"])}
    kind = read_layouts(frame).schema["mapping"].dataType.simpleString()
    swapped = F.expr(f"cast(named_struct('date', 1, 'amount', 3, 'debit', null, 'credit', null, 'description', 1, 'currency', null, 'reference', null) as {kind})")
    own = parse_files(frame.where("tenant = 1").withColumn("mapping", swapped)).collect()
    assert sorted((r.description_raw, r.amount) for r in own) == [("2026-01-02", -5.0), ("2026-01-03", -6.0)]


def test_a_statement_is_split_once_and_guessed_without_a_shuffle(spark):
    frame = spark.createDataFrame([(1, "x", ONE)], "org long, file string, content string")
    plan = parse_files(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Generate") == 1 and "Join" not in plan


def test_answers_of_a_service_stay_with_their_documents(spark):
    rows = spark.createDataFrame([(1, 10, "a.pdf", "Shop One\nTotal EUR 1.50"), (2, 20, "a.pdf", "Shop Two\nTotal EUR 2.50"), (3, 30, "a.pdf", "Shop One\nTotal EUR 1.50")], "org long, id long, file string, said string")
    documents = rows.select("org", "id", "file", receipt_pdf(F.col("said")).alias("content"), F.lit("application/pdf").alias("mime"), F.col("file").alias("name"))
    asked = []

    def remote(frame):
        asked.append(frame.count())
        return frame.select("document", F.concat(F.lit("Remote Shop "), F.regexp_extract(F.decode("content", "ISO-8859-1"), "Shop (One|Two)", 1), F.lit("\nTotal EUR 9.00")).alias("text"))

    got = {(r.org, r.id): (r.provider, r.merchant) for r in extract_documents(documents, remote).collect()}
    assert len(got) == 3 and asked == [2]
    assert {p for p, _ in got.values()} == {"remote"} and got[1, 10] == got[3, 30] and got[1, 10] != got[2, 20]


def test_every_letter_that_decomposes_into_ascii_and_marks_is_folded(spark):
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000]
    want = {}
    for c in letters:
        d = unicodedata.normalize("NFD", c)
        if d != c and d[0].isascii() and all("̀" <= x <= "ͯ" for x in d[1:]):
            want[c] = d[0]
    assert want == MARKED and len(want) > 450
    text = "".join(want)
    assert spark.range(1).select(strip_marks(F.lit(text))).first()[0] == "".join(want.values())


def test_names_in_capitals(spark):
    said = ["ŠKODA AUTO", "Bșc Țara", "ŽABKA ŁÓDŹ", "PHỞ HÀ NỘI", "ÉPICERIE ÇA", "İZMİR ÇAY", "ŐRSÉG ŰR"]
    frame = spark.createDataFrame([(s,) for s in said], "s string").select("s", normalize_description(F.col("s")).alias("d"), normalize_merchant(F.col("s")).alias("m")).collect()
    # L with a stroke has no decomposition
    assert [r.d for r in frame] == ["skoda auto", "bsc tara", "zabka odz", "pho ha noi", "epicerie ca", "izmir cay", "orseg ur"]


def test_rows_brought_in_are_stored_without_what_follows_from_their_descriptions(spark):
    out = bring_in(spark, [(1, "statement.csv", "date,description,amount\n2026-01-02,CARD SHOP ref 77A12,-5.00\n", None)])["transactions"]
    row = out.first()
    assert (row.description_norm, row.merchant_norm, row.payment_method, row.reference) == ("card shop", "card", "card", "77A12")
    # a count and a sum compute none of it, as the stored rows have none
    plan = out.groupBy("org").agg(F.sum("amount"))._jdf.queryExecution().executedPlan().toString()
    assert "merchant_norm" not in plan and "description_norm" not in plan and "amount" in plan
    kept = out._jdf.queryExecution().analyzed().collectLeaves().toString()
    assert "fingerprint" in kept and "merchant_norm" not in kept


def test_imported_rows_are_dealt_once(spark, monkeypatch):
    """By organization and what they repeat; a row that repeats one of its file leaves the first of the batch fresh, and a
    known fingerprint is known as it is written."""
    text = "Date;Libelle;Montant\n2024-01-02;x;-1,00\n2024-01-02;x;-1,00\n2024-01-03;y;-2,00\nbad;z;-1,00\n"
    files = spark.createDataFrame([(1, "a", text, None), (1, "b", text + "\n", None), (2, "a", text, None)], "org long, file string, content string, account_name string")
    known = [statements.fingerprint(F.lit("2024-01-03").cast("date"), F.lit(-2.0), F.lit("y"), "Main account").alias("f")]
    print_ = spark.range(1).select(*known).first().f
    rows, plans = spark.createDataFrame([(1, print_.upper()), (2, print_), (2, "bad"), (2, "34")], "org long, fingerprint string"), []
    real = statements.stored
    monkeypatch.setattr(statements, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]) or real(df))
    none = spark.createDataFrame([], "org long, checksum string, account_name string, name string")
    out = statements.commit_imports(files, none, rows, none, none)
    assert plans[1].count("Exchange hashpartitioning") <= 2
    assert sorted(tuple(r) for r in out["imports"].select("org", "file", "row_count", "imported").collect()) == [(1, "a", 2, 2), (1, "b", 2, 0), (2, "a", 2, 1)]
    assert {r.fingerprint for r in out["transactions"].where("description_raw = 'y'").collect()} == {print_}
