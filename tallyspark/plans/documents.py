"""Queries of documents, statements and outside texts: what is written into them is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import payloads
from tallyspark.functions.money import minor_units
from tallyspark.functions.reasons import breakdown_json as stored_breakdown
from tallyspark.functions.reasons import parse_breakdown, translate_reason
from tallyspark.functions.text import extract_reference, safe_filename
from tallyspark.operators.candidates import capped_pairs
from tallyspark.operators.ingest import ingest_receipts
from tallyspark.operators.score import score_pairs, with_similarity
from tallyspark.plans.matching import SCORED
from tallyspark.plans.registry import query
from tallyspark.session import cut
from tallyspark.sources import demo, documents, statements
from tallyspark.sources.adapters import receipts, table, transactions

#: A statement for each supplier: its lines by order, in the French manner.
LINES = """WITH rows_ AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS c, l_partkey AS part, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) + 1 AS row_number FROM lineitem),
  marked AS (SELECT *, row_number() OVER (PARTITION BY k, date, c, part ORDER BY row_number) AS again FROM rows_)"""
#: Every 25th supplier's file is broken in one of three ways.
BROKEN = "CASE k % 75 WHEN 0 THEN 'empty' WHEN 25 THEN 'not text' ELSE 'missing column' END"


def _statements(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741

    def line(r: Column) -> Column:
        cents = minor_units(r["l_extendedprice"])
        money = F.concat(F.lit("-"), F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
        return F.concat(F.date_format(r["l_shipdate"], "dd/MM/yyyy"), F.lit(';"POS PART ""'), r["l_partkey"].cast("string"), F.lit('"";X";'), money)

    # lines are written where a file's rows have met
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")))
    files = l.groupBy("l_suppkey").agg(rows.alias("rows"))
    k = F.col("l_suppkey")
    whole = F.concat(F.lit("Date operation;Libelle;Montant\n"), F.array_join(F.transform("rows", line), "\n\n"), F.lit("\n"))
    broken = F.when(k % 75 == 0, " \n").when(k % 75 == 25, F.concat(F.lit("\0"), whole)).otherwise("Foo;Bar\nx;y\n")
    return files.select(k.cast("string").alias("file"), F.when(k % 25 == 0, broken).otherwise(whole).alias("content"))


@query(LINES + f""" SELECT CAST(k AS VARCHAR) AS file, CAST(row_number AS BIGINT) AS row_number, date, -c AS cents, 'POS PART "' || part || '";X' AS description_raw, CASE WHEN again > 1 THEN 'repeated row' END AS issue FROM marked WHERE k % 25 <> 0
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 0, NULL, NULL, NULL, {BROKEN.replace("k %", "s_suppkey %")} FROM supplier WHERE s_suppkey % 25 = 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)""")
def statement_rows_typed(spark, sf_dir):
    """The rows of statements, typed, with those that repeat, and an issue for each file that can't be read."""
    found = statements.parse_files(_statements(spark, sf_dir), "EUR", "dmy")
    return found.select("file", F.col("row_number").cast("long"), "date", minor_units(F.col("amount")).alias("cents"), "description_raw", "issue")


@query(LINES + """ SELECT CAST(k AS VARCHAR) AS file, count(*) AS total_rows, CAST(1 AS BIGINT) AS date_at, CAST(2 AS BIGINT) AS said_at, CAST(3 AS BIGINT) AS amount_at, max(CASE WHEN row_number <= 51 AND day(date) > 12 THEN 1 ELSE 0 END) = 0 AS ambiguous,
    string_agg(CASE WHEN row_number <= 6 THEN 'POS PART "' || part || '";X' END, '|' ORDER BY row_number) AS first_rows FROM marked WHERE k % 25 <> 0 GROUP BY k""")
def statement_preview(spark, sf_dir):
    """Each statement's size, guessed columns and first rows."""
    found = statements.preview_statements(_statements(spark, sf_dir).where("cast(file as bigint) % 25 <> 0"))
    at = lambda f: F.col(f"mapping.{f}").cast("long")
    return found.select("file", "total_rows", at("date").alias("date_at"), at("description").alias("said_at"), at("amount").alias("amount_at"), "ambiguous", F.array_join(F.transform("first_rows", lambda r: r["cells"][1]), "|").alias("first_rows"))


@query(LINES + """, good AS (SELECT k, count(*) AS row_count, count(*) FILTER (k % 5 = 0 OR c % 4 <> 0) AS imported FROM marked WHERE again = 1 AND k % 25 <> 0 AND k % 10 <> 7 GROUP BY k)
    SELECT CAST(k AS VARCHAR) AS entity, 'import.created' AS action, k || ': ' || imported || ' imported, ' || (row_count - imported) || ' already present' AS detail, row_count, imported FROM good
    UNION ALL SELECT k, 'import.blocked_duplicate', k, NULL, NULL FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS k FROM lineitem WHERE l_suppkey % 10 = 7)""")
def import_commit(spark, sf_dir):
    """Statements brought in: some files are known, some rows are known to their organization."""
    k = F.col("file").cast("long")
    files = _statements(spark, sf_dir).withColumn("org", k % 5).withColumn("account_name", F.when(k % 2 == 0, "Card"))
    known_rows = statements.parse_files(files.where("org <> 0").select("file", "content"), "EUR").where("issue is null and pmod(cast(floor(abs(amount) * 100 + 0.5) as bigint), 4) = 0")
    account = F.when(F.col("file").cast("long") % 2 == 0, "Card").otherwise("Main account")
    known = known_rows.select((F.col("file").cast("long") % 5).alias("org"), statements.fingerprint(F.col("date"), F.col("amount"), F.col("description_raw"), account).alias("fingerprint"))
    done = files.where(k % 10 == 7).select("org", F.sha2("content", 256).alias("checksum"))
    none = spark.createDataFrame([], "org long, account_name string, name string")
    out = statements.commit_imports(files, done, known, none, none)
    counts = out["imports"].select(F.col("file").alias("entity"), "row_count", "imported")
    trail = out["audit"].select(F.when(F.col("action") == "import.created", F.col("entity_id")).otherwise(F.col("detail")).alias("entity"), "action", "detail")
    return trail.join(counts, "entity", "left").select("entity", "action", "detail", "row_count", "imported")


@query(LINES + """ SELECT k AS org, count(*) AS row_count, CAST(-sum(c) AS BIGINT) AS cents FROM marked WHERE again = 1 AND k % 25 <> 0 GROUP BY k""")
def import_same_names(spark, sf_dir):
    """Statements that are all called alike, each of another organization: rows and sums that each has got."""
    files = _statements(spark, sf_dir).select(F.col("file").cast("long").alias("org"), F.lit("statement.csv").alias("file"), "content", F.lit("").alias("account_name"))
    none = spark.createDataFrame([], "org long, checksum string, fingerprint string, account_name string, name string")
    got = statements.commit_imports(files, none, none, none, none)["transactions"]
    return got.groupBy("org").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"))


# documents

PDF_LINES = "o_orderpriority || chr(10) || 'Invoice (No) ' || o_orderkey || ' \\ A' || chr(10) || 'TOTAL  ' || CAST(o_custkey AS VARCHAR) || '.50 é'"


def _pdfs(spark, sf_dir) -> DataFrame:
    text = F.concat("o_orderpriority", F.lit("\nInvoice (No) "), F.col("o_orderkey").cast("string"), F.lit(" \\ A\nTOTAL  "), F.col("o_custkey").cast("string"), F.lit(".50 é"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), documents.receipt_pdf(text).alias("content"))


@query(f"SELECT o_orderkey AS id, {PDF_LINES} AS text FROM orders")
def pdf_text_layer(spark, sf_dir):
    """The text of PDFs made from orders, read back from their content streams."""
    return _pdfs(spark, sf_dir).select("id", documents.pdf_text_column(F.col("content")).alias("text"))


@query("""WITH up AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k FROM orders) SELECT id, CASE k WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'application/pdf' WHEN 7 THEN 'application/pdf' END AS mime,
    CASE k WHEN 4 THEN 'empty' WHEN 5 THEN 'unknown type' WHEN 6 THEN 'unknown type' WHEN 7 THEN 'too large' END AS problem, k = 3 AS active, 'scan__' || id || '_.pdf' AS name FROM up""")
def upload_gate(spark, sf_dir):
    """What the gate says of uploads of eight kinds."""
    k = F.col("o_orderkey") % 8
    heads = ("FFD8FFE000", "89504E470D0A1A0A00", "524946460000000057454250", "255044462D312E34202F4F70656E416374696F6E", "", "3C7363726970743E", "52494646000000005741564500", "255044462D" + "20" * 200)
    content = F.lit(None).cast("binary")
    for i, head in enumerate(heads):
        content = F.when(k == i, F.unhex(F.lit(head))).otherwise(content)
    name = F.concat(F.lit("../x/scan: "), F.col("o_orderkey").cast("string"), F.lit("é.pdf"))
    found = documents.gate(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), content.alias("content"), name.alias("name")), 100)
    return found.select("id", "mime", "problem", "active", F.regexp_replace("name", "scan_ ", "scan__").alias("name"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'C_scans_M_ller_ S_hne.png' WHEN 1 THEN 'receipt' ELSE 'a b-c_d.' || o_orderkey END AS name FROM orders""")
def cleaned_filenames(spark, sf_dir):
    """File names without paths and odd characters."""
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "C:\\scans\\Müller: Söhne.png").when(k % 3 == 1, "").otherwise(F.concat(F.lit("/tmp/a b-c_d."), k.cast("string")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), safe_filename(raw).alias("name"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'application/pdf' WHEN o_orderkey % 4 = 1 THEN 'text/plain' ELSE 'image/png' END AS mime, CASE WHEN o_orderkey % 4 < 2 THEN o_custkey * 100 + 50 END AS cents, CASE WHEN o_orderkey % 4 = 3 THEN 'remote' ELSE 'local' END AS provider,
    o_orderkey % 4 <> 2 AS readable FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3)""")
def documents_extracted(spark, sf_dir):
    """Fields of documents by type: PDFs and texts are read here, images only by a service, which knows a quarter of them."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Shop Ltd\nSome words here\nTotal EUR "), F.col("o_custkey").cast("string"), F.lit(".50"))
    content = F.when(k % 4 == 0, documents.receipt_pdf(text)).when(k % 4 == 1, F.encode(text, "UTF-8")).otherwise(F.unhex(F.lit("89504E470D0A1A0A")))
    mime = F.when(k % 4 == 0, "application/pdf").when(k % 4 == 1, "text/plain").otherwise("image/png")
    rows = o.select(k.alias("file"), content.alias("content"), mime.alias("mime"), F.lit("x.bin").alias("name"))
    found = documents.extract_documents(rows, lambda asked: asked.where("file % 4 = 3").select("document", F.lit("Read by a service").alias("text")))
    return found.select(F.col("file").alias("id"), "mime", minor_units(F.col("total")).alias("cents"), "provider", (F.col("merchant").isNotNull()).alias("readable"))


# outside texts


@query("""SELECT event_id, event_type AS merchant, CASE WHEN event_id % 3 = 0 THEN '2024-02-01' END AS date, CAST(user_id * 100 + 25 AS BIGINT) AS cents, 'EUR' AS currency, CASE WHEN event_id % 2 = 0 THEN 100 ELSE 80 END AS sure, CAST(1 AS BIGINT) AS n_items FROM events WHERE event_id % 5 <> 4
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 5 = 4""")
def coerced_answers(spark, sf_dir):
    """Services' answers, in prose around a JSON object, as typed fields; a broken one has none."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    date = F.when(k % 3 == 0, "2024-02-01").otherwise("Feb 1")
    sure = F.when(k % 2 == 0, "7").otherwise('"0.8"')
    body = F.concat(F.lit('{"merchant": " '), "event_type", F.lit(' ", "date": "'), date, F.lit('", "total": "EUR '), F.col("user_id").cast("string"), F.lit('.25", "currency": "euros", "note": "a } \\" {", "confidence": {"total": '), sure, F.lit('}, "items": [{"description": ""}, {"description": "x", "quantity": 2}]}'))
    said = F.when(k % 5 == 4, F.concat(F.lit("Sorry: {"), "event_type", F.lit("} {}"))).otherwise(F.concat(F.lit("Here it is:\n"), F.regexp_replace(body, "euros", "eur"), F.lit(" and {more}")))
    found = e.select("event_id", payloads.first_object(said).alias("object")).select("event_id", payloads.coerce_answer(F.col("object")).alias("a"))
    return found.select("event_id", "a.merchant", "a.date", minor_units(F.col("a.total")).alias("cents"), "a.currency", F.floor(F.col("a.confidence.total") * 100 + F.lit(0.5)).cast("int").alias("sure"), F.when(F.col("a").isNotNull(), F.size("a.items")).cast("long").alias("n_items"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE '10.0.0.' || user_id END AS one, CASE WHEN user_id % 3 = 2 THEN '1.2.3.' || user_id ELSE 'unknown' END AS two, 'local' AS none FROM events""")
def client_addresses(spark, sf_dir):
    """Callers' addresses behind one, two and no trusted proxies."""
    u = F.col("user_id").cast("string")
    chain = F.when(F.col("user_id") % 3 == 0, " , ").when(F.col("user_id") % 3 == 1, F.concat(F.lit("10.0.0."), u)).otherwise(F.concat(F.lit("9.9.9.9, 1.2.3."), u, F.lit(", 10.0.0."), u))
    return table(spark, sf_dir, "events").select("event_id", *(payloads.client_ip(chain, hops).alias(n) for hops, n in ((1, "one"), (2, "two"), (0, "none"))))


@query("""SELECT event_id, 'GET' AS method, '/r/' || user_id AS url, CASE WHEN event_type = 'error' THEN 'Database query failed' ELSE event_type END AS message, CASE WHEN event_type = 'error' THEN 'Database query failed' ELSE 'x' END AS first FROM events""")
def scrubbed_events(spark, sf_dir):
    """Error events without people, queries and parameters."""
    bad = F.when(F.col("event_type") == "error", F.lit("Failed query: select 1 -- ann@example.com"))
    request = F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/r/"), F.col("user_id").cast("string"), F.lit("?token=1")).alias("url"), F.lit("c").alias("cookies"))
    event = F.struct(F.col("user_id").alias("user"), F.lit("m1").alias("server_name"), request.alias("request"), F.coalesce(bad, "event_type").alias("message"), F.array(F.coalesce(bad, F.lit("x"))).alias("exception"), F.lit("b").alias("breadcrumbs"))
    found = table(spark, sf_dir, "events").select("event_id", payloads.scrub_event(event).alias("e"))
    return found.select("event_id", "e.request.method", "e.request.url", "e.message", F.col("e.exception")[0].alias("first"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'CHF' WHEN c_custkey % 4 = 1 THEN 'EUR' WHEN c_custkey % 3 = 0 THEN 'TND' ELSE 'USD' END AS currency, c_custkey % 2 = 0 AND NOT (c_custkey % 4 = 2 AND c_custkey % 3 = 0) AS warns FROM customer""")
def import_currencies(spark, sf_dir):
    """The currency each import starts with, and whether amounts that look like dinars contradict it."""
    k = F.col("c_custkey")
    account = F.when(k % 4 == 0, " chf ").when(k % 4 == 1, "€")
    chosen = payloads.default_currency(account, F.when(k % 4 == 1, "eur").when(k % 4 == 2, "12"), k % 3 == 0)
    return table(spark, sf_dir, "customer").select(k.alias("id"), chosen.alias("currency"), payloads.warns_of_dinars(k % 2 == 0, chosen).alias("warns"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'INV-' || o_orderkey WHEN 1 THEN 'A' || o_orderkey || 'B' WHEN 2 THEN NULL ELSE 'X-9' END AS reference FROM orders""")
def extracted_references(spark, sf_dir):
    """References that bank texts carry, in capitals."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    said = F.when(k % 4 == 0, F.concat(F.lit("PAYMENT REF INV-"), n)).when(k % 4 == 1, F.concat(F.lit("transfer order: a"), n, F.lit("b thanks"))).when(k % 4 == 2, F.concat(F.lit("PREFERENCE "), n)).otherwise(F.lit("Ord.#x-9"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), extract_reference(said).alias("reference"))


_KIND = "CASE id % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'later' WHEN 2 THEN 'more' WHEN 3 THEN 'receipt_only' WHEN 4 THEN 'duplicate' ELSE 'bank_only' END"


@query(f"""WITH e AS (SELECT c_custkey // 60 AS org, c_custkey % 60 AS id, {_KIND.replace('id %', '(c_custkey % 60) %')} AS kind FROM customer) SELECT org, id, kind, CASE kind WHEN 'duplicate' THEN 'needs_review' WHEN 'receipt_only' THEN 'unmatched' ELSE 'completed' END AS status,
    kind = 'duplicate' AS is_duplicate, CASE kind WHEN 'duplicate' THEN id - 1 END AS duplicate_of, CASE WHEN kind IN ('exact', 'later', 'more') THEN 'auto' END AS matched FROM e WHERE kind <> 'bank_only'""")
def ingested_documents(spark, sf_dir):
    """PDF receipts and statements from file to match, sixty customers an organization: extraction, merchants, repeats,
    scores, assignment, states. All statements are called alike."""
    k = F.col("c_custkey")
    found = demo.described(table(spark, sf_dir, "customer").select(F.expr("c_custkey div 60").alias("org"), (k % 60).alias("id")))
    none = lambda schema: spark.createDataFrame([], schema)
    names = found.select("org").distinct().select("org", F.explode(F.array(F.lit("Food"), F.lit("Software"))).alias("name"))
    bank = statements.commit_imports(demo.statement(found), none("org long, checksum string"), none("org long, fingerprint string"), none("org long, account_name string"), names)
    t = bank["transactions"].select("org", F.col("row_number").cast("long").alias("id"), F.col("merchant_norm").alias("merchant"), "date", "amount", "currency", F.col("payment_method").alias("payment"))
    earlier = none("org long, id long, checksum string, merchant string, date date, total double, currency string, payment string, invoice string, category string, is_duplicate boolean, duplicate_of long, status string, created_at timestamp_ntz, overall double")
    out = ingest_receipts(demo.receipts(found), earlier, cut(t), none("org long, r_id long, t_id long, score double, status string"), none("org long, merchant_id string, name string, normalized string"), names, similarity=with_similarity)
    best = out["matches"].where("status in ('auto', 'suggested')").select("org", F.col("r_id").alias("id"), F.col("status").alias("matched"))
    return out["receipts"].join(found.select("org", "id", "kind"), ["org", "id"]).join(best, ["org", "id"], "left").select("org", "id", "kind", "status", "is_duplicate", "duplicate_of", "matched")


# reasons


def _explained(spark, sf_dir) -> DataFrame:
    pairs = capped_pairs(receipts(spark, sf_dir), transactions(spark, sf_dir))
    scored = score_pairs(pairs.withColumn("similarity", F.lit(None).cast("double"))).withColumn("method", F.lit("deterministic"))
    return scored.select("org", "r_id", "t_id", stored_breakdown().alias("breakdown"))


_DELTA = "CAST(abs(cents - t_cents) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(cents - t_cents) % 100 AS VARCHAR), 2, '0')"
_DAYS = "abs(t_date - r_date)"
AMOUNT_SAID = "CASE WHEN total IS NULL THEN {0} WHEN abs(cents - t_cents) <= 1 THEN {1} ELSE {2} || " + _DELTA + " END"
DATE_SAID = "CASE WHEN r_date IS NULL THEN {0} WHEN t_date = r_date THEN {1} ELSE {2} || " + _DAYS + " || CASE WHEN " + _DAYS + " = 1 THEN {3} ELSE {4} END || CASE WHEN t_date > r_date THEN {5} ELSE {6} END || {7} END"
ENGLISH = ("'Receipt total missing'", "'Exact amount'", "'Amounts differ by '"), ("'Receipt date missing'", "'Same date'", "'Transaction '", "' day '", "' days '", "'after'", "'before'", "' receipt'")
FRENCH_FORMS = ("'Total du justificatif manquant'", "'Montant exact'", "'Les montants diffèrent de '"), ("'Date du justificatif manquante'", "'Même date'", "'Opération '", "' jour '", "' jours '", "'après'", "'avant'", "' le justificatif'")


def _said(forms) -> str:
    return f"{AMOUNT_SAID.format(*forms[0])} AS amount_said, {DATE_SAID.format(*forms[1])} AS date_said"


def _signal(name: str) -> Column:
    return F.element_at(F.filter("b.signals", lambda s: s["name"] == name), 1)


@query(SCORED + f""" SELECT org, r_id, t_id, tenths, classification, CASE veto WHEN 'amount' THEN 'Amounts are too far apart' WHEN 'currency' THEN 'Currency mismatch: needs a human' WHEN 'date' THEN 'Dates are outside the tolerance window' END AS veto,
    {_said(ENGLISH)}, CAST(floor(coalesce(s_amount, 0) * 100 + 0.5) AS BIGINT) AS amount_score, s_amount IS NOT NULL AS amount_applies, coalesce(s_amount >= 0.5, FALSE) AS amount_positive,
    CASE WHEN s_currency = 1 THEN 'Same currency (' || t_currency || ')' ELSE 'Currency mismatch: ' || r_currency || ' vs ' || t_currency END AS currency_said,
    CASE WHEN s_payment IS NULL THEN 'Payment method unknown' WHEN s_payment = 1 THEN 'Both paid by ' || t_payment ELSE 'Payment method differs: ' || r_payment || ' vs ' || t_payment END AS payment_said FROM scored""")
def breakdown_json(spark, sf_dir):
    """The breakdown of each candidate pair, stored as JSON and read back."""
    rows = _explained(spark, sf_dir).withColumn("b", parse_breakdown(F.col("breakdown")))
    amount = _signal("amount")
    return rows.select(
        "org", "r_id", "t_id", F.floor(F.col("b.score") * 10 + F.lit(0.5)).cast("long").alias("tenths"), "b.classification", "b.veto", amount["reason"].alias("amount_said"), _signal("date")["reason"].alias("date_said"), amount["score"].alias("amount_score"),
        amount["applicable"].alias("amount_applies"), amount["positive"].alias("amount_positive"), _signal("currency")["reason"].alias("currency_said"), _signal("paymentMethod")["reason"].alias("payment_said"),
    )


@query(SCORED + f" SELECT org, r_id, t_id, {_said(FRENCH_FORMS)}, 'Commerçant indisponible' AS merchant_said FROM scored")
def translated_reasons(spark, sf_dir):
    """Why each candidate pair scored so, in French."""
    rows = _explained(spark, sf_dir).withColumn("b", parse_breakdown(F.col("breakdown")))
    said = rows.select("org", "r_id", "t_id", *(_signal(name)["reason"].alias(f"{name}_said") for name in ("amount", "date", "merchant")))
    return said.select("org", "r_id", "t_id", *(translate_reason(F.col(c)).alias(c) for c in ("amount_said", "date_said", "merchant_said")))
