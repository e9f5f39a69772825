"""Fields of receipt texts with confidences, as Column expressions over the lines of each text.

Each text is folded and split once, and each line's numbers are read once, into an array of structs from which
all fields choose.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import full_year, month_number
from tallyspark.functions.money import is_three_decimal, parse_amount, round_up
from tallyspark.functions.tables import (
    ADDRESS_WORDS, CAPITALS_ONLY_CODES, CURRENCY_CODES, CURRENCY_SYMBOLS, HEADING_WORDS, INVOICE_WORDS, RECEIPT_PAYMENT_WORDS, STAMP_LABELS, SUBTOTAL_LABELS, TAX_LABELS, TOTAL_LABELS,
)
from tallyspark.functions.text import EDGE, END, SPACE, START, let, strip_marks

_GAP = SPACE[1:-1]
#: A number with separators and spaces in it.
NUMBER = rf"-?[0-9][0-9.,{_GAP}]*[0-9]|[0-9]"
#: Amounts from here on are no money.
LARGEST = 10_000_000
MAX_ITEMS = 40
#: How sure a field is. Fixed values.
SURE = {
    "code": 0.96, "symbol": 0.9, "capitals": 0.93, "name": 0.82, "labelled_invoice": 0.88, "bare_invoice": 0.75, "items": 0.7, "largest": 0.45, "derived_tax": 0.6, "odd_tax": 0.55,
    "total": (0.98, 0.86), "subtotal": (0.93, 0.8), "tax": (0.9, 0.72), "checked_total": 0.99, "checked_part": 0.97,
}


def _any(words) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def shortest(words: tuple[str, ...], whole: bool = False) -> tuple[str, ...]:
    """The words that hold no other, with `whole` as a word of its own: one of these stands in a text, or is a word of it,
    where any of `words` does."""
    holds = lambda w, o: re.search(rf"\b{re.escape(o)}\b", w, re.ASCII) if whole else o in w
    return tuple(w for w in dict.fromkeys(words) if not any(other != w and holds(w, other) for other in words))


def lines_of(text: Column) -> Column:
    """Lines that are not blank; a tab is two spaces."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.replace(x, F.lit("\t"), F.lit("  "))), lambda x: x.rlike(rf"[^{_GAP}]"))


def _named(text: Column, codes: tuple[str, ...], flags: str) -> Column:
    """The first of the codes, in their order, that stands in the text as a word."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"{flags}(?=[{''.join(sorted({c[0] for c in codes}))}]){START}({'|'.join(codes)}){END}"), F.lit(1)), lambda c: F.upper(c))
    return let(found, lambda f: F.try_element_at(F.array_intersect(F.array(*(F.lit(c) for c in codes)), f), F.lit(1)))


def currency_of(text: Column) -> Column:
    """The currency that a text names: codes, capital codes, symbols, dinar words."""
    return let(_currency(text), lambda c: c["code"])


def _currency(text: Column) -> Column:
    """(code, sure); code is null where none is named. Signs are looked for where there is no code."""
    word = F.coalesce(_named(text, CURRENCY_CODES, "(?i)"), _named(text, CAPITALS_ONLY_CODES, ""))
    sign = F.lit(None).cast("string")
    sign = F.when(text.rlike(rf"[0-9][{_GAP}]*(?:DT|DTN)(?![A-Za-z0-9_])|(?i:{EDGE}dinars?[{_GAP}]+tunisiens?{EDGE})"), "TND").otherwise(sign)
    for symbol, code in reversed(CURRENCY_SYMBOLS):
        sign = F.when(F.contains(text, F.lit(symbol)), code).otherwise(sign)
    found = lambda code, sure: F.struct(code.alias("code"), F.when(code.isNotNull(), sure).alias("sure"))
    return let(word, lambda w: F.when(w.isNotNull(), found(w, SURE["code"])).otherwise(let(sign, lambda s: found(s, SURE["symbol"]))))


def page_three_decimal(text: Column) -> Column:
    """Two amounts or more with three decimals and none with two, percentages aside."""
    three = F.regexp_count(text, F.lit(r"(?<![0-9.,])[0-9]{1,6}[.,][0-9]{3}(?![0-9.,])"))
    two = text.rlike(rf"(?<![0-9.,])[0-9]{{1,6}}[.,][0-9]{{2}}(?![0-9.,]|[{_GAP}]*%)")
    return (three >= 2) & ~two


def amounts_on(line: Column, three: Column) -> Column:
    """Numbers on a line below ten million."""
    found = F.regexp_extract_all(line, F.lit(f"({NUMBER})"), F.lit(1))
    return F.filter(F.transform(found, lambda t: parse_amount(t, three)), lambda v: v.isNotNull() & (F.abs(v) < LARGEST))


def labelled(rows: Column, labels: tuple[str, ...]) -> Column:
    """(value, exact) of the lowest of `rows` (folded, nums, below) that has one of the labels and a number: its last;
    exact if the line begins with its longest label. Else the number on the line below the lowest label; null without.
    """
    hits = F.filter(rows, lambda r: r["folded"].rlike(_any(shortest(labels))))
    longest_first = F.array(*(F.lit(x) for x in sorted(labels, key=len, reverse=True)))

    def on_line(r: Column) -> Column:
        longest = F.element_at(F.filter(longest_first, lambda x: F.contains(r["folded"], x)), 1)
        return F.struct(F.element_at(r["nums"], -1).alias("value"), F.startswith(F.ltrim(r["folded"]), longest).alias("exact"))

    def choose(h: Column) -> Column:
        own = F.try_element_at(F.filter(h, lambda r: F.size(r["nums"]) > 0), F.lit(-1))
        below = F.try_element_at(F.filter(h, lambda r: (F.size(r["nums"]) == 0) & (F.size(r["below"]) > 0)), F.lit(-1))
        return F.when(own.isNotNull(), let(own, on_line)).when(below.isNotNull(), F.struct(F.element_at(below["below"], -1).alias("value"), F.lit(False).alias("exact")))

    return let(hits, choose)


def receipt_date(folded: Column, currency: Column) -> Column:
    """(date, sure) of the first date of a folded text, by the least ambiguous form; ambiguous numeric dates are month
    first with dollars. Null without."""
    start, end = rf"(?=[0-9]){START}", END
    forms = {
        "iso": rf"{start}([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}){end}", "first": rf"{start}([0-9]{{4}})[/.]([0-9]{{1,2}})[/.]([0-9]{{1,2}}){end}",
        "dmy": rf"{start}([0-9]{{1,2}})[{_GAP}.\-]+([a-z]{{3,12}})\.?[{_GAP}.,\-]+([0-9]{{2,4}}){end}", "mdy": rf"(?=[a-z]){START}([a-z]{{3,12}})\.?[{_GAP}]+([0-9]{{1,2}})(?:st|nd|rd|th)?[{_GAP},]+([0-9]{{2,4}}){end}",
        "numeric": rf"{start}([0-9]{{1,2}})[/.\-]([0-9]{{1,2}})[/.\-]([0-9]{{2,4}}){end}",
    }

    def found(form: str, body) -> Column:
        # the text is searched once for a form, and its parts are taken where it has it
        parts = lambda m: F.struct(*(F.regexp_extract(m, forms[form], i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))))
        return let(F.regexp_extract(folded, forms[form], 0), lambda m: F.when(m != "", let(parts(m), body)))

    def dated(year: Column, month: Column, day: Column, sure) -> Column:
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        date = let(year, lambda y: F.when(y.between(1990, 2100), F.concat(y.cast("string"), F.lit("-"), two(month), F.lit("-"), two(day)).try_cast("date")))
        return let(date, lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), (F.lit(sure) if isinstance(sure, float) else sure).alias("sure"))))

    num = lambda c: c.try_cast("int")

    def numeric(p: Column) -> Column:
        def read(n: Column) -> Column:
            a, b = n["a"], n["b"]
            settled = ((a > 12) & (b <= 12)) | ((b > 12) & (a <= 12))
            american = F.when(settled, b > 12).otherwise(F.coalesce(currency == "USD", F.lit(False)))
            return dated(full_year(n["c"]), F.when(american, a).otherwise(b), F.when(american, b).otherwise(a), F.when(settled, 0.96).otherwise(0.72))

        return let(F.struct(*(num(p[n]).alias(n) for n in "abc")), read)

    return F.coalesce(
        found("iso", lambda p: dated(num(p["a"]), num(p["b"]), num(p["c"]), 0.99)), found("first", lambda p: dated(num(p["a"]), num(p["b"]), num(p["c"]), 0.97)),
        found("dmy", lambda p: dated(full_year(num(p["c"])), month_number(p["b"]), num(p["a"]), 0.97)), found("mdy", lambda p: dated(full_year(num(p["c"])), month_number(p["a"]), num(p["b"]), 0.97)), found("numeric", numeric),
    )


def merchant_line(lines: Column) -> Column:
    """(name, sure) of the first of eight lines that looks like a name: no heading, address, phone number or postcode."""
    number_run, postcode = rf"^\+?[0-9{_GAP}()./\-]{{6,}}\z", r"^[0-9].*[0-9]{4}|^[0-9]{4}"

    def plausible(x: Column) -> Column:
        bad = rf"(?i)^(?:{_any(HEADING_WORDS)}){EDGE}|{EDGE}(?:{'|'.join(ADDRESS_WORDS)}){EDGE}"
        return F.length(x).between(2, 60) & ~x.rlike(bad) & ~x.rlike(number_run) & ~x.rlike(postcode) & x.rlike("[A-Za-z][^A-Za-z]*[A-Za-z]")

    trimmed = F.transform(F.slice(lines, 1, 8), lambda x: F.regexp_replace(x, rf"^[{_GAP}]+|[{_GAP}]+\z", ""))
    shouted = lambda x: (x == F.upper(x)) & x.rlike("(?:[A-Za-z][^A-Za-z]*){3}")
    # the lines behind the first are not judged
    first = F.aggregate(trimmed, F.lit(None).cast("string"), lambda found, x: F.when(found.isNotNull(), found).when(plausible(x), x))
    return let(first, lambda x: F.when(x.isNotNull(), F.struct(F.regexp_replace(x, rf"[{_GAP}]{{2,}}", " ").alias("name"), F.when(shouted(x), SURE["capitals"]).otherwise(SURE["name"]).alias("sure"))))


def invoice_number(text: Column) -> Column:
    """(number, sure) in capitals: the one after a label, if it has a digit, else a bare INV number; null without."""
    label = rf"(?i){EDGE}(?:{'|'.join(INVOICE_WORDS)}){EDGE}(?:[{_GAP}]|[.#:_\-]|n[o°]\.?|nr\.?|no\.?|number)*([a-z0-9][a-z0-9/\-]{{2,24}}){EDGE}"
    parts = F.struct(F.regexp_extract(text, label, 1).alias("said"), F.regexp_extract(text, rf"(?i){EDGE}(INV[\-/]?[0-9]{{3,12}}){EDGE}", 1).alias("bare"))
    pick = lambda c, sure: F.struct(F.upper(c).alias("number"), F.lit(sure).alias("sure"))
    return let(parts, lambda p: F.when(p["said"].rlike("[0-9]"), pick(p["said"], SURE["labelled_invoice"])).when(p["bare"] != "", pick(p["bare"], SURE["bare_invoice"])))


def payment_of(folded: Column) -> Column:
    """(method, sure) by the first group of words of which one stands in the folded text; null without."""
    return F.coalesce(*(F.when(folded.rlike(f"{START}(?:{words}){END}"), F.struct(F.lit(method).alias("method"), F.lit(sure).alias("sure"))) for method, words, sure in RECEIPT_PAYMENT_WORDS))


def items_of(rows: Column, three: Column) -> Column:
    """Up to 40 line items (description, quantity, unit_price): `n x name  price` or `name  price`, off the label lines."""
    labels = f"{EDGE}(?:{_any(shortest((*TOTAL_LABELS, *SUBTOTAL_LABELS, *TAX_LABELS), whole=True))}){EDGE}"
    many = rf"^[{_GAP}]*([0-9]{{1,3}})[{_GAP}]*[xX*][{_GAP}]*(.+?)[{_GAP}]{{2,}}([0-9.,]+)[{_GAP}]*\z"
    plain = rf"^[{_GAP}]*(.{{2,40}}?)[{_GAP}]{{2,}}([0-9.,]+)[{_GAP}]*\z"

    def item(r: Column) -> Column:
        x = r["line"]
        several = x.rlike(many)
        parts = F.struct(F.regexp_extract(x, many, 1).try_cast("int").alias("n"), F.trim(F.regexp_extract(x, many, 2)).alias("name"), parse_amount(F.regexp_extract(x, many, 3), three).alias("total"))
        of_many = let(parts, lambda p: F.struct(p["name"].alias("description"), p["n"].alias("quantity"), F.when(p["n"] > 0, round_up(p["total"] / p["n"], 2)).alias("unit_price")))
        one = F.struct(F.trim(F.regexp_extract(x, plain, 1)).alias("description"), F.lit(1).alias("quantity"), parse_amount(F.regexp_extract(x, plain, 2), three).alias("unit_price"))
        named = let(one, lambda o: F.when(o["description"].rlike("[a-zA-Z]{2}") & (o["unit_price"] > 0), o))
        return F.when(several, of_many).otherwise(named)

    good = F.filter(rows, lambda r: r["line"].rlike(plain) & ~r["folded"].rlike(labels))
    return F.slice(F.filter(F.transform(good, item), lambda i: i.isNotNull()), 1, MAX_ITEMS)


def extract_receipts(texts: DataFrame, column: str = "text") -> DataFrame:
    """`texts` with the fields of each receipt text, a confidence for each field found and `overall`.

    Subtotal, tax and stamp that add up to the total raise their confidence; one that does not lowers the tax's, and a
    missing tax is what the subtotal and the stamp leave. A null text has no fields.
    """
    c = F.col
    df = texts.withColumn("_lines", lines_of(c(column))).withColumn("_text", F.array_join("_lines", "\n")).withColumn("_folded", F.lower(strip_marks(c("_text"))))
    df = df.withColumn("_currency", _currency(c("_text")))
    df = df.withColumn("_three", F.when(c("_currency.code").isNotNull(), is_three_decimal(c("_currency.code"))).otherwise(page_three_decimal(c("_text"))))
    # lines, folded lines and numbers; then each with the numbers below it
    flat = F.zip_with("_lines", F.split("_folded", "\n"), lambda x, f: F.struct(x.alias("line"), f.alias("folded"), amounts_on(x, c("_three")).alias("nums")))
    df = df.withColumn("_flat", F.when(F.size("_lines") > 0, flat).otherwise(F.slice(flat, 1, 0)))
    df = df.withColumn("_rows", F.slice(F.zip_with("_flat", F.slice("_flat", F.lit(2), F.size("_flat")), lambda r, n: F.struct(r["line"].alias("line"), r["folded"].alias("folded"), r["nums"].alias("nums"), F.coalesce(n["nums"], F.array().cast("array<double>")).alias("below"))), F.lit(1), F.size("_flat")))
    labels = {"total": TOTAL_LABELS, "subtotal": SUBTOTAL_LABELS, "tax": TAX_LABELS, "stamp": STAMP_LABELS}
    df = df.withColumns({f"_{name}": labelled(c("_rows"), words) for name, words in labels.items()})
    df = df.withColumns({
        "_merchant": merchant_line(c("_lines")), "_date": receipt_date(c("_folded"), c("_currency.code")), "_invoice": invoice_number(c("_text")), "_payment": payment_of(c("_folded")), "items": items_of(c("_rows"), c("_three")),
        "_largest": F.array_max(F.filter(F.flatten(F.transform("_rows", lambda r: r["nums"])), lambda v: v > 0)),
    })
    amount = lambda name: F.abs(c(f"_{name}.value"))
    sure = lambda name: F.when(c(f"_{name}.exact"), SURE[name][0]).when(c(f"_{name}").isNotNull(), SURE[name][1])
    df = df.withColumns({
        "merchant": c("_merchant.name"), "date": c("_date.date"), "total": F.coalesce(amount("total"), "_largest"), "subtotal": amount("subtotal"), "_read_tax": amount("tax"), "stamp": amount("stamp"),
        "currency": c("_currency.code"), "invoice_number": c("_invoice.number"), "payment_method": c("_payment.method"),
    })
    left = round_up(c("total") - c("subtotal") - F.coalesce("stamp", F.lit(0.0)), 2)
    all_read = c("total").isNotNull() & c("subtotal").isNotNull() & c("_read_tax").isNotNull()
    agrees = all_read & (F.abs(c("subtotal") + c("_read_tax") + F.coalesce("stamp", F.lit(0.0)) - c("total")) < 0.02)
    df = df.withColumn("_derived", F.when(c("_read_tax").isNull() & (left > 0) & (left < c("total")), left)).withColumn("_agrees", F.coalesce(agrees, F.lit(False))).withColumn("_odd", F.coalesce(all_read & ~agrees, F.lit(False)))
    df = df.withColumn("tax", F.coalesce("_read_tax", "_derived"))
    confidence = {
        "merchant": c("_merchant.sure"), "date": c("_date.sure"),
        "total": F.when(c("_agrees"), SURE["checked_total"]).otherwise(F.coalesce(sure("total"), F.when(c("total").isNotNull(), SURE["largest"]))),
        "subtotal": F.when(c("_agrees"), SURE["checked_part"]).otherwise(sure("subtotal")),
        "tax": F.when(c("_agrees"), SURE["checked_part"]).when(c("_odd"), SURE["odd_tax"]).when(c("_derived").isNotNull(), SURE["derived_tax"]).otherwise(sure("tax")),
        "currency": c("_currency.sure"), "invoice_number": c("_invoice.sure"), "payment_method": c("_payment.sure"), "items": F.when(F.size("items") > 0, SURE["items"]),
    }
    df = df.withColumn("confidence", F.struct(*(v.alias(k) for k, v in confidence.items())))
    return df.withColumn("overall", overall_confidence(c("confidence"))).drop(*(x for x in df.columns if x.startswith("_") and x not in texts.columns))


def overall_confidence(confidence: Column) -> Column:
    """Weighted: total 0.4, date and merchant 0.25, currency 0.1; a missing field counts 0."""
    weights = (("total", 0.4), ("date", 0.25), ("merchant", 0.25), ("currency", 0.1))
    return round_up(sum((F.coalesce(confidence[f], F.lit(0.0)) * w for f, w in weights), F.lit(0.0)), 3)


def line_items(receipts: DataFrame) -> DataFrame:
    """A row for each line item of extracted receipts (id, items): id, item (from 1), description, quantity, unit_price."""
    # the outer form: for the plain one Spark would push a filter on `items` down by repeating all of its expressions
    each = receipts.select("id", F.posexplode_outer("items").alias("at", "i")).where("i is not null")
    return each.select("id", (F.col("at") + 1).alias("item"), "i.description", "i.quantity", "i.unit_price")


def recomputed(extraction: DataFrame, edits: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Extractions (org, r_id, the fields, confidence) after edits by hand (org, r_id, some of the fields, and cleared, the
    names of fields that are emptied): an edited field is certain, the overall confidence follows (an empty field
    counts 0, one without confidence a half), and edited_by_user is set. Null fields of an edit are untouched."""
    given = [f for f in fields if f in edits.columns]
    emptied = ["cleared"] if "cleared" in edits.columns else []
    new = edits.select("org", "r_id", *(F.col(f).alias(f"_{f}") for f in (*given, *emptied)))
    joined = extraction.join(new, ["org", "r_id"], "left")
    clears = {f: F.coalesce(F.array_contains("_cleared", f), F.lit(False)) if emptied else F.lit(False) for f in fields}
    touched = {f: clears[f] | F.col(f"_{f}").isNotNull() if f in given else clears[f] for f in fields}
    certain = F.struct(*(F.when(touched[f], 1.0).otherwise(F.col("confidence")[f]).alias(f) for f in fields))
    any_touched = F.lit(False)
    for t in touched.values():
        any_touched = any_touched | t
    values = {f: F.when(clears[f], F.lit(None)).otherwise(F.coalesce(f"_{f}", f) if f in given else F.col(f)) for f in fields}
    out = joined.withColumns({"confidence": certain, "edited_by_user": any_touched} | values)
    present = lambda f: F.col(f).isNotNull() & (F.col(f).cast("string") != "")
    sure = F.struct(*(F.when(present(f), F.coalesce(F.col("confidence")[f], F.lit(0.5))).alias(f) for f in ("total", "date", "merchant", "currency")))
    out = out.withColumn("overall", F.when(F.col("edited_by_user"), overall_confidence(sure)).otherwise(F.col("overall")))
    return out.drop(*(f"_{f}" for f in (*given, *emptied)))
