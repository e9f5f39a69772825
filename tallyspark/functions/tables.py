"""Fixed values that results depend on: word lists, aliases and patterns."""

#: Payment-processor wording before a merchant's name, in the order in which it is tried.
PROCESSOR_PREFIXES = (
    "pos", "posd", "pos debit", "card payment", "card purchase", "cardpurchase", "visa", "visa debit", "mastercard", "maestro", "amex", "debit", "credit",
    "sepa", "sepa dd", "sepa ct", "ach", "ach debit", "direct debit", "dd", "payment to", "payment from", "purchase", "pmt", "tfr", "transfer",
    "withdrawal", "wd", "bill payment", "recurring", "contactless", "chip card",
)
#: Aggregators written as "X *MERCHANT".
STAR_AGGREGATORS = ("sq", "tst", "sp", "py", "paypal", "pp", "iz", "wl", "ec", "zettle", "sumup", "stripe", "shopify")
#: Words that never tell two merchants apart.
NOISE_TOKENS = (
    "market", "markt", "marche", "supermarket", "hypermarket", "store", "shop", "shopping", "express", "expres", "city", "centre", "center", "mall", "branch",
    "store no", "no", "ltd", "limited", "llc", "inc", "incorporated", "corp", "co", "gmbh", "ag", "sa", "sas", "sarl", "srl", "spa", "bv", "nv", "plc", "pty",
    "ab", "oy", "as", "aps", "the", "and", "of", "de", "du", "la", "le", "les", "el", "al", "intl", "international", "group", "holdings", "services",
    "service", "company", "online", "web", "www", "com", "net", "eu", "uk", "us", "fr", "tn",
)
#: Brands, first in the list wins.
KNOWN_BRANDS = (
    "amazon web services", "amazon marketplace", "amazon", "carrefour", "monoprix", "auchan", "lidl", "aldi", "walmart", "target", "costco", "tesco",
    "sainsburys", "mcdonalds", "starbucks", "subway", "burger king", "uber eats", "ubereats", "uber", "lyft", "bolt", "deliveroo", "just eat", "netflix",
    "spotify", "apple", "google", "microsoft", "adobe", "dropbox", "slack", "notion", "figma", "github", "gitlab", "atlassian", "openai", "anthropic",
    "digitalocean", "heroku", "vercel", "cloudflare", "godaddy", "namecheap", "totalenergies", "shell", "esso", "ikea", "decathlon", "fnac", "zara",
    "booking com", "airbnb", "ryanair", "easyjet", "lufthansa", "air france", "tunisair", "sncf", "steam", "paypal", "stripe", "twilio", "linkedin", "meta", "canva",
)
BRAND_ALIASES = {
    "amzn": "amazon", "amzn mktp": "amazon marketplace", "mktp": "marketplace", "amazon eu": "amazon", "amazon digital": "amazon", "amzn digital": "amazon",
    "mcd": "mcdonalds", "mcdonald": "mcdonalds", "mcdonald's": "mcdonalds", "sbux": "starbucks", "wm supercenter": "walmart", "wmt": "walmart",
    "uber trip": "uber", "uber eats": "ubereats", "ubereats": "ubereats", "lyft ride": "lyft", "googl": "google", "google cloud": "google",
    "msft": "microsoft", "microsoft 365": "microsoft", "aws": "amazon web services", "amazon web svcs": "amazon web services", "dnh": "godaddy",
    "apple com bill": "apple", "itunes com bill": "apple", "nflx": "netflix", "spfy": "spotify", "spotify ab": "spotify", "carrefour": "carrefour",
    "monoprix sa": "monoprix",
}
#: Category and the words that suggest it, first hit wins.
CATEGORY_WORDS = (
    ("Food", "carrefour|monoprix|auchan|lidl|aldi|tesco|walmart|costco|restaurant|cafe|coffee|starbucks|mcdonalds|burger|pizza|bakery|boulangerie|deli|grocer|supermarket|food|eats|deliveroo|just eat|subway"),
    ("Transport", "uber|lyft|bolt|taxi|metro|subway rail|train|sncf|rail|bus|parking|toll|fuel|petrol|gas station|shell|esso|totalenergies|car rental|hertz|avis"),
    ("Software", "adobe|figma|notion|slack|github|gitlab|atlassian|jira|dropbox|google|microsoft|openai|anthropic|aws|amazon web services|digitalocean|heroku|vercel|cloudflare|godaddy|namecheap|stripe|twilio|canva|zoom|saas|subscription|netflix|spotify"),
    ("Travel", "airbnb|booking|hotel|hostel|ryanair|easyjet|lufthansa|air france|tunisair|airline|flight|expedia|trivago"),
    ("Office", "staples|office|stationery|ikea|paper|printing|print|post|postal|courier|dhl|fedex|ups"),
    ("Equipment", "apple|dell|lenovo|hp|laptop|monitor|hardware|electronics|fnac|decathlon|darty"),
    ("Marketing", "meta|facebook|linkedin|twitter|x corp|google ads|adwords|mailchimp|hubspot|advert|campaign|sponsored"),
    ("Utilities", "electric|electricity|water|gas bill|internet|broadband|telecom|orange|vodafone|ooredoo|mobile|phone bill|energy|steg|sonede"),
)
#: Payment method and the words that tell it, first hit wins.
PAYMENT_WORDS = (
    ("card", "visa|mastercard|maestro|amex|card|pos|contactless|chip"),
    ("cash", "atm|cash|withdrawal"),
    ("transfer", "sepa|transfer|tfr|wire|ach|giro"),
    ("direct_debit", "direct debit|dd|standing order"),
)
THREE_DECIMAL_CURRENCIES = ("TND", "KWD", "BHD", "OMR", "JOD", "LYD")
#: Currency codes read in any case, then those in capitals only, then symbols, each in order.
CURRENCY_CODES = ("EUR", "USD", "GBP", "CHF", "SEK", "NOK", "DKK", "PLN", "TND", "MAD", "CAD", "AUD", "JPY", "INR", "TRY", "NGN", "ZAR")
CAPITALS_ONLY_CODES = ("AED", "SAR", "QAR", "KWD", "BHD", "OMR", "JOD", "LYD", "EGP", "DZD", "KES", "GHS")
CURRENCY_SYMBOLS = (("€", "EUR"), ("$", "USD"), ("£", "GBP"), ("¥", "JPY"), ("₺", "TRY"), ("₹", "INR"), ("د.ت", "TND"))
#: Months by name or short form, accents removed.
MONTHS = {
    "jan": 1, "january": 1, "janvier": 1, "januar": 1, "enero": 1, "gennaio": 1,
    "feb": 2, "february": 2, "fevrier": 2, "februar": 2, "febrero": 2, "febbraio": 2,
    "mar": 3, "march": 3, "mars": 3, "marz": 3, "marzo": 3,
    "apr": 4, "april": 4, "avril": 4, "abril": 4, "aprile": 4,
    "may": 5, "mai": 5, "mayo": 5, "maggio": 5, "maj": 5,
    "jun": 6, "june": 6, "juin": 6, "juni": 6, "junio": 6, "giugno": 6,
    "jul": 7, "july": 7, "juillet": 7, "juli": 7, "julio": 7, "luglio": 7,
    "aug": 8, "august": 8, "aout": 8, "agosto": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9, "septiembre": 9, "settembre": 9,
    "oct": 10, "october": 10, "octobre": 10, "oktober": 10, "octubre": 10, "ottobre": 10,
    "nov": 11, "november": 11, "novembre": 11, "noviembre": 11,
    "dec": 12, "december": 12, "decembre": 12, "dezember": 12, "diciembre": 12, "dicembre": 12,
}
TOTAL_LABELS = (
    "total ttc", "grand total", "total amount", "amount due", "amount paid", "balance due", "total due", "montant total", "montant ttc", "net a payer",
    "total general", "total a payer", "gesamtbetrag", "gesamt", "summe", "importe total", "totale", "total", "montant", "to pay", "paid", "المبلغ الجملي", "المجموع",
)
SUBTOTAL_LABELS = ("subtotal", "sub total", "sous-total", "sous total", "total ht", "montant ht", "net amount", "nettobetrag", "zwischensumme", "imponibile", "base imponible")
STAMP_LABELS = ("timbre fiscal", "timbre")
TAX_LABELS = ("vat", "tva", "mwst", "ust", "iva", "sales tax", "tax", "taxe", "impuesto", "btw")
#: Statement columns and the headers that name them.
HEADER_ALIASES = {
    "date": ("date", "transaction date", "booking date", "value date", "posted date", "post date", "datum", "buchungstag", "wertstellung", "date operation", "date d'operation", "date de valeur", "fecha", "data", "completed date", "started date", "trans date", "txn date", "entry date"),
    "amount": ("amount", "value", "betrag", "montant", "importe", "importo", "transaction amount", "amount (eur)", "net amount", "sum"),
    "debit": ("debit", "withdrawal", "paid out", "money out", "soll", "debito", "debit amount", "outflow"),
    "credit": ("credit", "deposit", "paid in", "money in", "haben", "credito", "credit amount", "inflow"),
    "description": ("description", "details", "narrative", "memo", "reference", "payee", "merchant", "name", "transaction description", "transaction details", "particulars", "text", "verwendungszweck", "buchungstext", "libelle", "concepto", "descrizione", "beneficiary", "counterparty", "remitter"),
    "currency": ("currency", "ccy", "waehrung", "wahrung", "devise", "moneda", "valuta", "currency code"),
    "reference": ("reference", "ref", "transaction id", "transaction reference", "mandate reference", "cheque number", "check number"),
}
EXPORT_COLUMNS = (
    "Receipt ID", "Receipt file", "Merchant", "Receipt date", "Amount", "Currency", "VAT", "Invoice number", "Category", "Transaction ID", "Bank description",
    "Transaction date", "Transaction amount", "Match confidence", "Match method", "Status",
)
#: Words that head a receipt, words of addresses and contacts, and words before an invoice number.
HEADING_WORDS = ("receipt", "invoice", "facture", "rechnung", "ticket", "bill", "tax invoice", "vat invoice", "customer copy", "merchant copy")
ADDRESS_WORDS = ("street", r"str\.", "road", "rue", "avenue", "ave", "blvd", "zone", "tel", "phone", "fax", r"www\.", "@", "http")
INVOICE_WORDS = ("invoice", "inv", "facture", "rechnung", "receipt", "ticket", "bill", "order", "ref")
#: Payment method of a receipt, the words that tell it, and how sure they are; first hit wins.
RECEIPT_PAYMENT_WORDS = (
    ("card", "visa|mastercard|maestro|amex|american express|credit card|debit card|carte bancaire|cb|card", 0.9),
    ("cash", "cash|especes|espece|bar|contanti|efectivo", 0.88),
    ("transfer", "bank transfer|virement|uberweisung|transfer|sepa", 0.85),
    ("card", "paypal|apple pay|google pay", 0.8),
)
#: The categories of a new organization.
SYSTEM_CATEGORIES = (
    ("Food", "#F59E0B"), ("Transport", "#3B82F6"), ("Software", "#8B5CF6"), ("Office", "#64748B"), ("Travel", "#06B6D4"),
    ("Equipment", "#EC4899"), ("Marketing", "#F97316"), ("Utilities", "#14B8A6"), ("Other", "#94A3B8"),
)
NO_CATEGORY, NO_COLOR = "Uncategorised", "#94A3B8"
#: Plans and their monthly receipts.
PLAN_QUOTAS = {"free": 50, "pro": 500, "business": 2500}
