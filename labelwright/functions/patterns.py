"""The declaration vocabulary. Word lists, patterns and thresholds are inputs of the
domain and must equal the published ones for results to agree, so they are stated here as plain text.

Patterns are written in the subset that Java and RE2 share, without flags. ``java`` adds the flags for
Spark (case-insensitive, Unicode classes); ``re2`` adds those for a RE2 engine.
"""

from __future__ import annotations


def java(pattern: str) -> str:
    return "(?iU)" + pattern


def re2(pattern: str) -> str:
    return "(?i)" + pattern


# ---- fixed values: thresholds -----------------------------------------------------------------
FIELD_CONFIDENCE = 0.80
GATE_CONFIDENCE = 0.90
NEARBY_LINES = 6
CARE_BLOCK_LINES = 3
CARE_CONTACT_LINES = 12
BLOCK_LINES = 8
ENTITY_LINES = 4
SPATIAL_ENTITY_LINES = 8

# ---- fixed values: units ----------------------------------------------------------------------
UNIT_WORDS = "kgs?|kilograms?|gms?|grams?|g|mls?|millilitres?|milliliters?|litres?|liters?|l"
WEIGHT_UNITS = {"kg": 1000.0, "kgs": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0,
                "g": 1.0, "gm": 1.0, "gms": 1.0, "gram": 1.0, "grams": 1.0}
VOLUME_UNITS = {"l": 1000.0, "litre": 1000.0, "litres": 1000.0, "liter": 1000.0, "liters": 1000.0,
                "ml": 1.0, "mls": 1.0, "millilitre": 1.0, "millilitres": 1.0,
                "milliliter": 1.0, "milliliters": 1.0}
UNIT_ALIASES = {"kgs": "kg", "kilogram": "kg", "kilograms": "kg", "gm": "g", "gms": "g", "gram": "g",
                "grams": "g", "mls": "ml", "millilitre": "ml", "millilitres": "ml", "milliliter": "ml",
                "milliliters": "ml", "litre": "l", "litres": "l", "liter": "l", "liters": "l",
                "cms": "cm", "centimetre": "cm", "centimetres": "cm", "centimeter": "cm",
                "centimeters": "cm", "metre": "m", "metres": "m", "meter": "m", "meters": "m"}
CANONICAL_FACTORS = {
    "mass": {"g": 0.001, "kg": 1.0},
    "volume": {"ml": 0.001, "cm3": 0.001, "l": 1.0, "dm3": 1.0, "m3": 1000.0},
    "length": {"cm": 0.01, "m": 1.0},
    "area": {"dm2": 0.01, "m2": 1.0},
    "number": {"number": 1.0, "unit": 1.0, "piece": 1.0, "pair": 1.0, "set": 1.0},
}

# ---- fixed values: value patterns -------------------------------------------------------------
QUANTITY = rf"([0-9]+(?:\.[0-9]+)?)\s*({UNIT_WORDS})\b"
CURRENCY_AMOUNT = r"(?:₹|Rs\.?|INR)\s*([0-9]+(?:[.,][0-9]{1,2})?)"
LABELLED_AMOUNT = r"(?:maximum\s+retail\s+price|m\.?r\.?p\.?)\s*[:\-]?\s*([0-9]+(?:[.,][0-9]{1,2})?)"
PRICE_LABEL = r"(?:maximum\s+retail\s+price|m\.?r\.?p\.?)"
BARE_AMOUNT = r"^[0-9]{1,4}[.,][0-9]{1,2}$"
UNIT_PRICE = (r"(?:₹|Rs\.?|INR)?\s*([0-9]+(?:[.,][0-9]{1,2})?)\s*(?:/|per\s+)\s*"
              rf"(100\s*g|100\s*ml|{UNIT_WORDS})\b")
TAX_WORDING = r"incl(?:usive|\.)?\s*(?:of\s*)?all\s*taxes"
PACKAGE_COUNT = (r"pack(?:s)?\s+of\s+([0-9]+)",
                 r"(?:no\.?|number)\s*of\s*(?:retail\s+)?packages?\s*[:\-]?\s*([0-9]+)",
                 r"([0-9]+)\s*(?:x\s*)?(?:retail\s+)?(?:packages?|packs?|pouches?)\b")
MONTH_NAMES = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DATE_PLAIN = (r"\b(?:[0-3]?[0-9][/\-.][0-1]?[0-9][/\-.][0-9]{2,4}"
              r"|[0-1]?[0-9][/\-.][0-9]{4}"
              r"|[0-1]?[0-9]/[0-9]{2}\b"
              rf"|(?:{MONTH_NAMES})[a-z]*\.?\s+[0-9]{{2,4}})\b")
DATE = DATE_PLAIN.replace(r"[0-1]?[0-9]/[0-9]{2}\b", r"[0-1]?[0-9]/[0-9]{2}\b(?!/)")
DATE_KEYWORD = (r"date\s+of\s+manufacture|manufactur\w*|\bmfg\b|\bmfd\b|\bbatch\s*mfd\b|packed?\s+on"
                r"|packing\s+date|\bpkd\b")
PHONE = r"(?:\+91[\s-]?)?[0-9][0-9\s-]{6,14}[0-9]"
PHONE_MAX_UNGROUPED = 11
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
LICENCE = r"fssai[^0-9]{0,40}?(\d{14})"
BARCODE_LINE = r"^(?:\d{8}|\d{12}|\d{13})$"
BATCH_KEYWORD = r"batch\s*(?:no\.?|number)?|\blot\s*(?:no\.?|number)?"
BATCH_VALUE = r"^([A-Za-z0-9][A-Za-z0-9\-/]{1,19})$"
EXPIRY_KEYWORD = r"use\s+by|best\s+before|expir\w*"
EXPIRY_VALUE = r"([0-9]{1,2}[/\-][0-9]{1,2}[/\-][0-9]{2,4}|[0-9]+\s*(?:months?|years?)\s*from[^\n]*)"
WARNING = (r"\bwarning\b|\bcaution\b|keep\s+out\s+of\s+reach|keep\s+away\s+from|for\s+external\s+use\s+only"
           r"|not\s+for\s+children\s+under|do\s+not\s+use\s+if|store\s+in\s+a\s+cool|shake\s+well"
           r"|choking\s+hazard|may\s+contain\s+traces|allergen")
PRICE_LIKE = r"(?:₹|Rs\.?|INR)\s*[0-9]+(?:[.,][0-9]{1,2})?|\b[0-9]{1,4}\.[0-9]{2}\b"
QUANTITY_LIKE = rf"[0-9]+(?:\.[0-9]+)?\s*(?:{UNIT_WORDS})\b"

# ---- fixed values: context vocabularies -------------------------------------------------------
NUTRITION_ROW = (r"\bprotein\b|\bcarbohydrate|\bsugars?\b|\bsodium\b|\bcholesterol\b|\bvitamin\b|\bcalcium\b"
                 r"|\biron\b|\bfibre\b|\bfiber\b|saturated\s+fat|trans\s+fat|\bfat\b")
COMMODITY_NOUN = (r"\b(?:chips?|biscuits?|cookies?|wafers?|namkeen|snacks?|noodles?|pasta|chocolates?|candi?(?:es|y)"
                  r"|toffees?|sweets?|cakes?|bread|rusks?|oils?|ghee|butter|cheese|milk|curd|yogh?urt|paneer"
                  r"|rice|atta|flour|sugar|salt|tea|coffee|juice|beverages?|soaps?|shampoos?|detergents?"
                  r"|toothpaste|lotions?)\b")
BUSINESS_ENTITY = (r"\b(?:private|pvt\.?|limited|ltd\.?|llp|incorporated|corporation|industries|enterprises)\b")
SERVING_SIZE = r"\bserving\s+size\b|\bper\s+serving\b|\bnumber\s+of\s+servings\b"
ENUMERATED_ITEM = r"^\s*([A-Z])\s*[.)]\s*(.+?)\s*$"
COMPONENT_QUANTITY = (r"^\(?\s*(\d+)\s*(?:units?|pieces?)\s*[x×]\s*(\d+(?:[.,]\d+)?)\s*"
                      r"(kgs?|kilograms?|gms?|grams?|g|mls?|millilit(?:er|re)s?|lit(?:er|re)s?|l)\s*\)?$")
COUNTRY_KEYWORD = r"country\s+of\s+origin|\borigin\b|\bmade[\s_-]*in\b"
COUNTRY_WORD = r"^[A-Za-z]{2,20}$"
MADE_IN = r"^\s*made[\s_-]*in\s*[:\-]?\s*([A-Za-z]{2,20})\s*$"
MADE_IN_MARKER = r"^made[\s_-]*in\s*[:\-]?$"
BARE_FRAGMENT = r"^[A-Za-z0-9]{2,20}$"
BARE_NUMBER = r"^[0-9]+(?:\.[0-9]+)?\s*/?-?$"
INGREDIENTS_TRIGGER = r"ingredients?\s*:"
NUTRITION_TRIGGER = r"nutrition(?:al)?\s+information"

# ---- fixed values: entity headings ------------------------------------------------------------
_LINK = r"(?:\s+\S+){0,2}\s+"
_BY_FOR = r"(?:by|8y|for)"
_BY = r"(?:by|8y)"
_UNIT_SEE = r"\bfor\s+mfg\.?\s+unit\s+see\b"
ROLE_STEMS = {
    "manufacturer": [(r"manufact(?:u|ij)r\w*", _BY_FOR), (r"mf[dgr]", _BY_FOR)],
    "packer": [(r"pack(?:ed|eo|er)?", _BY_FOR), (r"pkd", _BY_FOR)],
    "importer": [(r"import(?:ed|eo|er)?", _BY_FOR), (r"imp", _BY_FOR)],
    "marketer": [(r"market(?:ed|er)?", _BY)],
    "distributor": [(r"distribut(?:ed|or)?", _BY)],
}
ROLE_HEADINGS = {
    role: "|".join(rf"\b{stem}{_LINK}{link}\b" for stem, link in stems)
    + ("|" + _UNIT_SEE if role == "manufacturer" else "")
    for role, stems in ROLE_STEMS.items()
}
ANY_ROLE_HEADING = "|".join(ROLE_HEADINGS.values())
HEADING_ONLY = "|".join(
    [rf"^{stem}{_LINK}{link}\s*[:\-]?\s*$" for stems in ROLE_STEMS.values() for stem, link in stems]
    + [r"^for\s+mfg\.?\s+unit\s+see\s+the\s+first\s+character\(s?\)\s+of\s+the\s+code\s+following\b\s*\S{0,3}\s*$"])
_ROLE_WORDING = "|".join(
    (r"\b" if stem in (r"mf[dgr]", "pkd", "imp") else "") + rf"{stem}{_LINK}{link}\b"
    for stems in ROLE_STEMS.values() for stem, link in stems)
DECLARATION_HEADING = (
    r"nutrition(?:al)?\s+information|ingredients?\s*:|net\s+(?:quantity|qty|weight|wt)\b"
    r"|unit\s+sale\s+price|price\s+per\s+unit|" + _ROLE_WORDING +
    r"|batch\s*(?:no\.?|number)?\s*[:\-]|\blot\s*(?:no\.?|number)?\s*[:\-]"
    r"|date\s+of\s+manufactur\w*|packing\s+date|packed?\s+on|\bmfg\b|\bpkd\b"
    r"|(?:use\s+by|best\s+before|expir\w*)\b"
    r"|(?:consumer|customer)\s+care|customer\s+service|helpline|toll\s*free"
    r"|country\s+of\s+origin|\borigin\b|maximum\s+retail\s+price|\bm\.?r\.?p\.?\b"
    r"|(?:₹|Rs\.?|INR)\s*[0-9]|\bgtin\b|\bbarcode\b"
    r"|storage\s+condition|store\s+in\s+a|keep\s+(?:in|away|refrigerat)|keep\s+your\s+\w+\s+clean|dispos")

# ---- fixed values: consumer care --------------------------------------------------------------
CARE_TRIGGER = (
    r"(?:consumer|customer)\s+care|customer\s+service|helpline|toll\s*free|contact\s+us"
    r"|(?:for\s+)?queries\s+or\s+feedback"
    r"|[0-9]{1,2}(?::[0-9]{2})?\s*(?:AM|PM)\s*(?:TO|-|–)\s*[0-9]{1,2}(?::[0-9]{2})?\s*(?:AM|PM)\s*OR\s*E[\s-]?MAIL")
CARE_NAME = (r"(?:consumer|customer)\s+care(?:\s+(?:cell|department|desk|division|team|centre|center))?"
             r"|customer\s+service(?:\s+(?:cell|department|desk|centre|center))?"
             r"|toll[\s-]?free(?:\s+(?:number|helpline))?|helpline")
CARE_ADDRESS_REFERENCE = r"\b(?:write|send)\b.*\b(?:mfg\.?|manufacturer(?:'s)?)\s+address\b"
CARE_SPLIT_FIRST = r"\bconsumer\s*$"
CARE_SPLIT_SECOND = r"^care\s+(?:office|cell|department|desk|division|team|centre|center)\b"
CARE_SPLIT_LINES = 4
CARE_STOP = (r"mrp|maximum\s+retail|net\s+(?:quantity|qty|weight)|country\s+of\s+origin|manufactur|packed?\s+on|mfg"
             r"|best\s+before|made\s+in|storage\s+condition|store\s+in\s+a|keep\s+(?:in|away|refrigerat)|use\s+by|expir"
             r"|batch\s*(?:no\.?|number)?\s*[:\-]|nutrition(?:al)?\s+information|ingredients?\s*:"
             r"|keep\s+your\s+\w+\s+clean|dispos")
CARE_LEAD_IN = (r"^(?:for\s+)?queries\s+or\s+feedback|(?:consumer|customer)\s+care|customer\s+service|helpline|toll\s*free"
                r"|contact\s+us\s*[:-]?|^care\s+(?:office|cell|department|desk|division|team|centre|center)")
MANUFACTURER_LEAD_IN = r"^\s*(?:manufact(?:u|ij)r\w*|mf[dgr])(?:\s+\S+){0,2}\s+(?:by|for)\s*[:\-]?\s*"
ADDRESS_ELSEWHERE = r"\brefer\b.*\bfor\s+address\b"

# ---- fixed values: field aliases, in the order they are tried ------------------------------------
FIELD_ALIASES = {
    "country_of_origin": ["country of origin", "product of india"],
    "common_generic_name_of_commodity": ["product name", "commodity", "generic name"],
    "net_quantity": ["net quantity", "net qty", "net wt"],
    "month_and_year_of_manufacture_or_packing": ["date of manufacture", "manufactured", "mfg", "packed on", "packing date"],
    "maximum_retail_price_mrp": ["maximum retail price", "mrp", "m.r.p", "₹"],
    "unit_sale_price": ["unit sale price"],
    "consumer_care_details": ["consumer care", "customer care", "helpline", "toll free"],
    "identity_of_commodity": ["product name", "commodity", "generic name"],
    "total_number_of_retail_packages_or_net_quantity": ["net quantity", "number of packages", "retail packages"],
}
FIELD_PATTERNS = {
    "country_of_origin": [r"\borigin\b", r"\bmade\s+in\b", r"\bmadein\b", r"\bmade[-_]in\b"],
    "net_quantity": [
        rf"\bnet\b[^0-9]{{0,15}}[0-9]+(?:\.[0-9]+)?\s*(?:{UNIT_WORDS})\b"
        rf"|[0-9]+(?:\.[0-9]+)?\s*(?:{UNIT_WORDS})\b[^0-9]{{0,15}}\bnet\b",
        r"\bnet\s?weight\b", r"\bnet\s+contents\b", r"\bnet\s+vol(?:ume)?\b"],
    "unit_sale_price": [UNIT_PRICE, r"\bprice\s+per\b"],
    "maximum_retail_price_mrp": [r"\brs(?:\.|\s)"],
}
REGION_CLASS_FIELDS = {
    "product_identity": ["common_generic_name_of_commodity", "identity_of_commodity"],
    "mrp": ["maximum_retail_price_mrp"],
    "unit_sale_price": ["unit_sale_price"],
    "net_quantity": ["net_quantity", "total_number_of_retail_packages_or_net_quantity"],
    "entity_details": ["manufacturer_packer_importer_details", "name_and_address_of_manufacturer_or_packer"],
    "country_of_origin": ["country_of_origin"],
    "mfg_date_batch": ["month_and_year_of_manufacture_or_packing"],
    "consumer_care": ["consumer_care_details"],
}
#: Evidence id of a region is this followed by its class.
REGION_ID_PREFIX = "yolo_"
REGION_BATCH = r"batch\s*(?:no\.?|number)?\s*[:\-]?\s*([A-Za-z0-9\-/]{2,20})"
REGION_EXPIRY = rf"(?:{EXPIRY_KEYWORD})\s*[:\-]?\s*{EXPIRY_VALUE}"
RETAIL_FIELDS = ["manufacturer_packer_importer_details", "country_of_origin", "common_generic_name_of_commodity",
                 "net_quantity", "month_and_year_of_manufacture_or_packing", "maximum_retail_price_mrp",
                 "unit_sale_price", "consumer_care_details"]
WHOLESALE_FIELDS = ["name_and_address_of_manufacturer_or_packer", "identity_of_commodity",
                    "total_number_of_retail_packages_or_net_quantity"]
EVIDENCE_SINGLE_LABELS = ["barcode", "fssai", "gtin", "madein", "mfd", "mfg", "mrp", "netqty", "netweight",
                          "netwt", "origin", "pkd"]
FAILURE_HINTS = {
    "maximum_retail_price_mrp": ["mrp", "maximum retail price", "₹", "rs."],
    "unit_sale_price": ["per kg", "per g", "/kg", "/g", "/litre", "/l", "unit sale price"],
    "net_quantity": ["net", "wt", "weight", "qty", "quantity"],
    "manufacturer_packer_importer_details": ["manufactur", "packer", "packed by", "marketed"],
    "month_and_year_of_manufacture_or_packing": ["mfg", "manufactur", "packed on", "packing date"],
    "country_of_origin": ["origin", "made in", "product of"],
    "consumer_care_details": ["consumer", "customer care", "helpline", "toll free"],
}
