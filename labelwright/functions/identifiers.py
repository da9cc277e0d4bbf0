"""Check digits and identifier classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.functions.text import let, lookup, strip

# Identifier lengths and symbologies.
GTIN_LENGTHS = (8, 12, 13, 14)
SYMBOL_LENGTHS = {"EAN_8": 8, "EAN_13": 13, "UPC_A": 12, "UPC_E": 8, "ITF_14": 14}
SYMBOL_ALIASES = {"EAN8": "EAN_8", "EAN13": "EAN_13", "UPCA": "UPC_A", "UPCE": "UPC_E", "ITF": "ITF_14", "ITF14": "ITF_14"}


def digits(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda d: F.length(d) > 0), lambda d: d.try_cast("int"))


def weighted_sum(values: Column, weight) -> Column:
    """Sum of ``digit * weight(index)`` over an array of digits."""
    return F.aggregate(F.transform(values, lambda d, i: d * weight(i)), F.lit(0), lambda a, x: a + x)


def check_digit(body: Column) -> Column:
    """Modulo-10 check digit with weights 3, 1 from the right."""
    total = weighted_sum(F.reverse(digits(body)), lambda i: F.when(i % 2 == 0, 3).otherwise(1))
    return F.pmod(-total, F.lit(10)).cast("string")


def is_gtin(c: Column) -> Column:
    """Digits of an allowed length whose last digit is the check digit of the rest."""
    shaped = c.rlike("^[0-9]+$") & F.length(c).isin(*GTIN_LENGTHS)
    return F.coalesce(shaped & (F.substring(c, -1, 1) == check_digit(c.substr(F.lit(1), F.length(c) - 1))), F.lit(False))


def symbol_name(c: Column) -> Column:
    key = F.regexp_replace(F.upper(strip(c)), r"[\s-]+", "_")
    return F.coalesce(lookup(SYMBOL_ALIASES, key), key)


def expand_upc_e(c: Column) -> Column:
    """The 12-digit form of an 8-digit zero-suppressed code; NULL when it is malformed or its check digit is wrong."""
    part = lambda a, n: F.substring(c, a, n)
    last = part(7, 1)
    body = (F.when(last.isin("0", "1", "2"), F.concat(part(1, 3), last, F.lit("0000"), part(4, 3)))
            .when(last == "3", F.concat(part(1, 4), F.lit("00000"), part(5, 2)))
            .when(last == "4", F.concat(part(1, 5), F.lit("00000"), part(6, 1)))
            .otherwise(F.concat(part(1, 6), F.lit("0000"), last)))
    whole = F.concat(body, part(8, 1))
    return F.when(c.rlike("^[01][0-9]{7}$") & is_gtin(whole), whole)


def classify_gtin(raw: Column, symbology: Column) -> Column:
    """Struct of normalised identifier and status: MALFORMED, UNSUPPORTED, INVALID or VALID."""
    clean = F.regexp_replace(raw, r"(?U)[\s-]", "")

    def judge(v: Column) -> Column:
        d, sym = v["d"], v["s"]
        wanted = lookup(SYMBOL_LENGTHS, sym)
        value = F.when(sym == "UPC_E", expand_upc_e(d)).otherwise(d)
        status = (F.when(F.length(strip(F.coalesce(raw, F.lit("")))) == 0, "INVALID_GTIN")
                  .when(~d.rlike("^[0-9]+$"), "MALFORMED_IDENTIFIER")
                  .when(sym.isNotNull() & wanted.isNull(), "UNSUPPORTED_IDENTIFIER")
                  .when((sym == "UPC_E") & value.isNull(), "INVALID_GTIN")
                  .when(sym.isNotNull() & (sym != "UPC_E") & (F.length(d) != wanted), "INVALID_GTIN")
                  .when(~F.length(value).isin(*GTIN_LENGTHS), "UNSUPPORTED_IDENTIFIER")
                  .when(is_gtin(value), "VALID_GTIN").otherwise("INVALID_GTIN"))
        return let(status, lambda s: F.struct(F.when(s == "VALID_GTIN", value).alias("gtin"), s.alias("status")))

    return let(F.struct(clean.alias("d"), symbol_name(symbology).alias("s")), judge)


def licence_check(c: Column) -> Column:
    """Last of 14 digits closes the plain digit sum to a multiple of ten."""
    total = weighted_sum(digits(F.substring(c, 1, 13)), lambda i: F.lit(1))
    return F.substring(c, 14, 1) == F.pmod(-total, F.lit(10)).cast("string")


def ean13_check(c: Column) -> Column:
    """Standard check digit, or for the 890 range the plain-sum compatibility digit."""
    standard = F.substring(c, 13, 1) == check_digit(F.substring(c, 1, 12))
    plain = weighted_sum(digits(F.substring(c, 1, 12)), lambda i: F.lit(1))
    compatible = c.startswith("890") & (F.substring(c, 13, 1) == ((plain % 10 + 9) % 10).cast("string"))
    return standard | compatible


def classify_anchor(raw: Column) -> Column:
    """Struct of anchor type and status for licence, EAN-13 and registration numbers."""
    out = lambda kind, status: F.struct(F.lit(kind).alias("anchor_type"), (status if isinstance(status, Column) else F.lit(status)).alias("status"))
    valid = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "valid").otherwise("invalid")

    def judge(v: Column) -> Column:
        n = F.length(v)
        numeric = v.rlike("^[0-9]+$")
        tail = v.substr(F.lit(3), n)
        return (F.when(raw.isNull() | (n == 0), out("unknown", "invalid"))
                .when(numeric & (n == 14), out("fssai", valid(licence_check(v))))
                .when(numeric & (n == 13) & v.startswith("890"), out("ean13", valid(ean13_check(v))))
                .when(numeric & (n == 13), out("fssai", "ambiguous")).when(numeric & (n == 12), out("ean13", "ambiguous"))
                .when(v.rlike("^R-[0-9]{8}$"), out("bis_registration", "valid"))
                .when(v.rlike("^[Rr]-"), out("bis_registration", F.when(~tail.rlike("^[0-9]+$"), "ambiguous").when(F.length(tail) == 8, "valid")
                                             .when(F.length(tail) <= 5, "ambiguous").otherwise("invalid")))
                .otherwise(out("unknown", "ambiguous")))

    return let(strip(F.coalesce(raw, F.lit(""))), judge)
