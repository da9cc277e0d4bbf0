"""Values read from a line: amounts, quantities, counts, unit prices, dates, countries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.functions import patterns as P
from labelwright.functions.text import all_groups, blank_to_null, group, has, lookup, strip


def amounts(c: Column) -> Column:
    """Every currency amount; without one, the amount after the price label."""
    found = all_groups(c, P.CURRENCY_AMOUNT)
    labelled = F.array_compact(F.array(group(c, P.LABELLED_AMOUNT)))
    return F.when(F.size(found) > 0, found).otherwise(labelled)


def has_amount(c: Column) -> Column:
    """Whether ``amounts`` finds any; both patterns end in a group that is never empty."""
    return has(c, P.CURRENCY_AMOUNT) | has(c, P.LABELLED_AMOUNT)


def amount_value(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def quantity_unit(c: Column) -> Column:
    return F.lower(group(c, P.QUANTITY, 2))


def quantity_amount(c: Column) -> Column:
    """Amount in grams or millilitres; NULL when no quantity and unit is recognised."""
    factor = lookup({**P.WEIGHT_UNITS, **P.VOLUME_UNITS}, quantity_unit(c))
    return group(c, P.QUANTITY, 1).try_cast("double") * factor


def quantity_basis(c: Column) -> Column:
    unit = quantity_unit(c)
    return (F.when(unit.isin(*P.WEIGHT_UNITS), F.lit("weight"))
            .when(unit.isin(*P.VOLUME_UNITS), F.lit("volume")))


def package_count(c: Column) -> Column:
    """The count in the leftmost wording that states one."""
    combined = "|".join(P.PACKAGE_COUNT)
    return F.coalesce(*[group(c, combined, i) for i in (1, 2, 3)]).try_cast("int")


def unit_price_amount(c: Column) -> Column:
    return amount_value(group(c, P.UNIT_PRICE, 1))


def unit_price_unit(c: Column) -> Column:
    unit = F.regexp_replace(F.lower(group(c, P.UNIT_PRICE, 2)), r"\s", "")
    return F.coalesce(lookup(P.UNIT_ALIASES, unit), unit)


def year_month(c: Column) -> Column:
    """``year*100 + month`` of the first date-shaped token; NULL when it does not resolve."""
    token = group(c, P.DATE, 0)
    named = F.lower(group(token, rf"^({P.MONTH_NAMES})", 1))
    named_year = group(token, r"([0-9]{2,4})$", 1).try_cast("int")
    parts = F.split(token, r"[/\-.]")
    size = F.size(parts)
    month = F.when(named.isNotNull(), lookup({m: i + 1 for i, m in enumerate(P.MONTH_NAMES.split("|"))}, named)
                   ).otherwise(F.get(parts, size - 2).try_cast("int"))
    year = F.when(named.isNotNull(), named_year).otherwise(F.get(parts, size - 1).try_cast("int"))
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.when(month.between(1, 12), year * 100 + month)


def canonical_country(c: Column) -> Column:
    made_in = group(c, P.MADE_IN)
    return F.when(made_in.isNotNull(), F.concat(F.lit("MADE IN "), F.upper(made_in))).otherwise(c)


def country_remainder(c: Column) -> Column:
    """What is left beside the keyword; NULL for a keyword-only line."""
    rest = F.regexp_replace(c, P.java(P.COUNTRY_KEYWORD), "")
    return blank_to_null(F.regexp_replace(rest, r"^[ :\-\n]+|[ :\-\n]+$", ""))


def comparable_country(c: Column) -> Column:
    bare = F.regexp_replace(strip(c), P.java(r"^(?:made\s+in|product\s+of|country\s+of\s+origin\s*:?)\s*"), "")
    return F.lower(F.regexp_replace(strip(F.regexp_replace(bare, r"(?U)\s+", " ")), r"\.+$", ""))


def normal_unit(c: Column) -> Column:
    token = F.regexp_replace(F.lower(c), r"[.\s]", "")
    return F.coalesce(lookup(P.UNIT_ALIASES, token), token)


def canonical_factor(basis: Column, unit: Column) -> Column:
    flat = {f"{b}/{u}": f for b, units in P.CANONICAL_FACTORS.items() for u, f in units.items()}
    return lookup(flat, F.concat_ws("/", basis, unit))


def is_phone(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return has(c, r"[\s\-]") | (digits <= P.PHONE_MAX_UNGROUPED)


def phone(c: Column) -> Column:
    return F.get(F.filter(all_groups(c, P.PHONE, 0), is_phone), F.lit(0))


def email(c: Column) -> Column:
    return group(c, P.EMAIL, 0)
