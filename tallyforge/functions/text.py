"""Text expressions: names, invoice numbers, slugs, escapes. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a company's legal form, which no two systems write alike.
LEGAL_FORMS = ["llc", "inc", "incorporated", "corp", "corporation", "ltd", "limited", "co", "company", "sdn", "bhd", "berhad", "s/b", "sb", "pvt", "private", "plc", "gmbh", "llp", "plt", "pte", "pty"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def vendor_clean(name: Column) -> Column:
    """A vendor's name without case, stops, article, bracketed parts and legal form; null: empty. A name of nothing else
    keeps all but case, stops and article."""
    plain = F.regexp_replace(F.regexp_replace(strip(F.lower(name)), "[.,]", ""), r"(?U)^the\s+", "")

    def bare(p: Column) -> Column:
        short = squeeze(F.regexp_replace(F.regexp_replace(p, r"\(.*?\)", " "), rf"(?U)\b({'|'.join(LEGAL_FORMS)})\b", ""))
        return bound(short, lambda s: F.when(s != "", s).otherwise(squeeze(p)))

    return F.coalesce(bound(plain, bare), F.lit(""))


def invoice_key(number: Column) -> Column:
    """Letters and digits of an invoice number, in capitals."""
    return F.regexp_replace(F.upper(number), "[^A-Z0-9]", "")


def clean_id(number: Column) -> Column:
    """An invoice number in capitals, without dashes and spaces."""
    return F.upper(F.translate(number, "- ", ""))


def id_shape(cleaned: Column) -> Column:
    """A cleaned number with # for every digit."""
    return F.regexp_replace(cleaned, r"(?U)\d", "#")


def name_block(cleaned_name: Column, length: int) -> Column:
    """The first characters of a cleaned vendor name."""
    return F.substring(strip(F.lower(cleaned_name)), 1, length)


def vendor_slug(cleaned_name: Column) -> Column:
    """The id that a vendor gets who has none: V- and the name's letters and digits, joined by dashes."""
    dashed = F.substring(F.regexp_replace(F.regexp_replace(cleaned_name, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.concat(F.lit("V-"), F.when(dashed != "", F.upper(dashed)).otherwise("UNKNOWN"))


def csv_safe(text: Column) -> Column:
    """A quote before text that a spreadsheet would run as a formula."""
    return F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def markdown_safe(text: Column) -> Column:
    """A backslash before each ASCII punctuation character."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


def header_name(text: str) -> str:
    """A column heading in small letters, with one space for white space and separators."""
    for ch in "_-.#:":
        text = text.replace(ch, " ")
    return " ".join(text.lower().split())
