"""E-mail addresses and phone numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import constants as K


def normalize_email(email: Column) -> Column:
    """Trimmed, lower case, without a ``+tag``; dots of Gmail mailboxes go and its two domains are one.

    A value without ``@`` stays as it is; one without a mailbox becomes empty.
    """
    e = F.lower(F.trim(email))
    at = F.locate("@", e)
    local = F.substring_index(F.substring(e, F.lit(1), at - 1), "+", 1)
    domain = F.substring(e, at + 1, F.length(e))
    google = domain.isin(*K.GMAIL_DOMAINS)
    local = F.when(google, F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    domain = F.when(google, F.lit("gmail.com")).otherwise(domain)
    return F.when(at == 0, e).when(F.length(local) == 0, F.lit("")).otherwise(F.concat(local, F.lit("@"), domain))


def is_generic_email(email: Column) -> Column:
    return email.rlike(f"^({'|'.join(K.GENERIC_MAILBOXES)})@")


def email_confidence(email: Column, frequency: Column) -> Column:
    """1, less for shared mailboxes and for addresses that many entities have."""
    generic = F.when(is_generic_email(email), 0.9).otherwise(1.0)
    return generic * F.when(frequency > 10, 0.85).when(frequency > 5, 0.92).otherwise(1.0)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def normalize_phone(number: Column) -> Column:
    """Digits without the North American 1; empty unless 7 to 15 are left."""
    d = digits(number)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(d.isNull() | F.length(d).between(7, 15), d).otherwise(F.lit(""))


def phone_confidence(extension_1: Column, extension_2: Column) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.when(blank(extension_1).eqNullSafe(blank(extension_2)), 0.95).otherwise(0.85)


def same_digits(a: Column, b: Column) -> Column:
    """Equal numbers by digits alone, without any prefix rule."""
    return digits(a) == digits(b)
