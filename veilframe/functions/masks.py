"""Pure pseudonym and mask expressions; equal inputs always give equal outputs.

``salt`` is prepended before hashing. It is empty by default, which gives the plain digests; a secret
salt keeps the digests from being reversed by trying all nine-digit numbers or all names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
ADDRESS_REDACTED = "Address_Redacted"
ZIP_REDACTED = "00000"
# Any run of characters that is not white space, Unicode spaces and separators included.
_TOKEN = r"(?U)[^\s\x1c-\x1f]+"


def _salted(c: Column, salt: str) -> Column:
    return F.concat(F.lit(salt), c) if salt else c


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def mask_ssn(c: Column, salt: str = "") -> Column:
    text = c.cast("string")
    digest = F.sha2(_salted(text, salt), 256)
    parts = F.concat_ws("-", F.substring(digest, 1, 3), F.substring(digest, 4, 2), F.substring(digest, 6, 4))
    return F.when(_blank(text), text).otherwise(parts)


def _name_digest(c: Column, salt: str) -> Column:
    text = c.cast("string")
    known = F.when(_blank(text), F.lit(UNKNOWN)).otherwise(text)
    return F.substring(F.md5(_salted(known, salt)), 1, 8)


def mask_first_name(c: Column, salt: str = "") -> Column:
    return F.concat(F.lit("Patient_"), _name_digest(c, salt))


def mask_last_name(c: Column, salt: str = "") -> Column:
    return F.concat(F.lit("ID_"), _name_digest(c, salt))


def mask_address(c: Column) -> Column:
    tokens = F.coalesce(F.regexp_count(c.cast("string"), F.lit(_TOKEN)), F.lit(0))
    counted = F.concat(F.lit("Street_"), tokens.cast("string"), F.lit("_Redacted"))
    return F.when(tokens > 1, counted).otherwise(F.lit(ADDRESS_REDACTED))


def mask_zip(c: Column) -> Column:
    whole = F.split_part(c.cast("string"), F.lit("."), F.lit(1))
    masked = F.concat(F.substring(whole, 1, 3), F.lit("XX"))
    return F.when(F.length(whole) >= 3, masked).otherwise(F.lit(ZIP_REDACTED))


def keyed_uuid(c: Column, secret: str, namespace: str) -> Column:
    """UUID-shaped digest of (secret, namespace, id): reproducible, needs no mapping and no join. The lengths in front keep
    parts apart that hold colons."""
    if not secret:
        raise ValueError("keyed pseudonyms need a secret; without one ids can be found by trying them")
    h = F.sha2(F.concat_ws(":", F.lit(f"{len(secret)}:{len(namespace)}"), F.lit(secret), F.lit(namespace), c.cast("string")), 256)
    shaped = F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(F.lit("a"), F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
    return F.when(c.isNotNull(), shaped)
