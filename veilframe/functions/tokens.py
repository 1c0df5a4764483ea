"""Keyed token ids and placeholders, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base 32 alphabet and the default placeholder.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PLACEHOLDER = "<<{ENTITY}:{ID}>>"


def hmac_sha256(secret: str, message: Column) -> Column:
    """Lower-case hex. The padded keys are literals of the plan: treat plans as secret."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ x for b in key) for x in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))), 256)


def base32_head(digest: Column, n: int) -> Column:
    """First n base 32 characters of a digest given in hex."""
    chars = []
    for i in range(n):
        block = F.conv(F.substring(digest, 10 * (i // 8) + 1, 10).substr(1, 10), 16, 10).cast("long")
        chars.append(F.substring(F.lit(BASE32), (F.shiftright(block, 35 - 5 * (i % 8)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def token_id(secret: str, session: Column, entity: Column, canon: Column, length: int = 6, suffix: Column | None = None) -> Column:
    """Base 32 of HMAC(secret, session|entity|canon), with |#n if suffix n is over 0.

    length is at most 48; 0 gives an empty id.
    """
    message = F.concat_ws("|", session, entity, canon)
    if suffix is not None:
        message = F.when(suffix > 0, F.concat(message, F.lit("|#"), suffix.cast("string"))).otherwise(message)
    return base32_head(hmac_sha256(secret, message), length) if length else F.lit("")


def format_token(fmt: Column | str, entity: Column, ident: Column) -> Column:
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    return F.replace(F.replace(fmt, F.lit("{ENTITY}"), entity), F.lit("{ID}"), ident)
