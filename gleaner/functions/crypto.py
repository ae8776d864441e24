"""Decryption of password-protected JSON envelopes with Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import col


def key_of(password: Column, salt: Column) -> Column:
    """A 32-byte key: MD5 of password and salt, then of that digest with both again."""
    given = F.concat(F.encode(password, "UTF-8"), salt)
    first = F.unhex(F.md5(given))
    return F.concat(first, F.unhex(F.md5(F.concat(first, given))))


def decrypt_envelope(envelope: Column | str, password: Column | str) -> Column:
    """Plain text of {"ct": base64, "iv": hex, "s": hex} in AES-256-CBC; empty on any failure.

    Padding is checked in full, so a wrong password gives the empty string.
    """
    part = lambda name: F.get_json_object(col(envelope), f"$.{name}")
    key = key_of(F.lit(password) if isinstance(password, str) else password, F.unhex(part("s")))
    secret = F.concat(F.unhex(part("iv")), F.try_to_binary(part("ct"), F.lit("base64")))
    plain = F.try_aes_decrypt(secret, key, F.lit("CBC"), F.lit("PKCS"))
    return F.coalesce(F.when(F.length(secret) >= 32, F.decode(plain, "UTF-8")), F.lit(""))
