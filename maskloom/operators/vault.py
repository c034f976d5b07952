"""Encrypted vault of emitted tokens with expiry: a fallback for values that a registry no longer carries."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK = 7 * 86_400


def vault_key(passphrase: bytes, salt: bytes, purpose: bytes = b"vault") -> bytes:
    """A 32-byte key by HKDF-SHA256 with one expansion block."""
    drawn = hmac.new(salt, passphrase, hashlib.sha256).digest()
    return hmac.new(drawn, purpose + b"\x01", hashlib.sha256).digest()


def _key_row(spark: SparkSession, key: bytes) -> DataFrame:
    if len(key) != 32:
        raise ValueError("the vault takes a key of 32 bytes")
    return F.broadcast(spark.createDataFrame([(key,)], "vault_key binary"))  # one row


def put(registry: DataFrame, key: bytes, stored_at: str, ttl: int = WEEK) -> DataFrame:
    """(token, sealed, expires_at): each token's value under AES-256-GCM, bound to the token, with its latest expiry.

    Rows with null token or value are not kept.
    """
    rows = registry.filter(F.col("token").isNotNull() & F.col("value").isNotNull())
    latest = rows.groupBy("token").agg(F.min("value").alias("value"), (F.max(stored_at) + ttl).alias("expires_at"))
    sealed = F.aes_encrypt(F.col("value"), F.col("vault_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("token"))
    return latest.crossJoin(_key_row(registry.sparkSession, key)).select("token", sealed.alias("sealed"), "expires_at")


def fill(registry: DataFrame, vault: DataFrame, key: bytes, now: int) -> DataFrame:
    """``registry`` (request_id, token, kind, value) with missing values taken from unexpired vault rows.

    Only tokens of the registry are looked up, so the vault never widens what a request may restore;
    a row sealed under another key, or for another token, opens to null.
    """
    live = vault.filter(F.col("expires_at") > now).select("token", "sealed")
    opened = F.try_aes_decrypt(F.col("sealed"), F.col("vault_key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("token")).cast("string")
    joined = registry.join(live, "token", "left").crossJoin(_key_row(registry.sparkSession, key))
    return joined.select("request_id", "token", "kind", F.coalesce("value", opened).alias("value"))
