"""Typed settings from a mapping such as os.environ: wrong values fail when a job is planned. Driver only."""

from __future__ import annotations

import os
import secrets
from collections.abc import Mapping
from dataclasses import dataclass, field

from maskloom.functions.text import pattern

# What counts as true and false.
TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def flag(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    value = env.get(name, "").strip().lower()
    if value and value not in TRUE | FALSE:
        raise ValueError(f"{name} must be a yes or a no")
    return value in TRUE if value else default


def number(env: Mapping[str, str], name: str, default: int, low: int, high: int = 1 << 62) -> int:
    text = env.get(name, "").strip()
    if text and not text.lstrip("-").isdigit():
        raise ValueError(f"{name} must be a whole number")
    value = int(text) if text else default
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
    return value


@dataclass(frozen=True)
class Settings:
    """Settings that change what is computed. Keys are hidden when it is printed."""

    tenant_key: bytes = field(repr=False)
    tenant: str = "default"
    disabled: tuple[str, ...] = ()
    geo_whitelist: bool = True
    restore_bare: bool = True
    realistic_fake: bool = False
    marker: str = "[REDACTED]"
    stream_token: int = 64
    audit: bool = False
    audit_k: int = 5
    alias_expansion: bool = False
    alias_mentions: int = 200
    quasi_gauge: bool = False
    quasi_threshold: float = 0.5
    ner_threshold: float = 0.70
    vault_ttl: int = 7 * 86_400
    ingest_seconds: int = 60
    poll_seconds: int = 30
    verify_ttl: int = 300

    def policy(self) -> dict:
        """What the policy hash covers: everything but keys."""
        return {k: v for k, v in self.__dict__.items() if k != "tenant_key"}


def load(env: Mapping[str, str], prefix: str = "MASKLOOM_") -> Settings:
    """Settings from ``prefix`` and their names in capitals; the key is required, hexadecimal, 32 bytes."""
    e = {k[len(prefix):]: v for k, v in env.items() if k.startswith(prefix)}
    if "TENANT_KEY" not in e:
        raise ValueError(f"{prefix}TENANT_KEY is required")
    key = bytes.fromhex(e["TENANT_KEY"])
    if len(key) != 32:
        raise ValueError("the tenant key has 32 bytes")
    disabled = tuple(x.strip() for x in e.get("DISABLED", "").split(",") if x.strip())
    pattern(list(disabled))  # unknown names fail here
    share = lambda name, default: min(1.0, max(0.0, float(e.get(name) or default)))
    return Settings(
        tenant_key=key, tenant=e.get("TENANT") or "default", disabled=disabled, geo_whitelist=flag(e, "GEO_WHITELIST", True), restore_bare=flag(e, "RESTORE_BARE", True),
        realistic_fake=flag(e, "REALISTIC_FAKE"), marker=e.get("MARKER") or "[REDACTED]", stream_token=number(e, "STREAM_TOKEN", 64, 1, 256), audit=flag(e, "AUDIT"),
        audit_k=max(2, number(e, "AUDIT_K", 5, 0)), alias_expansion=flag(e, "ALIAS_EXPANSION"), alias_mentions=number(e, "ALIAS_MENTIONS", 200, 1), quasi_gauge=flag(e, "QUASI_GAUGE"),
        quasi_threshold=share("QUASI_THRESHOLD", 0.5), ner_threshold=share("NER_THRESHOLD", 0.70), vault_ttl=number(e, "VAULT_TTL", 7 * 86_400, 1),
        ingest_seconds=number(e, "INGEST_SECONDS", 60, 1), poll_seconds=number(e, "POLL_SECONDS", 30, 1), verify_ttl=number(e, "VERIFY_TTL", 300, 0),
    )


def key_file(path: str, size: int) -> bytes:
    """The bytes of a key or salt file, which is made, for its owner only, if missing; another size is an error."""
    try:
        handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    except FileExistsError:
        with open(path, "rb") as f:
            data = f.read()
        if len(data) != size:
            raise ValueError(f"{path} must have {size} bytes") from None
        return data
    data = secrets.token_bytes(size)
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    return data


def passphrase(keychain, env: Mapping[str, str], name: str = "MASKLOOM_PASSPHRASE") -> str:
    """From the keychain (a callable that may give None or fail), else the environment; none or blank is an error."""
    try:
        found = keychain() if keychain else None
    except Exception:  # no keychain here
        found = None
    found = found or env.get(name)
    if not found or not found.strip():
        raise ValueError("no passphrase in the keychain or the environment")
    return found
