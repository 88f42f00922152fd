"""Structured secrets and personal numbers in texts: redaction with counts, secret and leak scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewarden.functions import vectors

#: Class -> (pattern, placeholder), in the order they are applied; later ones see earlier placeholders (fixed values).
REDACTED = {
    "SSN": (r"\b(?!000|666|9\d{2})\d{3}[- ]?(?!00)\d{2}[- ]?(?!0000)\d{4}\b", "[REDACTED_SSN]"),
    "CREDIT_CARD": (r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", "[REDACTED_CARD]"),
    "API_KEY": (r"\b(?:api_key_[0-9a-zA-Z]{24,32}|SECRET_KEY_[0-9A-Z]{16}|token_[0-9a-zA-Z]{36})\b", "[REDACTED_API_KEY]"),
    "EMAIL": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
}
#: Classes an administrator may ask to see; keys never.
REVEALABLE = ("SSN", "CREDIT_CARD", "EMAIL")
SECRETS = {
    "sk_key": r"(?i)sk-[a-z0-9]{20,}",
    "vendor_key": r"(?<![A-Za-z0-9])sk[-_](?:live|test|proj|svcacct|admin)[-_][A-Za-z0-9_-]{12,}",
    "aws_key": r"(?i)AKIA[0-9A-Z]{16}",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{30,}",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{30,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "private_key": r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
    "api_key": r"(?i)api[_-]?key[\s:=]+['\"]?[a-z0-9_-]{16,}",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{20,}",
    "assigned": r"(?i)\b(?:api[_-]?key|secret|password|passwd|token)\s*[:=]\s*\S{8,}",
}
PROMPT_LEAK = r"(?i)system\s+prompt:|\[SYSTEM_INSTRUCTION\]|you\s+are\s+an\s+ai\s+assistant\s+trained\s+by|\b(?:my|the) system prompt (?:is|says|reads)\b|\byou are an? .{0,40}assistant\b.{0,80}\byou must\b"


def redacted(text: Column, reveal: tuple[str, ...] = ()) -> Column:
    """struct<text, masked: map<class, count>, revealed: map<class, count>>; null stays null with empty maps."""
    shown = [c for c in reveal if c in REVEALABLE]
    current, masked, revealed = text, [], []
    for name, (pattern, placeholder) in REDACTED.items():
        count = F.coalesce(F.regexp_count(current, F.lit(pattern)), F.lit(0))
        (revealed if name in shown else masked).append(F.struct(F.lit(name).alias("key"), count.alias("value")))
        if name not in shown:
            current = F.regexp_replace(current, pattern, F.lit(placeholder).cast("string"))
    none = F.array().cast("array<struct<key:string,value:int>>")
    counts = lambda parts: F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"] > 0)) if parts else F.map_from_entries(none)
    return F.struct(current.alias("text"), counts(masked).alias("masked"), counts(revealed).alias("revealed"))


def secret_kinds(text: Column, least_length: int = 24, least_bits: float = 4.5) -> Column:
    """Kinds of secrets in a text, and ``high_entropy`` for a long token of nearly random characters."""
    t = F.coalesce(text, F.lit(""))
    long_tokens = F.filter(F.split(t, r"\s+"), lambda w: F.length(w) >= least_length)
    random = F.exists(long_tokens, lambda w: vectors.entropy(w) > least_bits)
    found = F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in SECRETS.items()], F.when(t.rlike(PROMPT_LEAK), F.lit("prompt_leak")), F.when(random, F.lit("high_entropy")))
    return F.array_compact(found)
