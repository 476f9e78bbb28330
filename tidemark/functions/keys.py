"""Canonical names, content fingerprints and credential redaction."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Normalised field names whose values never reach a trace.
SENSITIVE_FIELDS = (
    "api_key", "apikey", "authorization", "client_secret", "cookie", "password",
    "proxy_authorization", "refresh_token", "secret", "set_cookie",
)
SENSITIVE_SUFFIXES = ("_api_key", "_password", "_secret", "_access_token", "_refresh_token")


def catalog_key_name(
    resource_type: Column,
    variant: Column,
    artifact_kind: Column | None = None,
    document_kind: Column | None = None,
    manifest_kind: Column | None = None,
    modality: Column | None = None,
    index_kind: Column | None = None,
) -> Column:
    """Colon-joined catalog key; absent parts are skipped."""
    middle = [artifact_kind, document_kind, manifest_kind, modality, index_kind]
    return F.concat_ws(":", resource_type, *[part for part in middle if part is not None], variant)


def fingerprint(value: Any) -> str:
    """Driver-side SHA-256 of compact JSON with sorted keys (parameters, not data)."""
    payload = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(payload.encode()).hexdigest()


def derivation_key(producer_name: str, producer_version: str, parameters: Any) -> str:
    if not producer_name.strip() or not producer_version.strip():
        raise ValueError("a derivation needs a producer name and version")
    return fingerprint(
        {"producer_name": producer_name, "producer_version": producer_version, "parameters": parameters}
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` + 24 hex digits of a SHA-256 over the parts.

    ``to_json`` of an array of strings keeps the parts apart, so ("a", "bc") and
    ("ab", "c") differ.
    """
    payload = F.to_json(F.array(*[F.coalesce(part.cast("string"), F.lit("\u0000")) for part in parts]))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(payload, 256), 1, 24))


def is_sensitive_field(name: Column) -> Column:
    normalized = F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )
    suffix = F.lit(False)
    for ending in SENSITIVE_SUFFIXES:
        suffix = suffix | normalized.endswith(ending)
    return normalized.isin(*SENSITIVE_FIELDS) | suffix


REDACTED = "[REDACTED]"


def redact(payload: Column, kind: T.DataType) -> Column:
    """``payload`` of type ``kind`` without what stands under a sensitive name, at any depth.

    Text under such a name becomes ``[REDACTED]``, a value of any other type null;
    structs, arrays and maps are followed to their ends.
    """
    return _redact(payload, kind, F.lit(False))


def _redact(value: Column, kind: T.DataType, hidden: Column) -> Column:
    if isinstance(kind, T.StructType):
        fields = [
            _redact(value[f.name], f.dataType, hidden | is_sensitive_field(F.lit(f.name))).alias(f.name) for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _redact(item, kind.elementType, hidden))
    if isinstance(kind, T.MapType):
        return F.transform_values(
            value, lambda key, item: _redact(item, kind.valueType, hidden | is_sensitive_field(key.cast("string")))
        )
    instead = F.lit(REDACTED) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)
    return F.when(hidden, instead).otherwise(value)


def redact_map(payload: Column) -> Column:
    """``redact`` for a flat map of texts."""
    return redact(payload, T.MapType(T.StringType(), T.StringType()))
