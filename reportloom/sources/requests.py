"""Request rules of the report service: validation, access, and the upload name."""

from __future__ import annotations

import hmac
import re
from collections.abc import Mapping

# fixed values: paths open to everyone
OPEN_PATHS = {"/", "/docs", "/docs/", "/health", "/api/health", "/api/v1/health", "/api/v1/reports/samples"}
UPLOAD_BYTES = 100 << 20


def check_request(body: Mapping) -> list[str]:
    """What is wrong with a request to read a file or to store a report."""
    wrong = []
    if "filePath" in body and not (isinstance(body["filePath"], str) and body["filePath"]):
        wrong.append("filePath must be a non-empty text")
    if "reportData" in body and not isinstance(body["reportData"], Mapping):
        wrong.append("reportData must be a record")
    if "filePath" not in body and "reportData" not in body:
        wrong.append("filePath or reportData is required")
    return wrong


def allowed(path: str, headers: Mapping[str, str], key: str | None) -> bool:
    """Whether a request may pass: open paths always, others with the key as header or bearer
    token; without a key nothing is guarded (F16)."""
    bare = path.split("?")[0]
    if not key or bare in OPEN_PATHS or bare.startswith("/docs"):
        return True
    named = {k.lower(): v for k, v in headers.items()}
    token = named.get("authorization", "")
    given = named.get("x-api-key") or (token[7:] if token.startswith("Bearer ") else "")
    return hmac.compare_digest(given.encode(), key.encode())


def upload_name(stamp_ms: int, name: str, size: int) -> str:
    """The landing name of an upload: its millisecond stamp and its own name without unsafe
    characters (R11)."""
    if size > UPLOAD_BYTES:
        raise ValueError(f"an upload has at most {UPLOAD_BYTES} bytes")
    return f"{stamp_ms:013d}_{re.sub(r'[^A-Za-z0-9._-]', '_', name)}"
