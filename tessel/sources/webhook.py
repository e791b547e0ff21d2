"""Notice of a job's end to a web address; driver side, and never a reason for a job to fail."""

from __future__ import annotations

import json
from collections.abc import Callable

from tessel.functions.keys import sign


def notice(job: dict, secret: str | None = None) -> tuple[bytes, dict[str, str]]:
    """Body and headers of a notice; signed if there is a secret."""
    body = json.dumps(job, default=str, sort_keys=True).encode()
    headers = {"Content-Type": "application/json"}
    return body, headers | ({"X-Signature": sign(body, secret)} if secret else {})


def notify(job: dict, post: Callable[[str, bytes, dict], object], secret: str | None = None) -> bool:
    """Send the notice of ``job`` by ``post(url, body, headers)``; whether it went out."""
    url = job.get("webhook_url")
    if not url:
        return False
    try:
        post(url, *notice(job, secret))
    except Exception:  # noqa: BLE001 - any failure to notify is swallowed on purpose
        return False
    return True
