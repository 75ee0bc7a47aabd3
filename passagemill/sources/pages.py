"""Live pages, a helper for the driver; queries never fetch."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import urlparse

from passagemill.operators.store import DENIED_HOSTS


class NotAllowed(ValueError):
    """An address that is not on the list, or whose host is denied."""


def check_address(url: str, listed: set[str]) -> None:
    host = (urlparse(url).hostname or "").lower()
    if any(host == d or host.endswith("." + d) for d in DENIED_HOSTS) or url.rstrip("/") not in {u.rstrip("/") for u in listed}:
        raise NotAllowed(url)


def fetch(url: str, listed: set[str], get: Callable[[str], tuple[str, str, int]], retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """(html, status) of a listed page. ``get`` returns (final address, html, status).

    The address is checked before the request and again after redirects; a violation is never tried again, any other
    failure is, after half a second more each time.
    """
    check_address(url, listed)
    last: Exception | None = None
    for attempt in range(retries + 1):
        if attempt:
            sleep(0.5 * attempt)
        try:
            final, html, status = get(url)
        except OSError as e:
            last = e
            continue
        check_address(final, listed)
        if status == 200:
            return html, status
        last = OSError(f"status {status}")
    raise OSError(f"{url}: {last}")
