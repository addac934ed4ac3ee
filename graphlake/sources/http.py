"""Plain HTTP retrieval with a time limit, retries and growing pauses."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable


def _open(url: str, timeout: float, agent: str) -> tuple[int, bytes]:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
        return r.status, r.read()


def get(url: str, timeout: float = 20, retries: int = 3, backoff: float = 2.0, agent: str = "graphlake", opener: Callable[[str, float, str], tuple[int, bytes]] = _open, pause: Callable[[float], None] = time.sleep) -> tuple[int, bytes]:
    """(status, body); after each attempt that is not answered by 200 a pause of one backoff more. The status is the last one, 0 if there was none; redirects are followed."""
    status = 0
    for attempt in range(1, retries + 1):
        try:
            status, body = opener(url, timeout, agent)
        except urllib.error.HTTPError as e:
            status, body = e.code, b""
        except OSError:
            status, body = 0, b""
        if status == 200:
            return status, body
        if attempt < retries:
            pause(backoff * attempt)
    return status, b""
