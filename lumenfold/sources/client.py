"""A JSON client for the driver, with bounded retries. Nothing else here needs a network; what it fetches is staged as a table."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

#: Attempts, seconds of the first wait, the longest wait a server may ask for, and bytes of an answer.
ATTEMPTS, BACKOFF, LONGEST_WAIT, MOST_BYTES = 4, 1.0, 30.0, 5 << 20


class FetchError(RuntimeError):
    """No usable answer."""


def get_json(url: str, opened: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep, timeout: float = 10.0):
    """The JSON at an address. Overload and server errors are tried again, others are not; answers beyond MOST_BYTES or that are no JSON raise."""
    for attempt in range(ATTEMPTS):
        try:
            with opened(url, timeout=timeout) as answer:
                body = answer.read(MOST_BYTES + 1)
        except urllib.error.HTTPError as e:
            if attempt + 1 == ATTEMPTS or not (e.code == 429 or e.code >= 500):
                raise FetchError(f"{url}: {e.code}") from e
            asked = (e.headers or {}).get("Retry-After", "")
            sleep(min(LONGEST_WAIT, float(asked)) if asked.isdigit() else BACKOFF * 2**attempt)
            continue
        except OSError as e:
            if attempt + 1 == ATTEMPTS:
                raise FetchError(f"{url}: {e}") from e
            sleep(BACKOFF * 2**attempt)
            continue
        if len(body) > MOST_BYTES:
            raise FetchError(f"{url}: too long")
        try:
            return json.loads(body)
        except ValueError as e:
            raise FetchError(f"{url}: no JSON") from e
    raise FetchError(url)


def pages(fetch: Callable[[int, int], list], size: int) -> Iterator[list]:
    """Answers of fetch(limit, offset) page by page, until one is not full."""
    offset = 0
    while True:
        rows = fetch(size, offset)
        if rows:
            yield rows
        if len(rows) < size:
            return
        offset += size


def in_batches(values: Iterable, size: int, fetch: Callable[[list], list]) -> list:
    """fetch over batches of values, in order; a batch that fails is halved, a single value that fails raises."""

    def tried(batch: list) -> list:
        try:
            return fetch(batch)
        except FetchError:
            if len(batch) == 1:
                raise
            return tried(batch[: len(batch) // 2]) + tried(batch[len(batch) // 2 :])

    values = list(values)
    return [row for x in range(0, len(values), size) for row in tried(values[x : x + size])]
