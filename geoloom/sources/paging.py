"""Requests with retries, and the page order of both providers.  Plain Python:
a data source's reader runs it on executors."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from typing import Any

from ..config import FetchOptions
from ..operators.grid import BBox

log = logging.getLogger(__name__)

#: Statuses worth another attempt, and the fields asked of provider A.
RETRY_STATUSES = frozenset({429, 500, 502, 503, 504})
NESTED_FIELDS = "id,captured_at,geometry,computed_geometry,thumb_2048_url,thumb_1024_url,thumb_original_url,sequence"
NESTED_URL, FLAT_URL = "https://graph.mapillary.com/images", "https://api.openstreetcam.org/2.0/photo/"


def request(session: Any, url: str, params: dict, options: FetchOptions, sleep: Callable[[float], None] = time.sleep) -> Any:
    """A response, after up to ``options.retries`` attempts with growing pauses.

    Failed connections and the retry statuses are tried again; the last failure,
    and any other bad status at once, is raised.
    """
    for attempt in range(1, options.retries + 1):
        last = attempt == options.retries
        try:
            answer = session.get(url, params=params, timeout=options.timeout_sec)
        except Exception:
            if last:
                raise
        else:
            if last or answer.status_code not in RETRY_STATUSES:
                answer.raise_for_status()
                return answer
            answer.close()
        sleep(options.backoff_sec * attempt)
    raise AssertionError("unreachable: retries is 1 or more")


def extract_page(payload: Any) -> tuple[list, bool]:
    """Provider B's items and whether more follow, from any of its page shapes."""
    if isinstance(payload, list):
        return payload, bool(payload)
    if not isinstance(payload, dict):
        return [], False
    result, data = payload.get("result"), payload.get("data")
    if not isinstance(result, dict):
        return (data, bool(data)) if isinstance(data, list) else ([], False)
    items = result.get("data")
    items = items if isinstance(items, list) else []
    more = result.get("hasMore")
    if isinstance(more, bool):
        return items, more
    page, pages = result.get("currentPage") or result.get("page"), result.get("totalPages")
    if isinstance(page, int) and isinstance(pages, int):
        return items, page < pages
    return items, bool(items)


def nested_items(session: Any, token: str, box: BBox, options: FetchOptions, sleep: Callable[[float], None] = time.sleep) -> Iterator[Any]:
    """Provider A's items of a tile; follows the cursor, whose url holds its parameters."""
    url, params = NESTED_URL, {"access_token": token, "fields": NESTED_FIELDS, "bbox": box.query_text(), "limit": options.limit}
    for _ in range(options.max_pages):
        answer = request(session, url, params, options, sleep)
        payload = answer.json()
        payload = payload if isinstance(payload, dict) else {}
        yield from payload["data"] if isinstance(payload.get("data"), list) else []
        paging = payload.get("paging")
        following = paging.get("next") if isinstance(paging, dict) else None
        if not isinstance(following, str) or not following:
            return
        url, params = following, {}
    log.warning("a tile was cut at %d pages: %s", options.max_pages, box.query_text())


def flat_items(session: Any, box: BBox, options: FetchOptions, sleep: Callable[[float], None] = time.sleep) -> Iterator[Any]:
    """Provider B's items of a tile, by page numbers from 1; the last page's count, too."""
    for page in range(1, options.max_pages + 1):
        answer = request(session, FLAT_URL, {"ipp": options.limit, "page": page, "bbox": box.query_text()}, options, sleep)
        items, more = extract_page(answer.json())
        yield from items
        if not more or not items:
            return
    log.warning("a tile was cut at %d pages: %s", options.max_pages, box.query_text())
