"""Serves landed news files by page, in place of a news service.

The folder holds ``hour=H/*.json`` with one article per line, ``H`` counting hours since 1970.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from datetime import datetime
from functools import cache, lru_cache

from pyarrow import fs


def open_pages(options: dict[str, str]):
    """A ``fetch_page`` over the folder named by the option ``folder``; the token is ``hour:offset``.

    The folder is listed once and an hour is read once, however many pages they make; one hour is held at a time.
    """
    system, root = fs.FileSystem.from_uri(options["folder"])

    def lines(hour: int) -> list[dict]:
        rows = []
        for entry in system.get_file_info(fs.FileSelector(f"{root}/hour={hour}")):
            if entry.path.endswith(".json"):
                with system.open_input_stream(entry.path) as stream:
                    rows += [json.loads(line) for line in stream.read().decode().splitlines() if line]
        return sorted(rows, key=lambda r: (datetime.fromisoformat(r["created_at"]), int(r["id"])))

    @cache
    def hours() -> list[int]:
        found = system.get_file_info(fs.FileSelector(root))
        return sorted(int(e.base_name.removeprefix("hour=")) for e in found if e.base_name.startswith("hour="))

    @lru_cache(1)
    def asked(hour: int, low: datetime, high: datetime) -> list[dict]:
        return [r for r in lines(hour) if low <= datetime.fromisoformat(r["created_at"]) <= high]

    def fetch_page(start: str, end: str, limit: int, token: str | None) -> dict:
        low, high = datetime.fromisoformat(start), datetime.fromisoformat(end)
        known, stop = hours(), high.timestamp() // 3600
        if token:
            hour, offset = (int(x) for x in token.split(":"))
        else:
            first = bisect_left(known, low.timestamp() // 3600)
            if first == len(known) or known[first] > stop:
                return {"news": [], "next_page_token": None}
            hour, offset = known[first], 0
        rows = asked(hour, low, high)
        page, left = rows[offset:offset + limit], len(rows) - offset - limit
        later = bisect_right(known, hour)
        more = later < len(known) and known[later] <= stop
        following = f"{hour}:{offset + limit}" if left > 0 else f"{known[later]}:0" if more else None
        return {"news": page, "next_page_token": following}

    return fetch_page
