"""A page server for tests: three pages, the second one empty, and one that fails."""

PAGES = {None: ("1", [1, 2]), "1": ("2", []), "2": (None, [3])}


def article(i):
    stamp = f"2024-01-01T00:00:0{i}Z"
    return {"id": i, "headline": "h", "summary": "s", "author": "a", "created_at": stamp, "updated_at": stamp,
            "url": None, "content": "c", "symbols": ["X"], "source": "w"}


def open_pages(options):
    def fetch_page(start, end, limit, token):
        if "fail" in options and options["fail"] == token:
            raise OSError("status 500")
        following, ids = PAGES[token]
        return {"news": [article(i) for i in ids][:limit], "next_page_token": following}

    return fetch_page
