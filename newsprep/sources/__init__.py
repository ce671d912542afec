"""Sources and sinks."""

from .collection import compact, ensure_collection, latest_points, read_collection, read_rejects, snapshot, upsert, vacuum
from .feed import NewsFeed, feed_stream
from .files import append_log, prompt_log, read_json, read_log, read_qa, write_answers, write_json
from .landing import landing_batch, landing_stream
from .links import link_sources, read_sources
from .paged import PagedNews, parse_pages, read_pages

__all__ = [
    "NewsFeed", "PagedNews", "append_log", "compact", "ensure_collection", "feed_stream", "landing_batch", "landing_stream",
    "latest_points", "link_sources", "parse_pages", "prompt_log", "read_collection", "read_json", "read_log", "read_pages",
    "read_qa", "read_rejects", "read_sources", "snapshot", "upsert", "vacuum", "write_answers", "write_json",
]
