"""Search requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from seekspan.functions import fixed
from seekspan.operators.topk import check_page


@dataclass(frozen=True)
class SearchRequest:
    """What to search and how to present it. Zero or missing numbers mean the defaults; others must be in range."""

    text: str = ""
    collection: str | Sequence[str] | None = None
    projects: Sequence[str] = ()
    top_k: int = fixed.DEFAULT_TOP_K
    filters: Mapping[str, str] = field(default_factory=dict)
    languages: Sequence[str] | str = ()
    path_prefix: str = ""
    exclude_path: str = ""
    include_deleted: bool = False
    deleted_only: bool = False
    model_id: str | None = None
    page: int = fixed.DEFAULT_PAGE
    page_size: int = fixed.DEFAULT_PAGE_SIZE

    def window(self) -> tuple[int, int, int]:
        """Checked (top_k, page, page_size)."""
        return check_page(self.top_k, self.page, self.page_size)
