"""Column functions: previews of text values."""

from arborq.functions.previews import preview_kind, url_parts

__all__ = ["preview_kind", "url_parts"]
