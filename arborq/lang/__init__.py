"""The expression language: text to tokens (tokens) to a tree (parser)."""

from arborq.lang.parser import Expr, ParseError, parse

__all__ = ["Expr", "ParseError", "parse"]
