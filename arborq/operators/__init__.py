"""Operators over one document's tree: evaluate() runs an expression on a Python value."""

from arborq.operators.tree import EvalError, Match, evaluate, register

__all__ = ["EvalError", "Match", "evaluate", "register"]
