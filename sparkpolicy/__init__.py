"""Declarative document policies on Spark DataFrames."""

from .api import Catalog, Functions, Policy, Result, compile, evaluate, parse
from .lang.errors import CompileError, EvaluationError, ParseError, PolicyError, ScanError, UnsupportedPlan

__all__ = ["Catalog", "CompileError", "EvaluationError", "Functions", "ParseError", "Policy", "PolicyError", "Result", "ScanError", "UnsupportedPlan", "compile", "evaluate", "parse"]
