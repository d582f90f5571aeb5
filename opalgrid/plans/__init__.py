"""Operator trees, their JSON form, and their compilation to DataFrames."""

from .compiler import Compiler, compile_plan
from .tree import Col, Cross, Filter, Lit, Plan, Predicate, Project, Scan, Sort, from_json, scan, to_json

__all__ = ["Col", "Compiler", "Cross", "Filter", "Lit", "Plan", "Predicate", "Project", "Scan", "Sort", "compile_plan", "from_json", "scan", "to_json"]
