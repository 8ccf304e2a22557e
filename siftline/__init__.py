"""siftline: indexed, exact regular-expression search over text tables and file trees, on Spark."""

from siftline.operators.index import BuildStats, CorruptIndex, Index, build, search, update
from siftline.operators.search import brute, in_order, json_lines, text_lines
from siftline.plans.planner import QueryPlan, decompose
from siftline.plans.regex import InvalidPattern
from siftline.sources.tables import table_corpus
from siftline.sources.tree import ScanOptions, tree_corpus

__all__ = [
    "BuildStats", "CorruptIndex", "Index", "InvalidPattern", "QueryPlan", "ScanOptions", "brute", "build", "decompose", "in_order",
    "json_lines", "search", "table_corpus", "text_lines", "tree_corpus", "update",
]
