"""vellumdb: schema-less document search on Spark."""

from .database import Database
from .engine import MemoryEngine
from .errors import CorruptionError, DatabaseClosedError, LockError, QueryError, RecoveryError, StorageError, ValidationError, VellumError
from .functions.bloom import BloomFilter
from .functions.documents import parse_document, parse_json_text, verify_document
from .operators.compaction import CompactionPlan
from .operators.extract import extract_entries, extract_scoped
from .operators.postings import PostingList
from .options import DatabaseOptions, EngineOptions
from .plans.parser import Plan, compile_query, parse_query, plan_query
from .plans.paths import format_path, normalise, parse_path
from .results import SearchResult

__all__ = [
    "BloomFilter", "CompactionPlan", "CorruptionError", "Database", "DatabaseClosedError", "DatabaseOptions", "EngineOptions", "LockError", "MemoryEngine", "Plan", "PostingList", "QueryError",
    "RecoveryError", "SearchResult", "StorageError", "ValidationError", "VellumError", "compile_query", "extract_entries", "extract_scoped", "format_path", "normalise", "parse_document", "parse_json_text",
    "parse_path", "parse_query", "plan_query", "verify_document",
]
