"""A lexical retrieval and analytics engine whose data are Parquet tables and whose answers are Spark plans."""

from .functions.text import custom_tokens, hit_ranges, hit_span, query_tokens, snippet, tokenizer_status, tokens, word_tokens
from .index.index import Index, Stage, build_index, open_index
from .index.store import ConflictError
from .operators.views import ViewError
from .plans.routing import route_update

__all__ = ["ConflictError", "Index", "Stage", "ViewError", "build_index", "custom_tokens", "hit_ranges", "hit_span", "open_index", "query_tokens", "route_update", "snippet", "tokenizer_status", "tokens", "word_tokens"]
