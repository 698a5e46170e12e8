from .urls import with_canonical_url, with_policy_target, with_url_host, with_url_without_query
from .text import clean_title, embedding_text, py_strip, tokens

__all__ = [
    "clean_title",
    "embedding_text",
    "py_strip",
    "tokens",
    "with_canonical_url",
    "with_policy_target",
    "with_url_host",
    "with_url_without_query",
]
