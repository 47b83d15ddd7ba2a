"""Index, search, suggestion, snippet, serving and client operators."""
