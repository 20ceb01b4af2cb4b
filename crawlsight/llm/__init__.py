"""Training-data operators: dedup, quality, formatting, mixing, packing, scoring and search.

Nothing outside this subpackage imports it; its queries and SQL live in
``crawlsight.llm.queries`` and ``crawlsight.llm.oracles``.
"""
