"""Incremental maintenance: staging and freshness of document sets."""
