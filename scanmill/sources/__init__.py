"""Readers: web archives, statistics, dictionaries, vectors, queries, id lists."""
