"""Readers: file trees, dictionaries, icon data and caches."""
