"""Operators that prepare training data: packing, chat windows, tokens, archives, shards, filters."""
