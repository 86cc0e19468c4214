"""Operators for preparing training text, each over whole tables.

One module per operator (chat, toxicity, tokens, pieces, simhash, decontaminate, warc,
brown, linechunks, hosts), ``common`` for what they share, ``queries`` and ``oracle`` for
the registered queries and the SQL they are checked against.
"""
