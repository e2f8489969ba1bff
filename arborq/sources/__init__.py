"""Formats: text to values and back (codecs), guessing (guess), tables of documents (documents)."""
