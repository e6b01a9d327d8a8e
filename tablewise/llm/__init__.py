"""Operators for preparing training text: language, quality, copies, licences, tokens."""
