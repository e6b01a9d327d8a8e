"""Readers for files, databases and records, with the guards in front of them."""
