"""Corpus preparation for language models. Nothing outside imports this subpackage."""
