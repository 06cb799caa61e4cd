"""Lexicon, configuration and corpus sources and sinks."""
