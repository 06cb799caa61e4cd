"""Error taxonomy."""


class LexiconError(Exception):
    """Base of every error this library raises on purpose."""


class FileNotFound(LexiconError):
    """A named lexicon or configuration does not exist."""


class InvalidFormat(LexiconError):
    """A lexicon's bytes or entries break their format's rules."""


class InvalidConfig(LexiconError):
    """A configuration document is malformed."""


class Unsupported(LexiconError):
    """A known but unsupported format or algorithm."""
