"""Errors of building and opening an index."""


class EmptyCorpusError(ValueError):
    """The inputs hold no regular file."""


class IndexFormatError(ValueError):
    """What was opened isn't an index of a version that can be read."""
