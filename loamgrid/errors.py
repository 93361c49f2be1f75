"""Errors that a caller can act on."""


class DataError(ValueError):
    """Something about the data or the request is wrong; the message says what."""
