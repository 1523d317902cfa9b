"""Errors of the reconciliation engine."""


class ReconError(Exception):
    """Any error of this package's own."""


class SourceError(ReconError):
    """A source cannot be described, opened or read."""


class CompareError(ReconError):
    """A comparison is asked for that makes no sense for its two sides."""


class ConfigError(ReconError):
    """A setting is unknown or out of range."""
