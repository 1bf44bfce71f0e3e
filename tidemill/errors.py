"""Errors raised for wrong declarations or missing inputs."""


class TidemillError(Exception):
    """Base of every error this package raises itself."""


class SpecError(TidemillError):
    """A declaration that cannot be carried out as written."""


class MissingSource(TidemillError):
    """A source table that is not there."""


class UnknownName(TidemillError):
    """A query, model, dashboard, column or target nobody declared."""


class LineageError(TidemillError):
    """References to undeclared tables, or a cycle between models."""


class RunFailed(TidemillError):
    """Some steps of a run failed; ``log`` holds one record per step."""

    def __init__(self, message, log):
        super().__init__(message)
        self.log = log
