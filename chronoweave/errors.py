"""Exceptions, raised while a plan is built; at run time only where the data itself must stop a query."""


class ChronoweaveError(Exception):
    """Base of all."""


class TimeError(ChronoweaveError):
    """A time, range or index that cannot be read."""


class FieldError(ChronoweaveError):
    """A column path that does not exist or does not fit."""


class SeriesError(ChronoweaveError):
    """A series that cannot be built or used so."""


class PipelineError(ChronoweaveError):
    """A pipeline step that does not fit its state."""


class ReducerError(ChronoweaveError):
    """A reducer or missing-value policy that does not exist, or its parameters."""
