"""One typed error per cause, so a caller can tell a bad request from bad data."""


class PanelmillError(Exception):
    """Base class of every error raised by this package."""


class EmptyInputError(PanelmillError):
    """The input table has no rows."""


class SpecError(PanelmillError):
    """A chart spec asks for something the table or the engine cannot give."""


class OrderRequiredError(PanelmillError):
    """The result depends on row order and no order column was given."""


class ConstraintError(PanelmillError):
    """Rows violate a catalog constraint."""


class ConcurrentWriteError(PanelmillError):
    """Another job committed first."""
