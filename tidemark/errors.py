"""Exceptions raised when a contract is broken."""


class PanelError(ValueError):
    """Base of all contract errors."""


class SourceError(PanelError):
    """A source file does not match its declared schema."""


class QualityError(PanelError):
    """A data-quality check found offending rows."""


class FoldError(PanelError):
    """No usable backtest folds."""


class CurveError(PanelError):
    """No usable response curves, or a bad budget."""
