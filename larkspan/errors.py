"""Errors of the engine; each carries a sentence that says what is wrong."""


class EngineError(Exception):
    """Base of all engine errors."""


class ParseError(EngineError):
    """The text is not a statement of the dialect."""


class BindError(EngineError):
    """Names, types or aggregates do not fit together."""


class ExecError(EngineError):
    """A statement cannot be carried out."""


class TxnError(EngineError):
    """A transaction cannot begin, commit or roll back."""
