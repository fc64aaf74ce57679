"""Errors raised on the driver."""


class EngineError(Exception):
    """Base of all errors of this package."""


class ConfigurationError(EngineError):
    """A configuration has unknown keys, wrong types or values out of range."""


class ContractError(EngineError):
    """Data does not keep the contract of its table."""


class FixtureError(ContractError):
    """A fixture is not what its description says."""


class DataValidationError(ContractError):
    """A table has rows that may not be there."""


class OutputConflictError(EngineError):
    """An output exists already with other contents."""
