"""Errors that say what was expected, what was found, and how to recover."""


class EngineError(Exception):
    def __init__(self, message: str, *, expected: object = None, actual: object = None, recovery: str | None = None) -> None:
        parts = [message, *(f"{k}: {v}" for k, v in (("expected", expected), ("actual", actual), ("recovery", recovery)) if v is not None)]
        super().__init__("; ".join(parts))


class ConfigurationError(EngineError):
    """Settings that contradict themselves."""


class CorpusError(EngineError):
    """A source that cannot be read as lines."""


class ArtifactError(EngineError):
    """A stored table that is missing, damaged or stale."""


class EvaluationError(EngineError):
    """Evaluation items or splits that are not usable."""


class HeldOutError(EvaluationError):
    """Use of held-out items without permission."""
