"""Errors with stable codes."""


class EngineError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def require(ok: bool, code: str, message: str) -> None:
    if not ok:
        raise EngineError(code, message)
