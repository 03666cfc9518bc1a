"""Rendering needs a native library, which this engine doesn't bring: the calls are here and say so."""

from __future__ import annotations

from folia.errors import RenderingUnavailable

REASON = "no rendering library is installed"


def available() -> bool:
    return False


def unavailable_reason() -> str | None:
    return None if available() else REASON


def zoom(matrix=None, dpi: float | None = None) -> tuple:
    """The matrix of a rendering: the one given, else the scale of the resolution, else the identity."""
    if matrix is not None:
        return tuple(matrix)
    scale = dpi / 72.0 if dpi else 1.0
    return scale, 0.0, 0.0, scale, 0.0, 0.0


def render(content: bytes, page: int, matrix=None, dpi: float | None = None, colorspace: str = "rgb", alpha: bool = False):
    raise RenderingUnavailable(REASON)


class Native:
    """The facade of a native library: what it is, whether it is there, and why not."""

    @staticmethod
    def available() -> bool:
        return available()

    @staticmethod
    def version() -> str | None:
        return None

    @staticmethod
    def reason() -> str | None:
        return unavailable_reason()

    @staticmethod
    def render(content: bytes, page: int, **style):
        return render(content, page, **style)

    @staticmethod
    def text(content: bytes, page: int) -> str:
        raise RenderingUnavailable(REASON)
