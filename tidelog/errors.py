"""Errors of sources and destinations."""

from __future__ import annotations

# Fixed value: number at the front of the server's message when a requested log position does not exist (any more).
INVALID_POSITION = "1236"


class TidelogError(RuntimeError):
    """Base of the library's errors."""


class SourceError(TidelogError):
    """A source could not be read."""


class InvalidPositionError(SourceError):
    """The server does not have the position that was asked for."""


class DestinationError(TidelogError):
    """A batch could not be published."""


class DecodeError(TidelogError):
    """An event, or a column's value in it, could not be read."""

    def __init__(self, message: str, entity: str = "", column: str = ""):
        super().__init__(f"{message} ({entity}{'.' if column else ''}{column})" if entity else message)
        self.entity, self.column = entity, column


def source_error(message: str) -> SourceError:
    """Error for what a server or reader said. Only a lost position calls for going back; all others for starting again from the saved state."""
    return InvalidPositionError(message) if message.lstrip().startswith(INVALID_POSITION) else SourceError(message)
