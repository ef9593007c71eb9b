"""Errors of the store: one exception with a code."""

from __future__ import annotations

from enum import Enum


class Code(Enum):
    OK = "Ok"
    NOT_FOUND = "NotFound"
    KEY_EXISTS = "KeyExists"
    CORRUPTED = "Corrupted"
    INVALID_ARGUMENT = "InvalidArgument"
    UNSUPPORTED = "Unsupported"
    KEY_TOO_LARGE = "KeyTooLarge"
    VALUE_TOO_LARGE = "ValueTooLarge"
    MAP_FULL = "MapFull"
    TOO_MANY_DBS = "TooManyDbs"
    INCOMPATIBLE = "Incompatible"
    BAD_TRANSACTION = "BadTransaction"
    READ_ONLY = "ReadOnly"
    BUSY = "Busy"
    IO_ERROR = "IoError"
    OUT_OF_MEMORY = "OutOfMemory"
    CONFLICT = "Conflict"


class StoreError(Exception):
    def __init__(self, code: Code, message: str = ""):
        super().__init__(f"{code.value}: {message}" if message else code.value)
        self.code = code
