"""Which file a path leads to: device, inode, and the time the file was made, for inodes are used again."""

import ctypes
import functools
import os
import struct

_BUFFER = 256
_EMPTY_PATH, _HERE, _BIRTH = 0x1000, -100, 0x800


@functools.cache
def _statx():
    try:
        call = ctypes.CDLL(None).statx
    except (OSError, AttributeError):
        return None
    call.argtypes = [ctypes.c_int, ctypes.c_char_p, ctypes.c_int, ctypes.c_uint, ctypes.c_char_p]
    return call


def born(place: str | int) -> int | None:
    """When the file (a path or a descriptor) was made, in nanoseconds; None where the file system does not tell."""
    call = _statx()
    if call is None:
        return None
    found = ctypes.create_string_buffer(_BUFFER)
    at, name, flags = (place, b"", _EMPTY_PATH) if isinstance(place, int) else (_HERE, os.fsencode(place), 0)
    if call(at, name, flags, _BIRTH, found) or not struct.unpack_from("=I", found, 0)[0] & _BIRTH:
        return None
    seconds, nanos = struct.unpack_from("=qI", found, 80)
    return seconds * 10**9 + nanos


def measured(place: str | int) -> tuple[str, int] | None:
    """(identity, size) of a file; None if there is none."""
    try:
        stat = os.stat(place)
    except OSError:
        return None
    return f"{stat.st_dev}:{stat.st_ino}:{born(place) or 0}", stat.st_size
