"""Words of a text for ranked search and decontamination: runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z count as a-z."""

from __future__ import annotations

import pyarrow as pa

_KEPT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_KEPT).split() if text else []


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
