"""Options of indexed tables: names of codecs, index lists and sizes."""

from __future__ import annotations

CODECS = {"none": "none", "deflate": "gzip", "gzip": "gzip", "snappy": "snappy"}  # Parquet's gzip is DEFLATE
EXTENSIONS = {".deflate": "deflate", ".gz": "gzip", ".snappy": "snappy"}
MIN_BUFFER, MAX_BUFFER, BUFFER = 4 << 10, 512 << 10, 256 << 10
FILE_BUFFER = 256 << 10
STRIPE_ROWS = 10_000


def index_columns(index: str | list | tuple | None) -> list[str]:
    """Names from a list or a comma-separated text; blanks are trimmed and empty names dropped."""
    names = index.split(",") if isinstance(index, str) else list(index or ())
    names = [n.strip() for n in names if n and n.strip()]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"An index names a column once; found again: {', '.join(twice)}")
    return names


def codec(name: str | None, path: str = "") -> str:
    """The name of a codec, in any case; without one, the codec of the path's extension, or none."""
    if name is None:
        return next((c for end, c in EXTENSIONS.items() if path.endswith(end)), "none")
    if name.lower() not in CODECS:
        raise ValueError(f"Unknown codec: {name}")
    return name.lower()


def stripe_rows(n: int) -> int:
    if n < 1:
        raise ValueError(f"Rows in a stripe must be positive, found {n}")
    return int(n)


def buffer_size(n: int) -> int:
    """Held between 4 KiB and 512 KiB and rounded up to a power of two."""
    return 1 << (min(max(int(n), MIN_BUFFER), MAX_BUFFER) - 1).bit_length()


def file_buffer_size(n: int | None) -> int:
    """Bytes that a file stream buffers: more than 256 KiB only in whole pages of 4 KiB, else 256 KiB."""
    return int(n) if n and n > FILE_BUFFER and n % 4096 == 0 else FILE_BUFFER


def properties(found: dict | None) -> dict[str, str]:
    for k, v in (found or {}).items():
        if not isinstance(k, str) or not isinstance(v, str):
            raise ValueError(f"A property needs a name and a value that are text, found {k!r}: {v!r}")
    return dict(found or {})
