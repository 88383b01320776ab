"""File names: what may come in, what goes out, what is listed."""

from __future__ import annotations

from parchmint.plans.dialect import Dialect

# Extensions that are read.
EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "pdf")


def extension(d: Dialect, x: str) -> str:
    """After the last dot, lower-cased; nothing without one."""
    return f"lower({d.extract(x, r'\.([^.]*)\z')})"


def allowed(d: Dialect, x: str) -> str:
    return f"({extension(d, x)} IN ({', '.join(map(d.lit, EXTENSIONS))}))"


def base(d: Dialect, x: str) -> str:
    return d.rr(x, r"\.[^.]*\z", "")


def safe(d: Dialect, x: str) -> str:
    """Characters that some system forbids become _; 255 characters at most, the extension kept."""
    clean = d.rr(x, r'[<>:"/\\|?*]', "_")
    ext = d.extract(clean, r"\.([^.]*)\z")
    short = d.when((f"contains({clean}, '.')", f"substr({base(d, clean)}, 1, CAST(254 - {d.len(ext)} AS int)) || '.' || {ext}"), other=f"substr({clean}, 1, 254)")
    return d.when((f"{d.len(clean)} > 255", short), other=clean)


def unique(d: Dialect, x: str, seconds: str, token: str) -> str:
    """base_seconds_token.extension"""
    return f"{base(d, x)} || '_' || {d.cast(seconds, d.text)} || '_' || substr({token}, 1, 8) || '.' || {extension(d, x)}"


def markdown_name(d: Dialect, x: str, seconds: str) -> str:
    """Letters, digits, -, _ and . of the base, then the time."""
    return f"{d.rr(base(d, x), r'[^\p{L}\p{N}\-_.]', '')} || '_' || {seconds} || '.md'"


def listing(d: Dialect, files: str) -> str:
    """Files (filename, created, size): Markdown ones, with place by falling time and URL."""
    return f"SELECT filename, created, size, '/api/markdown/' || filename AS url, row_number() OVER (ORDER BY created DESC, filename) AS place FROM {files} WHERE filename LIKE '%.md'"
