"""Scan options and the fixed values they default to."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: must be equal everywhere for equal results -------------------------------
MIB = 1024 * 1024
TEXT_PREVIEW_BYTES = 5 * MIB
BINARY_PREVIEW_BYTES = 3 * MIB
ENCODING_SAMPLE_BYTES = 512 * 1024
BINARY_SAMPLE_BYTES = 8192
MAX_FILE_MIB = 50
CHUNK_ENTRIES = 256
LOG_BUFFER_ROWS = 1000
CACHE_LIMIT_MIB = 1000
CACHE_KEEP_SHARE = 0.75
DEFAULT_EXCLUDED_FOLDERS = ("node_modules", ".git", "__pycache__", ".venv", "dist", "build")
DEFAULT_EXCLUDED_FILES = (
    "*.tmp", "config.json", ".repo_structure_cache", "package-lock.json", "favicon.ico",
)
DEFAULT_EXCLUDE_PATTERNS = ("*.pyc", "*.pyo", "*.pyd", ".DS_Store", "Thumbs.db")
DEFAULT_IMAGE_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp", ".tiff", ".ico",
)
# --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ScanOptions:
    """What to leave out, how much of a file to read and how to show its times.

    ``excluded_files`` holds exact names: an entry such as ``*.tmp`` matches only a file of
    that very name. Globs and ``regex:`` rules belong into ``exclude_patterns``. Texts that are not UTF-8
    are read as ``fallback_encoding`` (``"utf-8"`` with replacements, or ``"latin_1"``), which keeps
    Python out of the plan; without one their codec is guessed.
    """

    excluded_folders: tuple[str, ...] = DEFAULT_EXCLUDED_FOLDERS
    excluded_files: tuple[str, ...] = DEFAULT_EXCLUDED_FILES
    exclude_patterns: tuple[str, ...] = DEFAULT_EXCLUDE_PATTERNS
    image_extensions: tuple[str, ...] = DEFAULT_IMAGE_EXTENSIONS
    max_file_size: int = MAX_FILE_MIB * MIB
    include_binary: bool = False
    follow_symlinks: bool = False
    encoding: str | None = None
    fallback_encoding: str | None = None
    timezone: str = "UTC"
    text_preview_bytes: int = TEXT_PREVIEW_BYTES
    binary_preview_bytes: int = BINARY_PREVIEW_BYTES
    detect_charset: bool = True
    hash_algorithm: str | None = "xxh64"
    cache_validate: str = "stat"

    @property
    def text_limit(self) -> int:
        return min(self.max_file_size, self.text_preview_bytes)

    @property
    def binary_limit(self) -> int:
        return min(self.max_file_size, self.binary_preview_bytes)
