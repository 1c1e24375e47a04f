"""The file row, and values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Extensions by category.
CATEGORIES = {
    "images": ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "svg"),
    "videos": ("mp4", "mkv", "avi", "mov", "wmv", "flv", "webm"),
    "audio": ("mp3", "wav", "flac", "m4a", "ogg", "wma"),
    "documents": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "odt", "ods", "odp"),
    "archives": ("zip", "tar", "gz", "7z", "rar", "bz2", "xz"),
}

# Sizes, thresholds, codes.
PREHASH_BYTES = 4096
IMAGE_THRESHOLDS = {"phash": 10, "dhash": 2, "ahash": 5}
DOCUMENT_THRESHOLD = 3
MIN_GROUP_SIZE = 2
EXIT_CODES = {"success": (0, "RD000"), "error": (1, "RD001"), "no_duplicates": (2, "RD002"), "partial": (3, "RD003"), "interrupted": (130, "RD130")}
SESSION_VERSION = 2

#: Counted bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class ScanOptions:
    """What a scan keeps, compares and groups."""

    min_size: int | None = None
    max_size: int | None = None
    newer_than: str | None = None
    older_than: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    skip_hidden: bool = False
    follow_symlinks: bool = False
    references: tuple[str, ...] = ()
    #: Names by root, and the ignore patterns that a root brings along; ``ignore`` comes after them.
    named_roots: dict[str, str] = field(default_factory=dict)
    root_ignore: dict[str, tuple[str, ...]] = field(default_factory=dict)
    paranoid: bool = False
    similar_documents: bool = False
    document_threshold: int = DOCUMENT_THRESHOLD
    similar_images: bool = False
    image_algorithm: str = "phash"
    image_threshold: int | None = None
    min_group_size: int = MIN_GROUP_SIZE
    #: Whether a file that cannot be read ends the scan; else it is listed and left out.
    strict: bool = False
