"""Looks into files: binary or text, hex dump, first lines, an image's size."""

from __future__ import annotations

import struct

from kindred.schema import CATEGORIES

TEXT = frozenset([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0x100)])
TEXT_KINDS = frozenset(["txt", "md", "rst", "csv", "json", "xml", "html", "toml", "yaml", "yml", "log"])
SNIFFED, DUMPED, LINES, LINE_BYTES = 512, 256, 50, 4096


def is_binary(content: bytes) -> bool:
    """Any NUL, or over a tenth of other control bytes, in the first bytes."""
    head = content[:SNIFFED]
    return b"\0" in head or sum(b not in TEXT for b in head) * 10 > len(head)


def hex_dump(content: bytes) -> str:
    out = []
    for at in range(0, min(len(content), DUMPED), 16):
        row = content[at : min(at + 16, DUMPED)]
        out.append(f"{at:08x}  {' '.join(f'{b:02x}' for b in row):<47}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in row)}|")
    return "\n".join(out)


def text_preview(content: bytes) -> str:
    return "\n".join(content[:LINE_BYTES].decode("utf-8", "replace").split("\n")[:LINES])


def image_size(content: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height) from the header of a PNG, GIF, BMP or JPEG."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return ("PNG", *struct.unpack(">II", content[16:24]))
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return ("GIF", *struct.unpack("<HH", content[6:10]))
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return "BMP", w, abs(h)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4])
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + size
    return None


def preview(name: str, content: bytes) -> str:
    """By the name's kind, an image before a text; other names by what the content looks like."""
    kind = name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""
    if kind in CATEGORIES["images"] and (found := image_size(content)):
        return "{} {} x {}".format(*found)
    if kind in TEXT_KINDS:
        return text_preview(content)
    if found := image_size(content):
        return "{} {} x {}".format(*found)
    return hex_dump(content) if is_binary(content) else text_preview(content)
