"""Column functions on paths and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of images in audits and in single predictions.
AUDIT_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
UPLOAD_SUFFIXES = (".jpg", ".jpeg", ".png")


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def has_suffix(path: Column, allowed: tuple[str, ...]) -> Column:
    return suffix(path).isin(*allowed)


def uploadable(path: Column, allowed: tuple[str, ...] = UPLOAD_SUFFIXES) -> Column:
    """A name without suffix passes; so does a null name, as of a bare stream."""
    return F.coalesce((suffix(path) == "") | has_suffix(path, allowed), F.lit(True))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def destination_name(sha256: Column, path: Column) -> Column:
    return F.concat(F.substring(sha256, 1, 12), F.lit("_"), basename(path))


def plain_path(path: Column) -> Column:
    """A local file's path without its scheme, however many slashes follow that."""
    return F.regexp_replace(path, "^file:/+", "/")
