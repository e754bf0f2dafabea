"""Names, labels and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from thermogrid.functions.numeric import _c

__all__ = ["snake_case", "safe_name", "label_slug", "is_target_name", "is_id_name", "is_geometry_name"]

# Characters and their replacement in file-safe names (fixed values)
_TO_UNDERSCORE = " /\\:-"
_TO_WORD = {"&": "and", "+": "plus", "@": "at", "#": "hash", "%": "pct", "=": "eq"}
_DROPPED = "'\"()[],.?!;"


def snake_case(name) -> Column:
    return F.lower(F.replace(F.regexp_replace(_c(name), "(?<=[a-z0-9])(?=[A-Z])", "_"), F.lit(" "), F.lit("_")))


def safe_name(name) -> Column:
    """Lower case, with every symbol that troubles a file name replaced or dropped."""
    out = F.translate(F.lower(_c(name)), _TO_UNDERSCORE + _DROPPED, "_" * len(_TO_UNDERSCORE))
    for symbol, word in _TO_WORD.items():
        out = F.replace(out, F.lit(symbol), F.lit(word))
    return out


def label_slug(label) -> Column:
    """Letters and digits stay, separators become underscores, other punctuation goes."""
    return F.regexp_replace(F.regexp_replace(_c(label), r"[ \-/_.]", "_"), r"[^\p{L}\p{N}_]", "")


def is_target_name(name) -> Column:
    return _c(name).rlike("(?i)lst")


def is_id_name(name) -> Column:
    n = _c(name)
    return n.rlike(r"(?i)^(fid|objectid|index|grid_id)$") | n.rlike(r"(?i)^.*(_id|\.id)$")


def is_geometry_name(name) -> Column:
    return F.lower(_c(name)).isin("geometry", "geom", "wkt", "shape", "the_geom")
