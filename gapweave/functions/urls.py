"""Column functions over links."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that never carry usable values, and file endings.
BLOCKED_DOMAINS = (
    "facebook.com",
    "twitter.com",
    "instagram.com",
    "tiktok.com",
    "youtube.com",
    "pinterest.com",
    "reddit.com",
)
FILE_ENDINGS = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip)$"

BLANKS = " \t\r\n\f\x0b"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(BLANKS))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def is_valid_url(url: Column, match_host: bool = False) -> Column:
    """http(s) link that names no blocked domain.

    The rule looks for a blocked name anywhere in the link; ``match_host``
    looks only at the host.
    """
    link = strip(url)
    names = "|".join(re.escape(d) for d in BLOCKED_DOMAINS)
    if match_host:
        blocked = F.coalesce(F.lower(host(link)).rlike(rf"(^|\.)({names})$"), F.lit(False))
    else:
        blocked = F.lower(link).rlike(names)
    return F.coalesce(link.rlike("^https?://") & ~blocked, F.lit(False))


def is_file_link(url: Column) -> Column:
    """The link, without query and fragment, ends like a document or archive."""
    return F.coalesce(F.regexp_replace(url, r"[?#].*$", "").rlike(FILE_ENDINGS), F.lit(False))


def build_query(name: Column, context: Column, purpose: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws(" ", name, F.nullif(context, empty), F.nullif(purpose, empty))
