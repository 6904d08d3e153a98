"""Column functions over page bodies.

All are regular-expression column expressions: no parser, no Python worker,
one pass per page inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPTS = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
COMMENTS = r"(?s)<!--.*?-->"
ANY_TAG = r"(?s)<[^>]+>"
TAG_WITH_ATTRIBUTES = r"(?s)<([a-zA-Z][a-zA-Z0-9]*)\s[^>]*>"
HEADING_OPEN = r"(?i)<(h1|h2|h3)(\s[^>]*)?>"
BLOCK_TAG = (
    r"(?i)</?(p|li|ul|ol|h1|h2|h3|div|section|article|nav|footer|header|table|tr|body|br)"
    r"(\s[^>]*)?/?>"
)
# Separators that cannot occur in a page's visible text.
BLOCK_MARK = "\x01"
SECTION_MARK = "\x02"


def without_noise(html: Column) -> Column:
    """Drop script and style bodies and comments."""
    return F.regexp_replace(F.regexp_replace(html, SCRIPTS, " "), COMMENTS, " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def reduce_html(html: Column) -> Column:
    """Shorter page with the same visible content: no noise, bare tags."""
    return squeeze(F.regexp_replace(without_noise(html), TAG_WITH_ATTRIBUTES, "<$1>"))


def reduction_percent(before: Column, after: Column) -> Column:
    return F.round((F.lit(1.0) - F.try_divide(F.length(after), F.length(before))) * 100, 4)


def decode_entities(text: Column) -> Column:
    # &amp; last, so that "&amp;lt;" becomes "&lt;" and not "<".
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_to_text(html: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(without_noise(html), ANY_TAG, " ")))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def marked_text(html: Column) -> Column:
    """Visible text with a mark at each structural border."""
    text = F.regexp_replace(without_noise(html), HEADING_OPEN, SECTION_MARK)
    text = F.regexp_replace(text, BLOCK_TAG, BLOCK_MARK)
    text = F.regexp_replace(text, ANY_TAG, " ")
    return F.regexp_replace(text, r"\s+", " ")


def page_sections(html: Column) -> Column:
    """``array<array<string>>``: blocks grouped by the heading they stand under.

    The part before the first heading is section 0.  Empty blocks are dropped,
    empty sections stay so that section numbers keep their meaning.
    """
    sections = F.split(marked_text(html), SECTION_MARK)
    return F.transform(
        sections,
        lambda s: F.filter(
            F.transform(F.split(s, BLOCK_MARK), lambda b: F.trim(b)), lambda b: b != ""
        ),
    )


def page_blocks(html: Column) -> Column:
    """``array<string>`` of non-empty blocks in page order."""
    return F.flatten(page_sections(html))
