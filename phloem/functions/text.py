"""Text normalisers, ids and tests as column expressions: JVM-side, inside whole-stage codegen, no Python UDF."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accented() -> tuple[str, str]:
    """All letters up to U+1EF9 that are an ASCII letter with marks, and those ASCII letters; by rule, not by list."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x1EFA)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()] + [("đ", "d"), ("Đ", "D")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accented()
_EDGE = r" \-–—:;,.()\[\]{}"
_EDGE_SIGNS = " -–—:;,.()[]{}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it and wherever a filter carries it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def ascii_only(c: Column | str) -> Column:
    """Letters without their marks; everything else that is not ASCII is dropped."""
    return F.regexp_replace(F.translate(_col(c), _FROM, _TO), r"[^\x00-\x7F]", "")


def fold(c: Column | str) -> Column:
    """Lower case, no accents, ASCII only, blanks collapsed: the comparison form of names and cues."""
    return collapse(ascii_only(F.lower(_col(c))))


def fold_alnum(c: Column | str) -> Column:
    """``fold`` with everything but a-z and 0-9 as a blank."""
    return F.trim(F.regexp_replace(ascii_only(F.lower(_col(c))), "[^a-z0-9]+", " "))


def fold_name(c: Column | str) -> Column:
    """The entity key: folded, without emphasis marks and quotes, and without punctuation at its ends."""
    plain = F.regexp_replace(ascii_only(F.regexp_replace(F.lower(F.trim(_col(c))), r"[*_]", "")), "[\"'`]", "")
    return F.trim(F.regexp_replace(collapse(plain), rf"^[{_EDGE}]+|[{_EDGE}]+$", ""))


def strip_marks(c: Column | str) -> Column:
    """Lower case without accents; other characters that are not ASCII stay."""
    return F.regexp_replace(F.translate(F.lower(_col(c)), _FROM, _TO), r"\p{Mn}", "")


def lower_collapsed(c: Column | str) -> Column:
    """Lower case and collapsed blanks; accents stay."""
    return collapse(F.lower(_col(c)))


def spaced(c: Column | str) -> Column:
    """``collapse`` that looks for runs of blanks before it replaces any, as few texts have one; this and the next four are for millions of short texts."""
    runs = lambda x: x.contains("  ") | x.contains("\t") | x.contains("\n") | x.contains("\x0b") | x.contains("\f") | x.contains("\r")
    return let(_col(c), lambda x: F.trim(F.when(runs(x), F.regexp_replace(x, r"\s+", " ")).otherwise(x)))


def shown(c: Column | str) -> Column:
    """``display_name`` by look-ups instead of patterns."""
    plain = lambda x: F.when(x.contains("**") | x.contains("__"), F.regexp_replace(x, r"\*\*|__", "")).otherwise(x)
    return F.btrim(let(spaced(c), plain), F.lit(_EDGE_SIGNS))


def folded(c: Column | str) -> Column:
    """``fold`` by look-ups instead of patterns."""
    ascii_ = lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(x, r"[^\x00-\x7F]", ""))
    return spaced(let(F.translate(F.lower(_col(c)), _FROM, _TO), ascii_))


def unmarked(c: Column | str) -> Column:
    """``strip_marks`` with blanks collapsed, by look-ups instead of patterns."""
    bare = lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(x, r"\p{Mn}", ""))
    return spaced(let(F.translate(F.lower(_col(c)), _FROM, _TO), bare))


def name_id(folded_name: Column | str, kind: Column | str) -> Column:
    """``entity_id`` of a name that is folded already."""
    signs = lambda x: F.when(x.contains("*") | x.contains("_") | x.contains('"') | x.contains("'") | x.contains("`"), F.regexp_replace(x, "[*_\"'`]", "")).otherwise(x)
    return stable_id("entity", kind, F.btrim(spaced(let(_col(folded_name), signs)), F.lit(_EDGE_SIGNS)))


def holds_any(text: Column, cues: tuple[str, ...]) -> Column:
    """``contains_any`` of a text that is a column or bound by ``let``: look-ups instead of a pattern."""
    return reduce(lambda a, b: a | b, [text.contains(c) for c in cues])


def slugify(c: Column | str, limit: int = 90, default: str = "untitled") -> Column:
    slug = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, limit), F.lit("")), F.lit(default))


def display_name(c: Column | str) -> Column:
    """For show: blanks collapsed, no double emphasis marks, no punctuation at the ends, accents kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(c), r"\*\*|__", ""), rf"^[{_EDGE}]+|[{_EDGE}]+$", ""))


def short_text(c: Column | str, limit: int = 500) -> Column:
    return F.trim(F.substring(F.regexp_replace(collapse(c), r"\*\*|__", ""), 1, limit))


def heading_key(c: Column | str) -> Column:
    """A heading for comparison: no hashes, no emphasis, blanks collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"^#{1,6}\s+", ""), r"[*_]", ""))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 12 hex digits of the md5 of the parts joined by a colon; null parts as empty."""
    raw = F.concat_ws(":", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(raw), 1, 12))


def entity_id(name: Column | str, kind: Column | str) -> Column:
    return stable_id("entity", kind, fold_name(name))


def relation_id(subject: Column | str, kind: Column | str, object_: Column | str) -> Column:
    return stable_id("relation", subject, kind, object_)


def uuid5(name: Column | str, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """RFC 4122 version 5 UUID of a name, by SHA-1 in the JVM."""
    digest = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(_col(name), "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1).cast("int"))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def point_id(kind: str, key: Column | str) -> Column:
    return uuid5(F.concat(F.lit(f"{kind}::"), _col(key)))


def contains_any(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether the text holds one of the cues; one pattern of literals, so that the text is computed once."""
    return text.rlike("|".join(rf"\Q{c}\E" for c in cues))


def tokens_estimate(c: Column | str) -> Column:
    """Words times one and a half, rounded down."""
    return F.floor(F.size(F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")) * 1.5).cast("int")


def sentences(c: Column | str) -> Column:
    """Split after sentence ends; empty ones drop out."""
    return F.filter(F.transform(F.split(F.trim(_col(c)), r"(?<=[.!?。])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def url_normal(c: Column | str) -> Column:
    """Without query, fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"[?#].*$", ""), "/+$", "")


def url_slug(c: Column | str) -> Column:
    return F.regexp_extract(url_normal(c), r"/([^/]+)$", 1)


def url_host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
