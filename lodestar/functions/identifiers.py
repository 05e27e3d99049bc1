"""Identifier grammar as Spark expressions.

The patterns end in ``$``, which lets one line feed follow; with ``(?d)`` Java
agrees with that and takes no other line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published identifier format.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
REGISTRY_PREFIXES = ("https://credentialengineregistry.org/resources/", "https://credentialengineregistry.org/graph/")
REGISTRY_HOST = "credentialengineregistry.org"
CHECKED_PREFIXES = ("ceterms:", "ceasn:")
GRAMMAR = "ce- and a UUID v4 in lower case, 39 characters in all"


def is_ctid_strict(v: Column) -> Column:
    return v.rlike(f"(?d)^ce-{UUID}$")


def is_ctid(v: Column) -> Column:
    """The CTID shape in any case."""
    return v.rlike(f"(?d)(?i)^ce-{UUID}$")


def is_bare_uuid(v: Column) -> Column:
    return v.rlike(f"(?d)(?i)^{UUID}$")


def is_lower(v: Column) -> Column:
    return v == F.lower(v)


def is_v4(v: Column) -> Column:
    """Version and variant digits of a value that has the CTID shape."""
    low = F.lower(v)
    return is_ctid(v) & (F.substring(low, 18, 1) == "4") & F.substring(low, 23, 1).isin("8", "9", "a", "b")


def registry_tail(v: Column) -> Column:
    """What follows a registry prefix, or null."""
    tail = F.lit(None).cast("string")
    for p in reversed(REGISTRY_PREFIXES):
        tail = F.when(v.startswith(p), F.substring(v, len(p) + 1, 1 << 30)).otherwise(tail)
    return tail


def looks_like_iri(v: Column) -> Column:
    return v.contains(":")


def is_checked_term(t: Column) -> Column:
    return t.startswith(CHECKED_PREFIXES[0]) | t.startswith(CHECKED_PREFIXES[1])


def vocab_prefix(t: Column) -> Column:
    return F.substring_index(t, ":", 1)


def is_absolute_iri(v: Column) -> Column:
    return v.rlike(r"(?s)^[A-Za-z0-9]+:.+")


def compact_iri(iri: Column, prefixes: dict[str, str]) -> Column:
    """prefix:local by the longest namespace that leaves a local part; other text as it is."""
    out = iri
    for prefix, ns in sorted(prefixes.items(), key=lambda p: len(p[1])):
        fits = iri.startswith(ns) & (F.length(iri) > len(ns))
        out = F.when(fits, F.concat(F.lit(f"{prefix}:"), F.substring(iri, len(ns) + 1, 1 << 30))).otherwise(out)
    return F.when(iri.contains("://"), out).otherwise(iri)


def normalize_term(term: Column, prefixes: dict[str, str]) -> Column:
    """``compact_iri`` after folding schema.org's http form onto https."""
    return compact_iri(F.regexp_replace(term, "^http://schema\\.org/", "https://schema.org/"), prefixes)


def abbreviate(terms: Column, limit: int = 6) -> Column:
    """The first sorted terms and, if there are more, how many there are."""
    ordered = F.sort_array(terms)
    head = F.array_join(F.slice(ordered, 1, limit), ", ")
    return F.when(F.size(ordered) > limit, F.concat(head, F.lit(", ... ("), F.size(ordered).cast("string"), F.lit(" classes total)"))).otherwise(head)


# What may be shown of an identifier; anything else is withheld.
_SOLID = r"[^\s\x1c-\x1f]"  # no white space, as Python tells it
_ANY_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ALLOWED = (
    r"\$([.\[].*)?",
    rf"_:{_SOLID}+",
    _ANY_UUID,
    f"ce-{_ANY_UUID}",
    rf"https?://(www\.)?(credentialengineregistry\.org|credreg\.net)/{_SOLID}*",
    r"[A-Za-z]+:[A-Za-z0-9_.-]+",
    r"@type=\[.*\]",
    r"-",
)


def identifier_only(text: Column) -> Column:
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | text.rlike(f"(?dU)\\A(?:{p})\\z")
    return F.when(allowed, text).otherwise(F.concat(F.lit("<withheld: "), F.length(text).cast("string"), F.lit(" characters>")))


def cache_name(iri: Column) -> Column:
    return F.concat(F.regexp_extract(iri, r"([^/]*)/*$", 1), F.lit(".json"))


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def authority_of(url: Column) -> Column:
    """Host, port and user of a URL; empty where it has none."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def saved_name(url: Column) -> Column:
    """authority__path.html of a URL, at most 180 characters: slashes inside the path as _, no query, ``index`` for no path."""
    path = F.regexp_extract(url, _AUTHORITY + "([^?#]*)", 2)
    slug = F.replace(F.btrim(F.regexp_replace(path, ";[^/]*$", ""), F.lit("/")), F.lit("/"), F.lit("_"))
    return F.substring(F.concat(authority_of(url), F.lit("__"), F.when(slug == "", "index").otherwise(slug), F.lit(".html")), 1, 180)


def is_registry_resource(iri: Column) -> Column:
    """The resources prefix and exactly the registry's authority."""
    return iri.startswith(REGISTRY_PREFIXES[0]) & (F.regexp_extract(iri, r"^https://([^/?#]*)", 1) == REGISTRY_HOST)
