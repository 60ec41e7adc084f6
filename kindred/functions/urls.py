"""Web addresses of organisations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import constants as K
from kindred.functions.binding import let

_V4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def is_public_ip(host: Column) -> Column:
    """True for public IPv4 literals and for IPv6 literals outside the local ranges."""

    def public(o: Column) -> Column:
        private = (o[0] == 10) | (o[0] == 127) | (o[0] == 0) | (o[0] >= 224) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168)) | ((o[0] == 169) & (o[1] == 254))
        return F.forall(o, lambda x: x <= 255) & ~private

    v4 = let(F.transform(F.split(host, r"\."), lambda x: x.try_cast("int")), public)
    v6 = host.rlike(r"^\[?[0-9a-f]*:[0-9a-f:.]*\]?$") & ~host.rlike(r"^\[?(::1|::|fe8|fc|fd)")
    return F.when(host.rlike(_V4), F.coalesce(v4, F.lit(False))).otherwise(v6)


def _after_scheme(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"^(?s:.*?)://", "")


def url_domain(url: Column) -> Column:
    """Host in lower case without user, port and leading ``www.``; null where the value names no public domain."""
    u = F.trim(url)
    bad = u == ""
    for p in K.REJECTED_URL_PREFIXES:
        bad = bad | u.startswith(p)
    host = F.lower(F.substring_index(_after_scheme(url), "/", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"[?#:].*$", ""), r"^(www\.)+", "")
    return let(F.when(~bad, host), lambda h: F.when(h.contains(".") & ~is_public_ip(h), h))


def url_slugs(url: Column) -> Column:
    """Non-empty path segments, case kept, without query and fragment."""
    path = F.regexp_extract(_after_scheme(url), r"^[^/]*/((?s:.*))$", 1)
    return let(path, lambda p: F.filter(F.split(F.when(p.contains("?"), F.substring_index(p, "?", 1)).otherwise(F.substring_index(p, "#", 1)), "/"), lambda s: s != ""))


def is_ignored_domain(domain: Column) -> Column:
    """Shared platforms, exactly or as a parent domain: every suffix of the labels is looked up in the list."""
    parents = lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return let(F.split(domain, r"\."), lambda labels: F.arrays_overlap(parents(labels), F.array(*map(F.lit, K.IGNORED_DOMAINS))))


def shared_slugs(a: Column, b: Column) -> Column:
    """How many leading segments agree."""
    hits = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(hits, F.lit(False))
    return F.when(miss == 0, F.size(hits)).otherwise(miss - 1).cast("int")


def slug_prefixes(slugs: Column) -> Column:
    """The first segment, the first two and so on, each as one text; segments have no slash."""
    return F.transform(slugs, lambda _, i: F.array_join(F.slice(slugs, 1, i + 1), "/"))


def shared_prefixes(a: Column, b: Column) -> Column:
    """How many leading segments agree, by their prefixes; compiled, unlike :func:`shared_slugs`, for very many pairs."""
    differ = lambda i: ~F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False))
    return F.when(differ(0), 0).when(differ(1), 1).otherwise(F.size(F.array_intersect(a, b)))


def prefix_confidence(a: Column, b: Column, n: Column) -> Column:
    """:func:`url_confidence` of slug lists by their prefixes, of which ``n`` are shared."""
    return F.when((F.size(a) == n) & (F.size(b) == n), K.URL_FULL_CONFIDENCE).otherwise(segment_confidence(n))


def segment_confidence(n: Column) -> Column:
    tier = F.when(n == 0, K.URL_SLUG_CONFIDENCE[0])
    for i, c in enumerate(K.URL_SLUG_CONFIDENCE[1:-1], 1):
        tier = tier.when(n == i, c)
    return tier.otherwise(K.URL_SLUG_CONFIDENCE[-1])


def url_confidence(a: Column, b: Column, n: Column | None = None) -> Column:
    """Confidence of two slug lists under one domain; ``n`` is what they share, if it is known."""
    n = shared_slugs(a, b) if n is None else n
    return F.when(a == b, K.URL_FULL_CONFIDENCE).otherwise(segment_confidence(n))


def bare_domain(url: Column) -> Column:
    """Lower case without scheme, ``www.`` and path: what two records' urls are compared by as a feature."""
    return F.lower(F.regexp_replace(url, r"^https?://(www\.)?|/.*$", ""))


def host_of(url: Column) -> Column:
    """Host by the standard parser, without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
