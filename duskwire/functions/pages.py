"""HTML and URL expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import bind, ranked


def strip_html(html: Column) -> Column:
    """Visible text: no script or style bodies, tags as spaces, single spaces."""

    def replaced(value: Column, mark: str, pattern: str, by: str) -> Column:
        return bind(value, lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, F.lit(pattern), F.lit(by))).otherwise(t))

    out = replaced(html, "<script", r"(?s)<script[^>]*>.*?</script>", "")
    out = replaced(out, "<style", r"(?s)<style[^>]*>.*?</style>", "")
    out = replaced(out, "<", r"<[^>]+>", " ")
    # single blanks, nearly all there are, stay as they are
    out = F.regexp_replace(out, F.lit(f" {fixed.SPACE}+|(?! ){fixed.SPACE}+"), F.lit(" "))
    return F.trim(out)


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)
    return F.nullif(F.btrim(found, F.lit(" \t\r\n")), F.lit(""))


def generator(html: Column) -> Column:
    pattern = f"(?i){fixed.META_GENERATOR}"
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def framework(html: Column) -> Column:
    def cascade(low: Column) -> Column:
        return (
            F.when(F.contains(html, F.lit("wp-content")) | F.contains(low, F.lit("wordpress")), "wordpress")
            .when(F.contains(low, F.lit("drupal")), "drupal")
            .when(F.contains(low, F.lit("joomla")), "joomla")
            .when(F.contains(html, F.lit("__next")), "nextjs")
            .when(F.contains(low, F.lit("flask")) | F.contains(low, F.lit("werkzeug")), "flask")
        )

    return bind(F.lower(html), cascade)


URL_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PARTS, 1))


def host(url: Column) -> Column:
    """Lower-case host without user part and port, empty if there is none."""
    authority = F.regexp_extract(url, URL_PARTS, 2)
    no_user = F.regexp_replace(authority, F.lit(r"^.*@"), F.lit(""))
    return F.lower(F.regexp_replace(no_user, F.lit(r":\d*$"), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 3)


def normalize_url(url: Column) -> Column:
    """scheme://host/path without a trailing slash, without query and fragment."""
    trimmed = F.rtrim(path(url), F.lit("/"))
    return F.concat(
        scheme(url), F.lit("://"), host(url), F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
    )


def _dot_segments(p: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path that starts with a slash."""
    parts = F.split(p, "/", -1)
    last_is_dots = F.element_at(parts, -1).isin(".", "..")
    walked = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    joined = F.concat(F.lit("/"), F.array_join(walked, "/"))
    slash = last_is_dots & ~F.endswith(joined, F.lit("/"))
    return F.when(slash, F.concat(joined, F.lit("/"))).otherwise(joined)


def join_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base``, without query and fragment."""
    href_scheme = scheme(href)
    href_path = path(href)
    base_dir = F.regexp_replace(path(base), F.lit(r"[^/]*$"), F.lit(""))
    merged = F.when(F.startswith(href_path, F.lit("/")), href_path).otherwise(
        F.concat(F.when(base_dir == "", F.lit("/")).otherwise(base_dir), href_path)
    )
    clean = F.when(F.contains(merged, F.lit("/.")), _dot_segments(merged)).otherwise(merged)
    return (
        F.when(
            href_scheme != "",
            F.concat(href_scheme, F.lit("://"), host(href), href_path),
        )
        .when(
            F.startswith(href, F.lit("//")),
            F.concat(scheme(base), F.lit("://"), host(href), href_path),
        )
        .when(href_path == "", F.concat(scheme(base), F.lit("://"), host(base), path(base)))
        .otherwise(F.concat(scheme(base), F.lit("://"), host(base), clean))
    )


def links(html: Column, base: Column, host_suffix: str = ".onion", limit: int | None = None) -> Column:
    """Distinct resolved links whose host ends with ``host_suffix``, sorted; the first ``limit`` if given."""
    hrefs = F.regexp_extract_all(html, F.lit(f"(?i){fixed.HREF}"), F.lit(1))
    full = F.transform(hrefs, lambda h: join_url(base, h))
    kept = F.filter(full, lambda u: F.endswith(host(u), F.lit(host_suffix)))
    # one trailing slash is dropped
    clean = F.transform(kept, lambda u: F.regexp_replace(u, F.lit("/$"), F.lit("")))
    return ranked(clean, limit)


def allowed_target(url: Column) -> Column:
    """False for URLs without host or with a private or internal one; onion hosts pass."""

    def decide(h: Column) -> Column:
        octets = F.transform(F.split(h, r"\."), lambda o: o.try_cast("int"))
        is_ip = h.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")

        def private(o: Column) -> Column:
            a, b, c = F.get(o, F.lit(0)), F.get(o, F.lit(1)), F.get(o, F.lit(2))
            return (
                a.isin(0, 10, 127)
                | (a >= 240)
                | ((a == 169) & (b == 254))
                | ((a == 172) & b.between(16, 31))
                | ((a == 192) & (b == 168))
                | ((a == 192) & (b == 0) & c.isin(0, 2))
                | ((a == 198) & b.isin(18, 19))
                | ((a == 198) & (b == 51) & (c == 100))
                | ((a == 203) & (b == 0) & (c == 113))
            )

        internal = F.lit(False)
        for prefix in fixed.INTERNAL_HOST_PREFIXES:
            internal = internal | F.startswith(h, F.lit(prefix))
        return (
            F.when(h == "", False)
            .when(F.endswith(h, F.lit(".onion")), True)
            .when(is_ip, ~bind(octets, private))
            .otherwise(~internal)
        )

    return bind(F.coalesce(host(url), F.lit("")), decide)


def header_fingerprint(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: k.isin(fixed.FINGERPRINT_HEADERS) & (v != ""))


def clock_skew(date_header: Column, observed_at: Column) -> Column:
    """Server clock minus observation time in seconds, three decimals, NULL if unparsable."""
    parsed = F.try_to_timestamp(
        F.regexp_replace(date_header, F.lit(r"^[A-Za-z]{3}, | GMT$"), F.lit("")), F.lit("dd MMM yyyy HH:mm:ss")
    )
    micros = F.unix_micros(parsed) - F.unix_micros(observed_at)
    return F.bround(micros / F.lit(1_000_000.0), 3)
