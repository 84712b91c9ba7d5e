"""Urls as column expressions; lenient, so that any text gives some parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986, appendix B.
URL = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
#: Its beginning: scheme and host.
START = r"^([^:/?#]+:)?(//[^/?#]*)?"
#: Parameters that only track, endings of files that are not pages, hosts of cloud metadata.
TRACKING = r"^(?i:utm_[a-z]+|gclid|fbclid|msclkid|yclid|mc_[a-z]+|ref|source)(=|$)"
FILE_ENDINGS = (
    ".jpg .jpeg .png .gif .webp .avif .svg .ico .bmp .css .js .mjs .json .xml .txt .pdf .zip .rar .gz "
    ".mp4 .mp3 .wav .avi .mov .woff .woff2 .ttf .eot .doc .docx .xls .xlsx .ppt .pptx .dmg .exe .apk"
).split()


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), URL, k)


def url_parts(url: Column) -> Column:
    """Struct of scheme, host (with port), path, query, fragment; empty where there is none."""
    return F.struct(_part(url, 2).alias("scheme"), _part(url, 4).alias("host"), _part(url, 5).alias("path"), _part(url, 7).alias("query"), _part(url, 9).alias("fragment"))


def host_of(url: Column) -> Column:
    return F.lower(_part(url, 4))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def domain_of(url: Column) -> Column:
    return without_www(host_of(url))


def site_label(url: Column) -> Column:
    """What a person calls the site: its host without www, or the text itself where it has none."""
    url = F.coalesce(url, F.lit(""))
    return F.when(host_of(url) != "", domain_of(url)).when(url != "", url).otherwise("unknown")


def origin_of(url: Column) -> Column:
    return F.concat(_part(url, 2), F.lit("://"), _part(url, 4))


def _query(url: Column) -> Column:
    query = _part(url, 7)
    return F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, a path, no fragment; a trailing slash stays."""
    scheme = F.when(_part(url, 2) == "", "https").otherwise(F.lower(_part(url, 2)))
    host = host_of(url)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(_part(url, 5) == "", "/").otherwise(_part(url, 5))
    return F.concat(scheme, F.lit("://"), host, path, _query(url))


def normalise_node(url: Column) -> Column:
    """The spelling of a node of the link graph: no fragment, no trailing slash, port and query stay.

    One match of a pattern for each url, as every edge has two; the rest is cut at fixed characters.
    """
    whole = F.substring_index(F.trim(url), "#", 1)
    base = F.substring_index(whole, "?", 1)
    start = F.regexp_extract(base, START, 0)
    path, query = F.substr(base, F.length(start) + 1), F.substr(whole, F.length(base) + 1)
    path = F.when(path == "", "/").when((F.length(path) > 1) & path.endswith("/"), F.substr(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    return F.concat(F.lower(start), path, F.when(F.length(query) > 1, query).otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """``href`` against ``base``: absolute, //host, /path, ?query, #fragment or relative; dot segments are removed."""
    href = F.trim(href)
    scheme, host, path = _part(base, 2), _part(base, 4), F.when(_part(base, 5) == "", "/").otherwise(_part(base, 5))
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, "[^/]*$", "")
    own_path, tail = _part(href, 5), F.concat(_part(href, 6), _part(href, 8))
    full = F.when(own_path.startswith("/"), own_path).otherwise(F.concat(folder, own_path))
    return (
        F.when(_part(href, 1) != "", href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(own_path == "", F.concat(root, path, F.when(_part(href, 6) != "", _part(href, 6)).otherwise(_part(base, 6)), _part(href, 8)))
        .otherwise(F.concat(root, _no_dots(full), tail))
    )


def _no_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == ".", done).when(p == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(p))),
    )
    last = F.element_at(parts, -1)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))).otherwise(path)


def is_internal(url: Column, origin: Column, subdomains: bool = False) -> Column:
    """Whether both are one site: www doesn't count; with ``subdomains`` nor does any host below."""
    host, own = host_of(url), host_of(origin)
    if not subdomains:
        return without_www(host) == without_www(own)
    return (host == own) | (host == without_www(own)) | host.endswith(F.concat(F.lit("."), without_www(own)))


def strip_tracking(url: Column) -> Column:
    kept = F.array_join(F.filter(F.split(_part(url, 7), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    other = F.concat(_part(url, 1), _part(url, 3), _part(url, 5), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), _part(url, 8))
    return F.when(_part(url, 7) == "", url).otherwise(other)


def is_crawlable(url: Column) -> Column:
    endings = "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS)
    return ~F.lower(_part(url, 5)).rlike(f"(?:{endings})$")


def is_public_target(url: Column) -> Column:
    """http(s), a host, and neither a metadata host nor a literal private, loopback or otherwise reserved address."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@", ""), r":\d*$", "")
    fixed = r"^(localhost|metadata|metadata\.google\.internal|instance-data|.*\.internal|.*\.local(host)?)$"
    v4 = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(22[4-9]|2[34]\d|25[0-5])\."
    literal = host.rlike(r"^\d+(\.\d+){3}$") & host.rlike(v4)
    v6 = host.rlike(r"(?i)^\[(::1?|fe[89ab].*|f[cd].*|ff.*|::ffff:.*|2001:db8.*)\]$")
    return F.coalesce(F.lower(_part(url, 2)).isin("http", "https") & (host != "") & ~host.rlike(fixed) & ~literal & ~v6, F.lit(False))


def seed_of(url: Column) -> Column:
    """The first label of the host, as words."""
    return F.regexp_replace(F.regexp_extract(domain_of(url), r"^([^.:]*)", 1), "[-_]+", " ")
