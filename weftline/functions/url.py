"""URL functions of columns: the parts by one Arrow UDF, and what follows from them by built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel import url as U
from .arrow import batched

PARTS = "struct<scheme: string, host: string, port: int, path: string, query: string, fragment: string, origin: string, target: string>"


def _parts(text: str | None) -> dict | None:
    u = U.parsed(text) if text is not None else None
    if u is None:
        return None
    return {"scheme": u.scheme, "host": u.host or None, "port": u.port, "path": u.path, "query": u.query, "fragment": u.fragment, "origin": u.origin, "target": u.path + (f"?{u.query}" if u.query is not None else "")}


_parsed = batched(_parts, PARTS)
_join = batched(lambda base, href: None if href is None else U.join(base or "", href), "string")
_canonical = {keep: batched(lambda t, keep=keep: None if t is None else U.canonicalize(t, keep), "string") for keep in (False, True)}
_normal = {keep: batched(lambda t, keep=keep: None if t is None else U.without_fragment(t, keep), "string") for keep in (False, True)}
#: URLs whose parts stand as they are: lower-case ASCII hosts without a port, and paths, queries and fragments without anything to encode or resolve.
PLAIN = r"^(https?)://((?:[a-z0-9-]+\.)*[a-z][a-z0-9-]*)((?:/(?!\.|%2[eE])[!$-.0-;=@-\[\]_a-z|~]*)+)(?:\?([!$-&(-;=?-~]*))?(?:#([!#-;=?-_a-~]*))?\z"


def _plain(c: Column) -> Column:
    return F.coalesce(c.rlike(PLAIN), F.lit(False))


def _else(plain: Column, fast: Column, slow: Callable[[Column], Column], c: Column) -> Column:
    """fast for plain URLs, in the JVM; the others alone go through a Python UDF."""
    return F.when(plain, fast).otherwise(slow(F.when(~plain, c)))


def _part(c: Column, k: int, mark: str = "") -> Column:
    found = F.regexp_extract(c, PLAIN, k)
    return F.when(F.regexp_extract(c, "^[^#]*", 0).contains("?") if mark == "?" else c.contains("#"), found) if mark else found


def url_parts(c: Column) -> Column:
    """The parts of a URL; null if it isn't one."""
    query = _part(c, 4, "?")
    parts = {"scheme": _part(c, 1), "host": _part(c, 2), "port": F.lit(None).cast("int"), "path": _part(c, 3), "query": query, "fragment": _part(c, 5, "#"), "origin": F.regexp_extract(c, "^https?://[^/]*", 0), "target": F.concat(_part(c, 3), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))}
    return _else(_plain(c), F.struct(*(v.alias(k) for k, v in parts.items())), _parsed, c)


#: The destination of a search engine's redirect link.
search_target = batched(lambda t: None if t is None else U.search_target(t), "string")


def url_join(base: Column, href: Column) -> Column:
    return _join(base, href)


def canonicalize(c: Column, keep_fragment: bool = False) -> Column:
    """Normalised, the query's segments sorted, without empty ones; without the fragment, unless it is kept."""
    segments = F.array_join(F.array_sort(F.filter(F.split(_part(c, 4), "&"), lambda x: x != "")), "&")
    fast = F.concat(F.regexp_extract(c, "^[^?#]*", 0), F.when(segments != "", F.concat(F.lit("?"), segments)).otherwise(""), F.regexp_extract(c, "(?s)#.*", 0) if keep_fragment else F.lit(""))
    return _else(_plain(c), fast, _canonical[keep_fragment], c)


def normalize(c: Column, keep_fragment: bool = False) -> Column:
    """Normalised, the query as it stands."""
    return _else(_plain(c), c if keep_fragment else F.regexp_extract(c, "^[^#]*", 0), _normal[keep_fragment], c)


def host(c: Column) -> Column:
    return _else(_plain(c), _part(c, 2), lambda x: _parsed(x)["host"], c)


def origin(c: Column) -> Column:
    return _else(_plain(c), F.regexp_extract(c, "^https?://[^/]*", 0), lambda x: _parsed(x)["origin"], c)


def _pairs(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.coalesce(m[k], F.lit("")))), "")


def fingerprint(url: Column, method: Column | str = "GET", session: Column | str = "", body: Column | None = None, headers: Column | None = None, meta: Column | None = None, keep_fragment: bool = False) -> Column:
    """SHA-256 of what makes a request the same as another; headers and meta (maps of strings) count if given."""
    text = lambda c: F.lit(c) if isinstance(c, str) else F.coalesce(c, F.lit(""))
    parts = [text(session), text(method), normalize(url, keep_fragment)]
    parts += [F.coalesce(body, F.lit(""))] if body is not None else []
    parts += [F.coalesce(_pairs(m), F.lit("")) for m in (headers, meta) if m is not None]
    return F.sha2(F.concat(*parts), 256)


def storage_key(identifier: Column) -> Column:
    """SHA-256 and length in bytes of an element's identifier."""
    return F.concat(F.sha2(identifier, 256), F.lit("_"), F.octet_length(identifier).cast("string"))


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; it may be a Python UDF's, which body's lambdas couldn't hold."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chains(path: Column) -> Column:
    parts = F.split(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.")
    at = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: (i < F.size(parts)) & (F.get(parts, i) != ""))
    return F.transform(at, lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))


def extension_chains(path: Column) -> Column:
    """Extensions of a path's last segment, longest first."""
    return let(path, _chains)


def under_domain(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d.lower()) | host.endswith("." + d.lower())
    return F.coalesce(out, F.lit(False))


def passes(url: Column, rules) -> Column:
    """kernel.links.LinkRules.passes as a column expression: one parse of the URL, the rest in the JVM."""
    parts = url_parts(url)
    keep = F.regexp_extract(url, "^(.*?)(?:://.*)?$", 1).isin("http", "https", "file")
    if rules.deny_extensions:
        path = F.coalesce(parts["path"], F.regexp_extract(url, "^[^?#]*", 0))
        keep = keep & ~F.arrays_overlap(extension_chains(path), F.array(*map(F.lit, sorted(rules.deny_extensions))))
    if rules.allow:
        keep = keep & F.rlike(url, F.lit("|".join(f"(?:{p})" for p in rules.allow)))
    if rules.deny:
        keep = keep & ~F.rlike(url, F.lit("|".join(f"(?:{p})" for p in rules.deny)))
    if rules.allow_domains:
        keep = keep & under_domain(parts["host"], rules.allow_domains)
    if rules.deny_domains:
        keep = keep & ~under_domain(parts["host"], rules.deny_domains)
    return F.coalesce(keep, F.lit(False))


_AGENT_SUM = batched(lambda t: None if t is None else sum(t.encode()), "long")


def user_agent(url: Column) -> Column:
    """The pool's user agent that a URL gets."""
    from ..kernel.fetching import USER_AGENTS

    return F.get(F.array(*map(F.lit, USER_AGENTS)), F.pmod(_AGENT_SUM(url), F.lit(len(USER_AGENTS))).cast("int"))


def proxy(row: Column, proxies: list[str]) -> Column:
    """Round robin by a row's number from 0."""
    return F.get(F.array(*map(F.lit, proxies)), F.pmod(row, F.lit(len(proxies))).cast("int"))


def decode_body(body: Column, content_type: Column, limit: int | None = None) -> Column:
    """Response bytes as text: unzipped, and read by byte-order mark or charset."""
    from ..kernel.fetching import decode

    return batched(lambda b, t: None if b is None else decode(b, t, limit), "string")(body, content_type)


def gunzip(body: Column, limit: int | None = None) -> Column:
    """The bytes of all gzip members; null if there are none, or more than limit."""
    from ..kernel.fetching import gunzip as whole

    return batched(lambda b: None if b is None else whole(b, limit), "binary")(body)


def request_headers(url: Column, config: object = None) -> Column:
    """The headers, as a map, that a request for the URL would have."""
    from ..kernel.fetching import FetchConfig, build_headers

    settings = config or FetchConfig()
    return batched(lambda u: None if u is None else list(build_headers(settings, u).items()), "map<string,string>")(url)


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def is_blocked(status: Column) -> Column:
    from ..kernel.fetching import BLOCKED

    return F.coalesce(status.isin(*sorted(BLOCKED)), F.lit(False))


def search_blocked(status: Column, url: Column, body: Column) -> Column:
    """Whether a search engine answered with its homepage in place of results."""
    name = host(url)
    return F.coalesce(((name == "duckduckgo.com") | name.endswith(".duckduckgo.com")) & ((status == 202) | (is_success(status) & ~F.coalesce(body, F.lit("")).contains("result__a"))), F.lit(False))


def is_robots(url: Column) -> Column:
    """Whether a URL is that of a robots.txt."""
    return F.coalesce(url_parts(url)["path"].endswith("/robots.txt"), F.lit(False))


def charset(content_type: Column) -> Column:
    return F.nullif(F.regexp_extract(content_type, r"""(?i)(?:^|;)\s*charset\s*=\s*["']?([\w-]+)""", 1), F.lit(""))


def looks_like_sitemap(body: Column) -> Column:
    return body.rlike(r"(?is)^\ufeff*\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:urlset|sitemapindex)")
