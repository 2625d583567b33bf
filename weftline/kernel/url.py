"""URLs after the public WHATWG standard: parsing, joining, canonical forms, and what is derived from them."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import unquote

DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_TRIM = "".join(map(chr, range(33)))
_FORBIDDEN_HOST = set("\0\t\n\r #/:<>?@[\\]^|%")
_SAFE_COMMON = set(map(chr, range(33, 127)))
_FRAGMENT = _SAFE_COMMON - set('"<>`')
_QUERY = _SAFE_COMMON - set("\"#<>")
_SPECIAL_QUERY = _QUERY - {"'"}
_PATH = _SAFE_COMMON - set('"#<>?`{}^')
_USER = _PATH - set("/:;=@[\\]|")
_C0 = _SAFE_COMMON | {" "}


def _encode(text: str, safe: set[str]) -> str:
    if all(c in safe for c in text):
        return text
    return "".join(c if c in safe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None
    opaque: bool = False

    def __str__(self) -> str:
        out = [self.scheme, ":"]
        if self.host is not None:
            out.append("//")
            if self.user or self.password:
                out += [self.user, f":{self.password}" if self.password else "", "@"]
            out += [self.host, f":{self.port}" if self.port is not None else ""]
        elif not self.opaque and self.path.startswith("//"):
            out.append("/.")
        out.append(self.path)
        if self.query is not None:
            out += ["?", self.query]
        if self.fragment is not None:
            out += ["#", self.fragment]
        return "".join(out)

    @property
    def origin(self) -> str | None:
        """scheme://host, with a port that isn't the scheme's own; None without a host."""
        return f"{self.scheme}://{self.host}{f':{self.port}' if self.port is not None else ''}" if self.host else None


def _ipv4(host: str) -> str | None:
    """The dotted form of a host that ends in a number; None if it doesn't; ValueError if it isn't an address."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    last = parts[-1]
    if not (last.isascii() and last.isdigit()) and not re.fullmatch(r"0[xX][0-9a-fA-F]*", last):
        return None
    if len(parts) > 4:
        raise ValueError(host)
    numbers = []
    for p in parts:
        if re.fullmatch(r"0[xX][0-9a-fA-F]*", p):
            numbers.append(int(p[2:] or "0", 16))
        elif p.isascii() and p.isdigit():
            numbers.append(int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        else:
            raise ValueError(host)
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError(host)
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(text: str, special: bool) -> str:
    if text.startswith("["):
        if not text.endswith("]"):
            raise ValueError(text)
        import ipaddress

        return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]"
    if not special:
        if any(c in _FORBIDDEN_HOST - {"%"} for c in text):
            raise ValueError(text)
        return _encode(text, _C0)
    name = unquote(text, errors="strict") if "%" in text else text
    if not name.isascii():
        name = ".".join(p if p.isascii() else p.encode("idna").decode() for p in re.sub("[。．｡]", ".", name.lower()).split("."))
    name = name.lower()
    if not name or any(c in _FORBIDDEN_HOST or c < "!" or c == "\x7f" for c in name):
        raise ValueError(text)
    return _ipv4(name) or name


def _segments(path: str, base: list[str], special: bool, file: bool) -> str:
    """The path with dot segments resolved; base: the segments that it goes on from."""
    out = list(base)
    parts = re.split(r"[/\\]", path) if special else path.split("/")
    for k, part in enumerate(parts):
        last, low = k == len(parts) - 1, part.lower()
        if low in ("..", ".%2e", "%2e.", "%2e%2e"):
            if out and not (file and len(out) == 1 and re.fullmatch(r"[A-Za-z]:", out[0])):
                out.pop()
            if last:
                out.append("")
        elif low in (".", "%2e"):
            if last:
                out.append("")
        else:
            if file and not out and re.fullmatch(r"[A-Za-z][:|]", part):
                part = part[0] + ":"
            out.append(_encode(part, _PATH))
    return "/" + "/".join(out)


def parse(text: str, base: Url | None = None) -> Url:
    """ValueError if the text isn't a URL, or is a relative one without a base."""
    text = text.strip(_TRIM).translate({9: None, 10: None, 13: None})
    m = _SCHEME.match(text)
    if m:
        scheme, rest = m[1].lower(), text[m.end() :]
        special = scheme in DEFAULT_PORTS
        if special and base is not None and base.scheme == scheme and not re.match(r"[/\\]", rest) and scheme != "file":
            return _relative(rest, base)
        if scheme == "file" and base is not None and base.scheme == "file" and not re.match(r"[/\\]", rest):
            return _relative(rest, base)
        return _absolute(scheme, rest, special)
    if base is None:
        raise ValueError("a relative URL without a base")
    return _relative(text, base)


def _tail(rest: str, special: bool) -> tuple[str, str | None, str | None]:
    rest, hash_, fragment = rest.partition("#")
    path, mark, query = rest.partition("?")
    return path, _encode(query, _SPECIAL_QUERY if special else _QUERY) if mark else None, _encode(fragment, _FRAGMENT | {" "} - {" "}) if hash_ else None


def _absolute(scheme: str, rest: str, special: bool) -> Url:
    path, query, fragment = _tail(rest, special)
    slashes = r"[/\\]" if special else "/"
    if scheme == "file":
        m = re.match(r"[/\\]{2}([^/\\]*)", path)
        host = ""
        if m and not re.fullmatch(r"[A-Za-z][:|]", m[1]):
            host = _host(m[1], True) if m[1] else ""
            host = "" if host == "localhost" else host
            path = path[m.end() :]
        elif m:
            path = path[2:]
        return Url(scheme, host=host, path=_segments(re.sub(r"^[/\\]", "", path), [], True, True), query=query, fragment=fragment)
    if special:
        path = re.sub(rf"^{slashes}*", "", path)
    elif path.startswith("//"):
        path = path[2:]
    elif path.startswith("/"):
        return Url(scheme, path=_segments(path[1:], [], False, False), query=query, fragment=fragment)
    else:
        return Url(scheme, path=_encode(path, _C0), query=query, fragment=fragment, opaque=True)
    m = re.search(slashes, path)
    authority, path = (path[: m.start()], path[m.start() :]) if m else (path, "")
    credentials, at, address = authority.rpartition("@")
    user, _, password = credentials.partition(":")
    port = None
    if m := re.search(r":([^:\]]*)$", address):
        digits, address = m[1], address[: m.start()]
        if digits:
            if not (digits.isascii() and digits.isdigit()) or int(digits) > 65535:
                raise ValueError("a bad port")
            port = int(digits) if int(digits) != DEFAULT_PORTS.get(scheme) else None
    if special and not address:
        raise ValueError("no host")
    host = _host(address, special) if address else ""
    if path or special:
        path = _segments(path[1:], [], special, False)
    return Url(scheme, _encode(user, _USER), _encode(password, _USER), host, port, path, query, fragment)


def _relative(text: str, base: Url) -> Url:
    special = base.scheme in DEFAULT_PORTS
    path, query, fragment = _tail(text, special)
    if base.opaque:
        if text.startswith("#"):
            return replace(base, fragment=fragment)
        raise ValueError("the base can't have relative URLs")
    if re.match(r"[/\\]{2}" if special else "//", path):
        return _absolute(base.scheme, text, special)
    file = base.scheme == "file"
    if not path:
        return replace(base, query=base.query if query is None else query, fragment=fragment)
    if re.match(r"[/\\]" if special else "/", path):
        return replace(base, path=_segments(path[1:], [], special, file), query=query, fragment=fragment)
    return replace(base, path=_segments(path, base.path.split("/")[1:-1], special, file), query=query, fragment=fragment)


@lru_cache(65536)
def parsed(text: str) -> Url | None:
    try:
        return parse(text)
    except ValueError:
        return None


def join(base: str, href: str) -> str:
    """href against base; href unchanged if that isn't a URL."""
    try:
        return str(parse(href, parsed(base)))
    except ValueError:
        return href


def canonicalize(text: str, keep_fragment: bool = False) -> str:
    """Normalised, query segments sorted as they stand, without empty ones or the fragment; what isn't a URL stays."""
    u = parsed(text)
    if u is None:
        return text
    if u.query is not None:
        u = replace(u, query="&".join(sorted((s for s in u.query.split("&") if s), key=lambda s: s.encode())) or None)
    return str(u if keep_fragment else replace(u, fragment=None))


def without_fragment(text: str, keep: bool = False) -> str:
    """Normalised, the query as it stands."""
    u = parsed(text)
    return text if u is None else str(u if keep else replace(u, fragment=None))


def host(text: str) -> str | None:
    u = parsed(text)
    return u.host or None if u else None


def origin(text: str) -> str | None:
    u = parsed(text)
    return u.origin if u else None


def target(text: str) -> str | None:
    """Path and query: what robots patterns are held against."""
    u = parsed(text)
    return None if u is None else u.path + (f"?{u.query}" if u.query is not None else "")


def _is_search_host(name: str | None) -> bool:
    return name is not None and (name == "duckduckgo.com" or name.endswith(".duckduckgo.com"))


def search_target(href: str) -> str:
    """The destination of a DuckDuckGo redirect link; other links stay."""
    u = parsed("https:" + href if href.startswith("//") else href)
    if u is not None and _is_search_host(u.host) and u.path == "/l/":
        for part in (u.query or "").split("&"):
            name, _, value = part.partition("=")
            if name == "uddg":
                return unquote(value.replace("+", " "), errors="replace")
    return href


def search_blocked(status: int, url: str, body: str) -> bool:
    """Whether DuckDuckGo answered with its homepage in place of results."""
    return _is_search_host(host(url)) and (status == 202 or (200 <= status < 300 and "result__a" not in body))
