"""Link extraction: which URLs of a page are kept, in document order and once each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from . import url as U
from .css import compile_query
from .dom import WHITE, Page
from .html import ATTR, RAW, RCDATA, attributes

SCHEMES = frozenset({"http", "https", "file"})
#: Extensions dropped unless told otherwise, by kind.
IGNORED_EXTENSIONS = frozenset(
    " ".join(
        [
            "apk bin css dmg exe hta iso jar js pdf rss sh",
            "bat cpl msi msp py rb",
            "doc docb docm docx dotm dotx odg odp ods odt",
            "potm potx pps ppt pptm pptx xls xlsm xlsx xltm xltx",
            "3gp asf asx avi flv m4a m4v mov mp4 mpg qt rm swf webm wmv",
            "aac aiff au mid mp3 ogg ra wav wma",
            "ai bmp cdr drw dxf eps gif ico jpeg jpg mng pct png ps psp pst svg tif tiff webp",
            "7z 7zip bz2 rar tar tar.gz xz zip",
        ]
    ).split()
)


def extension_chains(url: str) -> list[str]:
    """All extensions of the last path segment, longest first: a.tar.gz has tar.gz and gz."""
    u = U.parsed(url)
    path = u.path if u else re.split(r"[?#]", url, maxsplit=1)[0]
    parts = path.rsplit("/", 1)[-1].lower().split(".")
    return [".".join(parts[i:]) for i in range(1, len(parts)) if parts[i]]


def _domains(names: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(n.lower() for n in names)


#: Where one of these stands, the tree decides what and where the links are.
_TREE = re.compile(r"(?i)<(?:table|select|svg|math|template|frameset|plaintext)")
#: Comments, raw text and tags, one after the other; groups: a raw text's element, name and attributes of a start tag, what is an odd tag.
_TAGS = re.compile(rf"<!--(?s:.*?)(?:--!?>|\Z)|(?i:<(?P<raw>{'|'.join(sorted(RAW | RCDATA))})(?=[\s/>])(?:[\s/]*+{ATTR})*+[\s/]*+>(?s:.*?)(?:</(?P=raw)(?=[\s/>])[^>]*+>?|\Z))|<([A-Za-z][^\s/>]*+)((?:[\s/]*+{ATTR})*+)[\s/]*+>|</[A-Za-z][^>]*+>|<[!?/][^>]*+>?|(<[A-Za-z])")


@dataclass(frozen=True)
class LinkRules:
    """Patterns are searched anywhere in the URL; a bad pattern is an error here. Domains match themselves and their subdomains; deny goes before allow."""

    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    deny_domains: tuple[str, ...] = ()
    restrict_css: tuple[str, ...] = ()
    tags: tuple[str, ...] = ("a", "area")
    attrs: tuple[str, ...] = ("href",)
    canonicalize: bool = True
    strip: bool = True
    keep_fragment: bool = False
    deny_extensions: frozenset[str] = IGNORED_EXTENSIONS
    process: Callable[[str], str | None] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        for p in (*self.allow, *self.deny):
            re.compile(p)

    def passes(self, url: str) -> bool:
        if url.split("://", 1)[0] not in SCHEMES:
            return False
        if self.deny_extensions and any(e in self.deny_extensions for e in extension_chains(url)):
            return False
        if self.allow and not any(re.search(p, url) for p in self.allow):
            return False
        if any(re.search(p, url) for p in self.deny):
            return False
        if self.allow_domains or self.deny_domains:
            host = U.host(url) or ""
            under = lambda names: any(host == d or host.endswith("." + d) for d in _domains(names))
            return (not self.allow_domains or under(self.allow_domains)) and not under(self.deny_domains)
        return True

    def matches(self, url: str) -> bool:
        """Whether a single URL would be kept."""
        return self.passes(U.canonicalize(url, self.keep_fragment) if self.canonicalize else url)

    def extract(self, page: Page) -> list[str]:
        """The kept URLs of a page in document order, each once."""
        scopes = [s for css in self.restrict_css for s in page.select(css)] if self.restrict_css else [None]
        query = compile_query(", ".join(self.tags))
        return self._kept((node.attrs for scope in scopes for node in page.select(query, scope)), page.url)

    def extract_text(self, html: str | None, url: str = "") -> list[str]:
        """The same of a page's text; without restrict_css no tree is built where the tags alone tell."""
        html = html or ""
        if not self.restrict_css and set(self.tags) <= {"a", "area"} and not _TREE.search(html):
            if "\r" in html:
                html = html.replace("\r\n", "\n").replace("\r", "\n")
            found = _TAGS.findall(html)
            if not any(odd for *_, odd in found):
                return self._kept((attributes(attrs) for _, name, attrs, _ in found if name and name.lower() in self.tags), url)
        return self.extract(Page(html, url))

    def _kept(self, found: Iterable[dict[str, str]], url: str) -> list[str]:
        base = U.parsed(url)
        out: dict[str, None] = {}
        for attrs in found:
            for attr in self.attrs:
                href = attrs.get(attr)
                if href is None:
                    continue
                if self.strip:
                    href = href.strip(WHITE)
                    if not href:
                        continue
                if base is not None:
                    try:
                        href = str(U.parse(href, base))
                    except ValueError:
                        continue
                if self.process is not None:
                    href = self.process(href)
                    if href is None:
                        continue
                if self.canonicalize:
                    href = U.canonicalize(href, self.keep_fragment)
                if self.passes(href):
                    out.setdefault(href)
        return list(out)
