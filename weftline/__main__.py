"""python -m weftline fetch URL | extract URL SELECTOR [text|html|json]: one page on the command line, without Spark."""

from __future__ import annotations

import argparse
import json
import sys

from .kernel import dom
from .kernel.fetching import FetchConfig, fetch


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("fetch")
    f.add_argument("url")
    e = sub.add_parser("extract")
    e.add_argument("url")
    e.add_argument("selector")
    e.add_argument("--output", choices=["text", "html", "json"], default="text")
    a = p.parse_args(args)
    r = fetch(FetchConfig(), a.url)
    if r.error_kind:
        print(f"error: {r.error_kind}", file=sys.stderr)
        return 1
    if a.command == "fetch":
        print(r.body)
        return 0
    found = dom.Page(r.body, r.url).select(a.selector)
    for x in found:
        text, html = dom.tight_text(x), dom.outer_html(x)
        print({"text": text, "html": html, "json": json.dumps({"tag": x.tag, "text": text, "html": html}, indent=2, ensure_ascii=False)}[a.output])
    print(f"{len(found)} elements", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
