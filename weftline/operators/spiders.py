"""Ready-made parsers for the crawl loop: rules over links, sitemaps, XML and CSV feeds, shop catalogues."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..kernel import feeds
from ..kernel.dom import Page
from ..kernel.links import LinkRules
from .crawl import CrawlConfig, CrawlResult, Parser, crawl

LOG = logging.getLogger("weftline.spiders")
ParseItem = Callable[[Page, dict], list[object]]


@dataclass(frozen=True)
class CrawlRule:
    """Links that the rules keep become requests of this priority; process may change or drop one."""

    links: LinkRules = LinkRules()
    priority: int = 0
    callback: str | None = None
    process: Callable[[dict, dict], dict | None] | None = field(default=None, compare=False)

    def request(self, url: str, row: dict) -> dict | None:
        r = {"url": url, "priority": self.priority, "callback": self.callback}
        return self.process(r, row) if self.process else r

    def requests(self, page: Page, row: dict) -> list[dict]:
        return [r for u in self.links.extract(page) if (r := self.request(u, row)) is not None]


def follow(rules: list[CrawlRule], page: Page, row: dict) -> list[dict]:
    """All rules apply to each page, one after the other."""
    return [r for rule in rules for r in rule.requests(page, row)]


def dispatch(rules: list[CrawlRule], url: str, row: dict) -> dict | None:
    """The first rule that matches a URL decides; without rules every URL is kept."""
    if not rules:
        return {"url": url}
    rule = next((r for r in rules if r.links.matches(url)), None)
    return rule.request(url, row) if rule else None


def crawl_spider(rules: list[CrawlRule], parse_item: ParseItem | None = None):
    def parse(page: Page, row: dict) -> tuple[list[object], list[object]]:
        return (parse_item(page, row) if parse_item else []), follow(rules, page, row)

    return parse


def sitemap_spider(rules: list[CrawlRule] = [], parse_item: ParseItem | None = None, follow_sitemaps: LinkRules | None = None, alternates: bool = False):
    """robots.txt leads to sitemaps, those to further ones and to pages; other responses are items' pages."""

    def parse(page: Page, row: dict) -> tuple[list[object], list[object]]:
        body = row["body"]
        if feeds.is_robots(page.url):
            return [], [u for s in feeds.robots_sitemaps(body) if (u := feeds.absolute(page.url, s))]
        if not feeds.looks_like_sitemap(body):
            return (parse_item(page, row) if parse_item else []), []
        urls, children = feeds.sitemap(body, alternates)
        if not urls and not children:
            LOG.warning("no entries in the sitemap %s", page.url)
        children = [u for c in children if (u := feeds.absolute(page.url, c)) and (follow_sitemaps is None or follow_sitemaps.matches(u))]
        pages = [r for x in urls if (u := feeds.absolute(page.url, x)) and (r := dispatch(rules, u, row)) is not None]
        return [], [*children, *pages]

    return parse


def xml_feed_spider(iterate: str = "item", parse_node: Callable[[dict, dict], list[object]] | None = None):
    def parse(page: Page, row: dict) -> tuple[list[object], list[object]]:
        found = feeds.xml_items(row["body"], iterate, page.url)
        return ([i for f in found for i in parse_node(f, row)] if parse_node else found), []

    return parse


def csv_feed_spider(delimiter: str = ",", headers: list[str] | None = None, parse_row: Callable[[dict, dict], list[object]] | None = None):
    def parse(page: Page, row: dict) -> tuple[list[object], list[object]]:
        found = feeds.csv_items(row["body"], delimiter, headers)
        return ([i for f in found for i in parse_row(f, row)] if parse_row else found), []

    return parse


def shop_spider(target: str):
    """Items of a store's variants. A variant that several pages show stands for each: see operators.feeds.first_variants."""
    shop = feeds.Shop.of(target)

    def parse(page: Page, row: dict) -> tuple[list[object], list[object]]:
        return shop.parse(page.url, row["body"])

    return parse, [shop.collections_url()]


@dataclass(frozen=True)
class Spider:
    """Start URLs, a parser and settings: all that a crawl takes but its sources."""

    start_urls: tuple[str, ...]
    parser: Parser = field(compare=False)
    config: CrawlConfig = CrawlConfig()

    def run(self, spark: SparkSession, path: str, **sources: object) -> CrawlResult:
        """sources: cache, fetch and robots_docs of crawl()."""
        return crawl(spark, spark.createDataFrame([(u,) for u in self.start_urls], "url string"), self.parser, path, self.config, **sources)


def crawl_template(start_urls: list[str], rules: list[CrawlRule], parse_item: ParseItem | None = None, **settings: object) -> Spider:
    """settings: of CrawlConfig, here and below."""
    return Spider(tuple(start_urls), crawl_spider(rules, parse_item), CrawlConfig(**settings))


def sitemap_template(sitemap_urls: list[str], rules: list[CrawlRule] = [], parse_item: ParseItem | None = None, follow_sitemaps: LinkRules | None = None, alternates: bool = False, **settings: object) -> Spider:
    return Spider(tuple(sitemap_urls), sitemap_spider(rules, parse_item, follow_sitemaps, alternates), CrawlConfig(**settings))


def xml_feed_template(feed_urls: list[str], iterate: str = "item", parse_node: Callable[[dict, dict], list[object]] | None = None, **settings: object) -> Spider:
    return Spider(tuple(feed_urls), xml_feed_spider(iterate, parse_node), CrawlConfig(**settings))


def csv_feed_template(feed_urls: list[str], delimiter: str = ",", headers: list[str] | None = None, parse_row: Callable[[dict, dict], list[object]] | None = None, **settings: object) -> Spider:
    return Spider(tuple(feed_urls), csv_feed_spider(delimiter, headers, parse_row), CrawlConfig(**settings))


def shop_template(target: str, **settings: object) -> Spider:
    parser, urls = shop_spider(target)
    return Spider(tuple(urls), parser, CrawlConfig(**settings))
