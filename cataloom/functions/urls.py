"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cataloom.functions.dictionaries import BLOCKED_HOSTS

# Paths and queries of products, of categories and of neither.
SITEMAP_PRODUCT = r"(?i)/(product|products|p|item|sku)/[^/?#]+"
SITEMAP_OTHER = r"(?i)/(category|categories|tag|tags|brand|brands|page|blog|news|author|wp-content|wp-includes|wp-admin|feed|comment|search|shop/page/|product-category|product_tag|attachment)/"
LINK_PRODUCT = r"(?i)/(product|products|p|item|sku|book|catalog/product)/[^/?#]+"
LINK_PRODUCT_QUERY = "(?i)route=product/product"
LINK_CATEGORY = r"(?i)/(category|categories|cat|c|shop|brand|brands|department|collection|collections)/[^/?#]+"
LINK_CATEGORY_QUERY = "(?i)route=product/category"
LINK_LONG_SLUG = r"(?i)^/[a-z0-9][a-z0-9-]{19,}$"
LINK_JUNK = r"(?i)/(login|register|cart|checkout|account|wishlist|track|order|wp-admin|wp-content|wp-includes|wp-json|feed|comments?|tag/|tags/|author/|page/[0-9]|blog/|news/|press/|about|contact|privacy|terms|policy|help|faq|support|sale\.php|search|return|refund|career)/?"


def raw_path(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def raw_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host_of(url: Column) -> Column:
    """Host in lower case without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(host, F.lit(""))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def canonical(url: Column) -> Column:
    """Without one trailing slash."""
    return F.regexp_replace(url, "/$", "")


def is_sitemap_product(url: Column) -> Column:
    """Whether a sitemap's URL is a product page's: http(s), a product path and no other one. Paths are tested decoded."""
    path = F.coalesce(F.try_url_decode(raw_path(url)), raw_path(url))
    return F.coalesce(url.rlike("(?i)^https?://") & path.rlike(SITEMAP_PRODUCT) & ~path.rlike(SITEMAP_OTHER), F.lit(False))


def link_class(url: Column) -> Column:
    """product, category or drop, for a link found on a page."""
    path, query = raw_path(url), raw_query(url)
    hyphens = F.length(path) - F.length(F.replace(path, F.lit("-"), F.lit("")))
    return (
        F.when(path.rlike(LINK_JUNK), "drop")
        .when(path.rlike(LINK_PRODUCT) | query.rlike(LINK_PRODUCT_QUERY), "product")
        .when(path.rlike(LINK_CATEGORY) | query.rlike(LINK_CATEGORY_QUERY), "category")
        .when(path.rlike(LINK_LONG_SLUG) & (hyphens >= 4), "product")
        .otherwise("drop")
    )


def same_shop(host: Column, shop_host: Column) -> Column:
    """Whether a link's host ends with the shop's, www aside."""
    return host.endswith(strip_www(shop_host))


def is_blocked(host: Column) -> Column:
    return F.exists(F.array(*map(F.lit, BLOCKED_HOSTS)), lambda b: F.contains(host, b))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """First entry of X-Forwarded-For, else the remote address."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), remote)
