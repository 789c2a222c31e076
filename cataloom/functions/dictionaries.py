"""Dimension tables and word lists.

Lists that results depend on are fixed values. The dictionaries in keywords.txt and brands.txt are the defaults of parameters: a
deployment passes its own tables (category, keyword) and (brand, category) of any size to the classifier.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Categories in order, with label, least and greatest plausible price.
CATEGORIES = [
    ("SMARTPHONE", "Smartphones", 50.0, 500000.0),
    ("LAPTOP", "Laptops", 10000.0, 1500000.0),
    ("TABLET", "Tablets", 3000.0, 300000.0),
    ("DESKTOP", "Desktops & PC", 15000.0, 800000.0),
    ("HEADPHONE", "Headphones & Audio", 200.0, 100000.0),
    ("CAMERA", "Cameras", 3000.0, 800000.0),
    ("SMARTWATCH", "Smartwatches", 500.0, 300000.0),
    ("GAMING", "Gaming", 500.0, 500000.0),
    ("TV", "TVs", 8000.0, 800000.0),
    ("APPLIANCE", "Home Appliances", 1000.0, 500000.0),
    ("AC", "Air Conditioners", 20000.0, 400000.0),
    ("REFRIGERATOR", "Refrigerators", 10000.0, 400000.0),
    ("KITCHEN", "Kitchen", 100.0, 100000.0),
    ("FASHION", "Fashion", 100.0, 200000.0),
    ("BEAUTY", "Beauty & Care", 50.0, 50000.0),
    ("BOOK", "Books", 30.0, 20000.0),
    ("GROCERY", "Groceries", 10.0, 20000.0),
    ("BABY", "Baby & Kids", 50.0, 50000.0),
    ("SPORTS", "Sports & Outdoor", 100.0, 200000.0),
    ("AUTOMOTIVE", "Automotive", 50.0, 5000000.0),
    ("FURNITURE", "Furniture", 500.0, 500000.0),
    ("GENERAL", "General", 1.0, 1.7976931348623157e308),
]

def _listed(name: str) -> dict[str, list[str]]:
    """A file of lines "key: value, value" beside this module, in its order."""
    lines = (Path(__file__).parent / name).read_text(encoding="utf-8").splitlines()
    parts = [line.split(": ", 1) for line in lines if line and not line.startswith("#")]
    return {key: values.split(", ") for key, values in parts}


#: Keywords of each category, and the categories that each brand leans to.
KEYWORDS, BRANDS = _listed("keywords.txt"), _listed("brands.txt")

# Accessories, and words that a match need not hold.
ACCESSORY_WORDS = ["case", "cover", "skin", "sleeve", "pouch", "tempered", "protector", "guard", "holder", "stand", "mount", "tripod", "cable", "adapter", "dock", "strap", "screen", "film", "sticker", "ring", "popsocket", "carrying", "wallpaper"]
STOP_WORDS = ["the", "a", "an", "and", "or", "for", "with", "of", "in", "on", "to", "by", "new", "best", "buy", "shop", "online", "price"]

# Hosts that hold one of these are never shops.
BLOCKED_HOSTS = ["facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "youtu.be", "wikipedia.org", "daraz.com", "google.com", "amazon.com", "alibaba.com", "e-cab.net", "basis.org.bd"]


def category_dim(spark: SparkSession) -> DataFrame:
    """(ordinal, name, label, min_price, max_price)."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CATEGORIES)], "ordinal int, name string, label string, min_price double, max_price double")


def keyword_dim(spark: SparkSession) -> DataFrame:
    """(category, keyword): the default dictionary."""
    return spark.createDataFrame([(c, k) for c, ks in KEYWORDS.items() for k in ks], "category string, keyword string")


def brand_dim(spark: SparkSession) -> DataFrame:
    """(brand, category)."""
    return spark.createDataFrame([(b, c) for b, cs in BRANDS.items() for c in cs], "brand string, category string")
