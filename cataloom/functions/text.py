"""Text expressions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cataloom.functions.dictionaries import STOP_WORDS


def normalise_query(x: Column) -> Column:
    """Search form: lower case, everything but letters, digits and white space to a space, single spaces."""
    plain = F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def query_tokens(normalised: Column) -> Column:
    """Tokens of two characters or more, repeats kept."""
    return F.filter(F.split(normalised, r"\s+"), lambda t: F.length(t) >= 2)


def stem(word: Column) -> Column:
    """A word of Latin letters without a plural or verb ending: s, es after a hissing sound, ies to y, ing and ed after three letters."""
    w = word
    w = F.when(w.rlike("[a-z]{2}ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("[a-z]{2}[^su]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.when(w.rlike("[a-z]{3}ing$"), F.regexp_replace(w, "ing$", "")).when(w.rlike("[a-z]{3}ed$"), F.regexp_replace(w, "ed$", "")).otherwise(w)


def token_coverage(name: Column, tokens: Column) -> Column:
    """Share of the tokens that the name holds as substrings; 0 without tokens."""
    low = F.lower(name)
    hits = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    return F.when(F.size(tokens) > 0, hits.cast("double") / F.size(tokens)).otherwise(0.0)


def has_all_tokens(name: Column, tokens: Column) -> Column:
    """Whether the name holds every token, in any order."""
    low = F.lower(name)
    return F.forall(tokens, lambda t: F.contains(low, t))


def cache_key(query: Column) -> Column:
    """Key of a cached search: trimmed, single spaces, lower case; null under two characters."""
    key = F.lower(F.regexp_replace(F.trim(query), r"\s+", " "))
    return F.when(F.length(key) >= 2, key)


def shingle_form(x: Column) -> Column:
    """Matching form: lower case, runs of all but letters and digits to one space."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def shingles(form: Column, k: int) -> Column:
    """Set of k-character shingles; a shorter text is its own shingle, an empty one has none."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(form) - (k - 1), F.lit(1))), lambda i: F.substr(form, i, F.lit(k)))
    return F.when(F.length(form) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(cut))


def trigrams(x: Column) -> Column:
    """Set of trigrams of the text padded with a space on both sides."""
    return shingles(F.concat(F.lit(" "), x, F.lit(" ")), 3)


def word_set(x: Column) -> Column:
    """Set of words of two letters or digits or more."""
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


def significant(words: Column) -> Column:
    """Words of three characters or more that are no stop words."""
    return F.array_except(F.filter(words, lambda t: F.length(t) >= 3), F.array(*map(F.lit, STOP_WORDS)))


def contains_word(text: Column, word: Column) -> Column:
    """Whether the text holds the word between characters that are no letters or digits."""
    return F.array_contains(F.split(F.lower(text), "[^a-z0-9]+"), F.lower(word))


def slug(x: Column) -> Column:
    """URL slug: letters, digits and single dashes, one dash stripped at each end."""
    kept = F.regexp_replace(F.lower(x), r"[^a-z0-9\s-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


# What a name is freed of before names are matched, in order.
MATCH_PATTERNS = [
    r"\([^)]*\)",
    r"\[[^\]]*\]",
    r"\b(with|w/?)\s+(retractable\s+)?(usb[- ]?c\s+)?cable\b",
    r"\bwith\s+charging\s+case\b",
    r"\b(price|in)\s+bangladesh\b",
    r"\b\d+\s*[/\\]\s*\d+\s*(gb|tb|mb)\b",
    r"\b\d{2,4}\s*(gb|tb)\b",
    r"\b\d{1,2}\s*gb\b",
    r"\b(titanium|black|white|silver|gold|blue|red|green|graphite|onyx|natural|desert|midnight)\b",
]


def match_key(name: Column) -> Column:
    """The name without variants, colours and marketing; the lower-cased name if nothing is left, empty for null."""
    form = F.lower(name)
    for pattern in MATCH_PATTERNS:
        form = F.regexp_replace(form, pattern, " ")
    form = F.trim(F.regexp_replace(F.regexp_replace(form, r"[^a-z0-9\s]", " "), r"\s+", " "))
    return F.coalesce(F.when(form == "", F.lower(name)).otherwise(form), F.lit(""))


def xml_escape(x: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(raw), F.lit(escaped))
    return x


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def string_list(x: Column) -> Column:
    """A comma-separated cell as an array without blanks."""
    return F.filter(F.split(F.trim(x), r"\s*,\s*"), lambda t: F.length(t) > 0)


def capped(x: Column, most: int) -> Column:
    """Trimmed and cut to a number of characters."""
    return F.substr(F.trim(x), F.lit(1), F.lit(most))


def better_name(old: Column, new: Column) -> Column:
    """The longer name if it has 200 characters at most."""
    longer = new.isNotNull() & (old.isNull() | (F.length(old) < F.length(new))) & (F.length(new) <= 200)
    return F.when(longer, new).otherwise(old)


def ip_hash(ip: Column) -> Column:
    """First 16 hex digits of SHA-256; blank is null."""
    return F.left(F.sha2(blank_to_null(ip), 256), F.lit(16))


def string_hash(ascii_text: Column) -> Column:
    """31-polynomial hash of ASCII text as an unsigned 32-bit number."""
    return F.aggregate(F.split(ascii_text, ""), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % 4294967296)
