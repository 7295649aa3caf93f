"""Text rules: channels, names, scripts, file versions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beatwise.params import CHANNEL_MINUTES, CHANNEL_PATTERNS, SHOP_WORDS

ARABIC = r"[؀-ۿ]"
LATIN = r"[A-Za-z]"


def ascii_edges(pattern: str) -> str:
    """ASCII word edges that mean the same in every Java version."""
    return pattern.replace(r"\bsm\b", r"(?<![a-z0-9_])sm(?![a-z0-9_])")


def classify_channel(raw: Column) -> Column:
    """Channel key of a free-text outlet type: null when blank, ``other`` when no pattern matches."""
    low = F.lower(raw)
    out = F.when(F.coalesce(F.trim(raw), F.lit("")) == "", F.lit(None).cast("string"))
    for key, pattern in CHANNEL_PATTERNS:
        out = out.when(low.rlike(ascii_edges(pattern)), F.lit(key))
    return out.otherwise(F.lit("other"))


def channel_minutes(key: Column) -> Column:
    pairs = [x for k, v in CHANNEL_MINUTES.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def call_minutes(own: Column, channel: Column, fallback: int = 15) -> Column:
    """An outlet's own call minutes, else its channel's, else the fallback."""
    return F.when(own > 0, own.cast("int")).otherwise(
        F.coalesce(channel_minutes(classify_channel(channel)), F.lit(fallback))).cast("int")


def normalise_name(name: Column) -> Column:
    """A name reduced to what identifies a shop.

    Shop words are dropped between ASCII word edges only, so the Arabic ones stay in the name
    (an Arabic letter is no ASCII word character); this keeps groups equal to published ones.
    """
    latin_words = "|".join(w for w in SHOP_WORDS if w.isascii())
    s = F.lower(name)
    s = F.regexp_replace(s, r"[ً-ْـ]", "")
    s = F.translate(s, "إأآةى", "اااهي")
    s = F.regexp_replace(s, rf"(?<![a-z0-9_])(?:{latin_words})(?![a-z0-9_])", " ")
    s = F.regexp_replace(s, r"^ال", "")
    s = F.regexp_replace(s, r"\sال", " ")
    return F.regexp_replace(s, r"[^a-z0-9؀-ۿ]+", "")


def bigrams(s: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(F.length(s) < 2, empty).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: s.substr(i, F.lit(2))))


def normalised_similarity(x: Column, y: Column) -> Column:
    """1 for equal normalised names, 0.8 when the shorter (3 or more) is contained, else bigram Dice."""
    short = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    long_ = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    gx, gy = bigrams(x), bigrams(y)
    count = lambda g, k: F.size(F.filter(g, lambda h: h == k))
    shared = F.aggregate(F.array_distinct(gx), F.lit(0), lambda acc, k: acc + F.least(count(gx, k), count(gy, k)))
    total = F.length(x) + F.length(y) - 2
    return (F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0)
            .when(x == y, 1.0)
            .when((F.length(short) >= 3) & F.contains(long_, short), 0.8)
            .when(total > 0, 2.0 * shared / total)
            .otherwise(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    return normalised_similarity(normalise_name(a), normalise_name(b))


def script_of(name: Column) -> Column:
    ar, la = name.rlike(ARABIC), name.rlike(LATIN)
    return F.when(ar & ~la, "ar").when(la & ~ar, "la").otherwise("mixed")


EDITED = r"(?i)\s*Universe Edited v\.?\s*(\d+)\s*$"


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.(xlsx|xls|csv)$", "")


def file_base(name: Column, default: str = "Outlets") -> Column:
    """The original name behind an upload: no extension, no ``Universe Edited v.N``."""
    base = F.trim(F.regexp_replace(F.trim(_stem(name)), EDITED, ""))
    return F.when(base == "", F.lit(default)).otherwise(base)


def file_version(name: Column) -> Column:
    """The version an edited file carries, 0 for an original."""
    return F.coalesce(F.nullif(F.regexp_extract(_stem(name), EDITED, 1), F.lit("")).cast("int"), F.lit(0))


def edited_file_name(base: Column, version: Column) -> Column:
    safe = F.trim(F.regexp_replace(F.regexp_replace(base, r'[\\/:*?"<>|\r\n]+', " "), r"\s+", " "))
    return F.concat(F.when(safe == "", F.lit("Outlets")).otherwise(safe), F.lit(" Universe Edited v."),
                    version.cast("string"), F.lit(".xlsx"))


def spot_key(name: Column, lat: Column, lng: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(name)), F.format_string("%.5f", lat), F.format_string("%.5f", lng))


def natural_key(name: Column) -> list[Column]:
    """Sort keys that order ``Rep 2`` before ``Rep 10``."""
    return [F.lower(F.regexp_extract(name, r"^(\D*)", 1)),
            F.coalesce(F.nullif(F.regexp_extract(name, r"^\D*(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(-1)),
            name]
