"""Name prefixes as columns: infixes, misread prefix variants, session headers and a prefix-aware distance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.columns import distance

# Leading name infixes.
INFIXES = (
    "van der", "van den", "van de", "van 't", "van het", "van",
    "in 't",
    "ten", "ter", "te",
    "den", "der", "des", "de", "di",
    "thoe", "tot",
    "d'", "l'",
    "le", "la", "du",
    "à",
    "en", "het", "of",
    "'s-", "'s ", "'t ", "t'",
)

# Prefixes and how they are misread.
PREFIX_VARIANTS = {
    "van der": ["vau der", "van den", "vander", "vau den", "ran der", "uan der"],
    "van den": ["vau den", "van der", "vanden", "vau der", "ran den"],
    "van de": ["vau de", "van dc", "vande", "vau dc", "ran de"],
    "van 't": ["van t", "vau t", "van't", "vau't"],
    "van het": ["vau het", "van het"],
    "in 't": ["in t", "in't"],
    "van": ["vau", "ran", "uan", "vn"],
    "ten": ["teu", "len"],
    "ter": ["ler", "tèr"],
    "te": ["le"],
    "den": ["deu"],
    "der": ["dèr"],
    "des": [],
    "de": ["dc", "dé"],
    "di": [],
    "thoe": ["toe", "thoë"],
    "tot": [],
    "du": [],
    "le": [],
    "la": [],
    "d'": ["d"],
    "l'": ["l"],
    "'s-": ["s-", "s "],
    "'s ": ["s "],
    "'t ": ["t "],
    "t'": ["t"],
    "à": ["a"],
    "en": [],
    "het": [],
    "of": [],
}

# Patterns of session headers (days of the week in Latin, the president's line, and formulas).
SESSION_HEADERS = (
    r"^(lunae?|martis|martie|mercurii|mereurii|mercurit|jovis|joris|veneris|sabbathi|dominicae?)\b",
    r"^praeside\b",
    r"\npraesent",
    r"\b[hb][il]?[oea]t\s+eerst",
    r"\b[bp]ataafs",
    r"^is\s+na\s+v[oe]orgaande",
)


def _any_of(words: list[str]) -> str:
    """Alternatives, the longest first so that it wins."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def canonical_prefixes() -> dict[str, str]:
    """Variant -> canonical prefix. A canonical prefix stands for itself unless an earlier one claims it as a variant."""
    out: dict[str, str] = {}
    for name, variants in PREFIX_VARIANTS.items():
        out[name] = name
        for v in variants:
            out.setdefault(v, name)
    return out


def is_session_header(c: Column) -> Column:
    """F-13; false for null."""
    return F.coalesce(c.rlike("(?iU)" + "|".join(SESSION_HEADERS)), F.lit(False))


def strip_infix(c: Column) -> Column:
    """X-04: without one leading infix; no boundary is asked for, so ``de`` also opens ``dekker``."""
    return F.trim(F.regexp_replace(c, f"(?i)^(?:{_any_of(list(INFIXES))})\\s*", ""))


def is_infix_only(c: Column) -> Column:
    """X-19."""
    return F.length(strip_infix(c)) < 2


def prefix_table(spark: SparkSession) -> DataFrame:
    """X-05 and X-11: ``canonical, variant``, each prefix being a variant of itself."""
    rows = [(name, v) for name, variants in PREFIX_VARIANTS.items() for v in dict.fromkeys([name, *variants])]
    return spark.createDataFrame(rows, "canonical string, variant string")


def _prefix() -> str:
    return f"(?i)^({_any_of(list(canonical_prefixes()))})(?:\\s+|$)"


def _canonical(variant: Column) -> Column:
    pairs = [F.lit(x) for kv in canonical_prefixes().items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(variant)], variant)


def strip_prefix(c: Column) -> Column:
    """X-07: struct of the canonical prefix (or empty) and the core."""
    text = F.trim(c)
    found = F.regexp_extract(text, _prefix(), 1)
    return F.struct(F.when(found == "", F.lit("")).otherwise(_canonical(found)).alias("prefix"), F.trim(F.regexp_replace(text, _prefix(), "")).alias("core"))


def normalise_prefix(c: Column) -> Column:
    """X-06: a leading prefix variant becomes its canonical form."""
    parts = strip_prefix(c)
    prefix, core = parts["prefix"], parts["core"]
    return F.when(prefix == "", core).when(core == "", prefix).otherwise(F.concat_ws(" ", prefix, core))


def is_prefix_only(c: Column, least: int = 2) -> Column:
    """X-08: nothing but prefixes and fewer than ``least`` characters."""
    words = _any_of(list(canonical_prefixes()))
    return F.length(F.trim(F.regexp_replace(F.lower(F.trim(c)), f"^(?:(?:{words})(?:\\s+|$))+", ""))) < least


def core(c: Column) -> Column:
    """X-09: normalised, then without its prefix."""
    return strip_prefix(normalise_prefix(c))["core"]


def prefix_distance(a: Column, b: Column) -> Column:
    """X-10: the least of four distances: both whole, both cores, and each core with the other whole."""
    na, nb = normalise_prefix(F.lower(F.trim(a))), normalise_prefix(F.lower(F.trim(b)))
    ca, cb = strip_prefix(na)["core"], strip_prefix(nb)["core"]
    unless_empty = lambda d, *cores: F.when(F.least(*(F.length(x) for x in (*cores, *cores))) == 0, F.lit(1.0)).otherwise(d)
    return F.least(distance(na, nb), unless_empty(distance(ca, cb), ca, cb), unless_empty(distance(ca, nb), ca), unless_empty(distance(na, cb), cb))
