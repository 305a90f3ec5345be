"""Column expressions: cleaning, ids, distances, dates, splits and n-grams. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing id.
NULL_IDS = ("nan", "none", "<na>", "", "nat")
#: Ids of occurrences that nobody has been assigned to.
SENTINELS = ("-1", "-20")


def clean_strings(df: DataFrame) -> DataFrame:
    """F-01: drop spreadsheet escapes and outer white space in every string column; nulls stay."""
    fields = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.col(c), "_x000[dD]_", " "), "[\\r\\n\\t ]+", " "))
    return df.withColumns({c: clean(c) for c in fields})


def trim_column_names(df: DataFrame) -> DataFrame:
    """S-IO4."""
    return df.toDF(*[c.strip() for c in df.columns])


def canonical_id(c: Column) -> Column:
    """F-02: null is empty, outer space goes, and ``.0`` after digits goes."""
    return F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"^(\d+)\.0$", "$1")


def is_null_id(c: Column) -> Column:
    """F-05: null, or a text that stands for it."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*NULL_IDS)


def is_blank(c: Column) -> Column:
    """F-23: null, empty, ``nan`` or ``None``."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin("", "nan", "none")


def nullif_blank(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def as_int(c: Column) -> Column:
    """A year or count from any type; what isn't a number becomes null."""
    return c.cast("string").try_cast("double").try_cast("int")


def distance(a: Column, b: Column) -> Column:
    """X-01: Levenshtein distance over the longer length, 0 for two empties; null if either is null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def overlap_distance(a: Column, b: Column) -> Column:
    """X-02: share of places whose characters differ, the longer text deciding."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != "")), F.lit(0), lambda s, v: s + F.coalesce(v.cast("int"), F.lit(0)))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - same / longest)


def normalise(c: Column) -> Column:
    """X-03: trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def split_points(c: Column) -> Column:
    """X-12: places of spaces and all of the middle 30 to 70 per cent; none under four characters."""
    n = F.length(c)
    low, high = F.greatest(F.lit(2), F.floor(n * 0.3)).cast("int"), F.least(n - 2, F.floor(n * 0.7)).cast("int")
    spaces = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i + 1, F.lit(1)) == " ")
    middle = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.when(n < 4, F.array().cast("array<int>")).otherwise(F.sort_array(F.array_distinct(F.concat(spaces, middle))))


def surname(c: Column) -> Column:
    """X-13: lower-case text before the first comma."""
    return F.lower(F.trim(F.substring_index(c, ",", 1)))


def lifespan(c: Column) -> tuple[Column, Column]:
    """X-14: (birth, death) of texts such as ``1712-1790``; both are null unless both years are there."""
    year = lambda i: F.regexp_extract(c, r"(\d{4})\s*[-–]\s*(\d{4})", i).try_cast("int")
    return year(1), year(2)


def day_key(date: Column | None, year: Column | None = None, month: Column | None = None, day: Column | None = None) -> Column:
    """X-16: the date, else year, month and day if all three are there, else the first day of the year."""
    ways = []
    if date is not None:
        ways.append(date.cast("string").try_cast("timestamp").cast("date"))
    if year is not None and month is not None and day is not None:
        parts = [as_int(p).cast("string") for p in (year, month, day)]
        ways.append(F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2]).try_cast("date"))
    if year is not None:
        ways.append(F.concat(F.lpad(as_int(year).cast("string"), 4, "0"), F.lit("-01-01")).try_cast("date"))
    return F.coalesce(*ways)


def age(year: Column, birth: Column) -> Column:
    """X-15."""
    return as_int(year) - as_int(birth)


def pattern_parts(c: Column) -> Column:
    """X-17: the parts of a cell that holds several patterns, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[;|\\/]+"), lambda x: F.trim(x)), lambda x: x != "")


def word_halves(c: Column) -> Column:
    """X-18: the first and second half of the words; the middle word goes to the second, a single word to the first."""
    words = F.split(F.trim(c), r"\s+")
    cut = F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))
    return F.struct(F.array_join(F.slice(words, 1, cut), " ").alias("left"), F.array_join(F.slice(words, cut + 1, F.size(words)), " ").alias("right"))


def length_ratio(pattern: Column, anchor: Column) -> Column:
    """X-20, to three digits."""
    return F.bround(F.length(pattern) / F.nullif(F.length(anchor), F.lit(0)), 3)


def full_name(surname_: Column, forename: Column, infix: Column) -> Column:
    """X-21: ``Surname, Forename infix`` from what isn't blank."""
    rest = F.concat_ws(" ", nullif_blank(forename), nullif_blank(infix))
    return F.concat_ws(", ", nullif_blank(surname_), F.when(rest != "", rest))


def char_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """X-22: character n-grams inside words padded by a space; a short word counts once, as a whole."""
    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        grams = lambda n: F.when(F.length(padded) > n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))
        # The first length that covers the padded word gives it whole; longer ones give nothing more.
        whole = F.when((F.length(padded) <= high) & (F.length(padded) >= low), F.array(padded))
        parts = [F.coalesce(grams(n), F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.concat(*parts, F.coalesce(whole, F.array().cast("array<string>")))

    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, of_word))


def word_ngrams(c: Column) -> Column:
    """X-22: words and pairs of neighbouring words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def validity_key(person: Column, pattern: Column, year: Column) -> list[Column]:
    """X-23: three real columns instead of one joined text."""
    return [canonical_id(person), pattern, as_int(year)]


def display_label(name: Column, person: Column) -> Column:
    """X-24: ``name (id)``, or the id alone."""
    return F.when(is_blank(name), person).otherwise(F.concat(name, F.lit(" ("), person, F.lit(")")))


def next_generated_id(persons: DataFrame, prefix: str = "added_") -> DataFrame:
    """X-25: one row ``next_id``: the highest number in use plus one, two digits at least."""
    number = F.regexp_extract(F.col("delegate_id"), f"^{prefix}(\\d+)$", 1).try_cast("int")
    top = persons.agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("string").alias("n"))
    return top.select(F.concat(F.lit(prefix), F.lpad("n", F.greatest(F.lit(2), F.length("n")), F.lit("0"))).alias("next_id"))


def province_rank(df: DataFrame, order: DataFrame, column: str) -> DataFrame:
    """X-26: ``prov_rank`` of a column through ``order(provincie, prov_rank)``, by trimmed lower case."""
    ranks = order.select(F.lower(F.trim("provincie")).alias("_prov"), F.col("prov_rank"))
    return df.join(ranks, F.lower(F.trim(F.col(column))) == F.col("_prov"), "left").drop("_prov")


def resolve(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """The first column of each alias list that ``df`` has, renamed to its canonical name; missing ones are null.

    Only column names are read, on the driver.
    """
    have = set(df.columns)
    picked = {name: next((a for a in [name, *options] if a in have), None) for name, options in aliases.items()}
    used = {a for a in picked.values() if a}
    rest = [c for c in df.columns if c not in used and c not in picked]
    return df.select(*rest, *((F.col(a) if a else F.lit(None).cast("string")).alias(n) for n, a in picked.items()))
