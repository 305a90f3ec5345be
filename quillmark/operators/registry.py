"""Joining occurrences to the person registry and the authority file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.columns import SENTINELS, age, as_int, canonical_id, full_name, is_blank, is_null_id, lifespan, nullif_blank, surname

# Column names by which the inputs may call the same thing, the first that is there wins.
PERSON_NAME = ["fullname", "full_name", "naam", "name"]
AUTHORITY_NAME = ["naam", "name", "fullname", "full_name", "achternaam"]
BIRTH = ["birth_year", "geboortejaar", "geboorte", "born", "birth"]
DEATH = ["death_year", "sterfjaar", "overlijden", "died", "death"]
LIFESPAN = ["leefjaren", "levensjaren", "leven"]
# Surname, forename and infix of a person.
NAME_PARTS = ["geslachtsnaam", "voornaam", "tussenvoegsel"]
# Patterns that are never valid.
INVALID_PATTERNS = ("invalid", "<invalid>", "none", "<none>")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """W-11: one row for each key, the first in an explicit order (without one: by all columns)."""
    by = order or tuple(F.col(c) for c in df.columns)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def first_column(df: DataFrame, names: list[str]) -> Column:
    """The first of ``names`` that ``df`` has, else null."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None).cast("string"))


def drop_sentinels(occurrences: DataFrame) -> DataFrame:
    """F-03; rows without an id stay."""
    return occurrences.filter(~F.coalesce(F.col("delegate_id").isin(*SENTINELS), F.lit(False)))


def sentinel_count(occurrences: DataFrame) -> DataFrame:
    """F-03's counter, one row."""
    return occurrences.agg(F.count_if(F.col("delegate_id").isin(*SENTINELS)).alias("n_sentinels"))


def unresolved(occurrences: DataFrame) -> DataFrame:
    """F-04."""
    return occurrences.filter(F.col("delegate_id").isin(*SENTINELS))


def drop_null_ids(df: DataFrame) -> DataFrame:
    """F-05."""
    return df.filter(~is_null_id(F.col("delegate_id")))


def append_new_persons(persons: DataFrame, new: DataFrame) -> DataFrame:
    """U-01: what the new rows lack is null; an id that is there already isn't added."""
    return persons.unionByName(new.join(persons.select("delegate_id"), "delegate_id", "left_anti"), allowMissingColumns=True)


def enrich_persons(persons: DataFrame, authority: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """S-J2: a blank name is filled from the authority, other fields where they are null; nothing is overwritten."""
    name = next(n for n in PERSON_NAME if n in persons.columns)
    one = first_per_key(authority, ["id_persoon"])
    fields = [c for c in (fields if fields is not None else persons.columns) if c in authority.columns and c not in ("delegate_id", name)]
    right = one.select(canonical_id(F.col("id_persoon")).alias("_id"), first_column(authority, AUTHORITY_NAME).alias("_name"), *(F.col(c).alias(f"_a_{c}") for c in fields))
    both = persons.join(right, F.col("delegate_id") == F.col("_id"), "left")
    filled = {name: F.coalesce(nullif_blank(F.col(name)), F.col("_name"), F.col(name))} | {c: F.coalesce(F.col(c), F.col(f"_a_{c}")) for c in fields}
    return both.select(*(filled.get(c, F.col(c)).alias(c) for c in persons.columns))


def enriched_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """A-29: persons with any changed field, one row."""
    right = after.select(F.col("delegate_id").alias("_id"), *(F.col(c).alias(f"_n_{c}") for c in before.columns if c != "delegate_id"))
    changed = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in before.columns if c != "delegate_id"))
    return before.join(right, F.col("delegate_id") == F.col("_id")).agg(F.count_if(changed).alias("n_enriched"))


def attach_years(persons: DataFrame, authority: DataFrame) -> DataFrame:
    """S-J3 to S-J6: ``birth_year, death_year, min_year, max_year`` of each person.

    Years come from the authority's columns, else from a lifespan text, else from ``hlife`` (birth 40
    years before, death 30 after). Values that the person has already win.
    """
    born, died = lifespan(first_column(authority, LIFESPAN).cast("string"))
    middle = as_int(first_column(authority, ["hlife"]))
    years = {
        "birth_year": F.coalesce(as_int(first_column(authority, BIRTH)), born, middle - 40),
        "death_year": F.coalesce(as_int(first_column(authority, DEATH)), died, middle + 30),
        "min_year": as_int(first_column(authority, ["min_year"])),
        "max_year": as_int(first_column(authority, ["max_year"])),
    }
    one = first_per_key(authority.select(canonical_id(F.col("id_persoon")).alias("_id"), *(c.alias(f"_{n}") for n, c in years.items())), ["_id"])
    own = {n: F.coalesce(as_int(F.col(n)), F.col(f"_{n}")) if n in persons.columns else F.col(f"_{n}") for n in years}
    return persons.join(one, F.col("delegate_id") == F.col("_id"), "left").select(*(c for c in persons.columns if c not in own), *(c.alias(n) for n, c in own.items()))


def person_name_mismatch(persons: DataFrame) -> DataFrame:
    """Q11: ``surname`` and ``name_mismatch``: the person's own pattern doesn't hold the surname; null name, no mismatch."""
    has = "pattern" in persons.columns
    test = ~F.contains(F.lower("pattern"), F.col("surname")) if has else F.lit(False)
    return persons.withColumn("surname", surname(F.col("fullname"))).withColumn("name_mismatch", F.coalesce(test, F.lit(False)))


def remap_ids(occurrences: DataFrame, rules: DataFrame) -> DataFrame:
    """S-J7: ``from_id`` becomes ``to_id``, one hop; ``remapped`` tells which rows."""
    one = first_per_key(rules.select(canonical_id(F.col("from_id")).alias("_from"), canonical_id(F.col("to_id")).alias("_to")), ["_from"])
    both = occurrences.join(one, F.col("delegate_id") == F.col("_from"), "left")
    return both.select(*(F.coalesce("_to", "delegate_id").alias(c) if c == "delegate_id" else F.col(c) for c in occurrences.columns), F.col("_to").isNotNull().alias("remapped"))


def remap_counts(occurrences: DataFrame, rules: DataFrame) -> DataFrame:
    """S-J7's counter by rule."""
    changed = occurrences.withColumn("from_id", F.col("delegate_id"))
    return remap_ids(changed, rules).filter("remapped").groupBy("from_id", F.col("delegate_id").alias("to_id")).agg(F.count("*").alias("n"))


def join_persons(occurrences: DataFrame, persons: DataFrame) -> DataFrame:
    """S-J1: left join on the id; a person's column that clashes gets the suffix ``_p``.

    No side is forced to be broadcast: adaptive execution does so where the registry is small.
    """
    clash = set(occurrences.columns) - {"delegate_id"}
    right = persons.select(F.col("delegate_id").alias("_id"), *(F.col(c).alias(f"{c}_p" if c in clash else c) for c in persons.columns if c != "delegate_id"))
    return occurrences.join(right, F.col("delegate_id") == F.col("_id"), "left").drop("_id")


def mark_validity(merged: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """F-17 and S-J11: ``pattern_is_valid``, overridden by ``(delegate_id, pattern, year, valid)``; a rule without a year is for rows without one."""
    builtin = ~F.coalesce(F.lower("pattern").isin(*INVALID_PATTERNS), F.lit(False))
    out = merged.withColumn("pattern_is_valid", builtin)
    if overrides is None:
        return out
    right = first_per_key(overrides.select(canonical_id(F.col("delegate_id")).alias("_i"), F.col("pattern").alias("_p"), as_int(F.col("year")).alias("_y"), F.col("valid").alias("_v")), ["_i", "_p", "_y"])
    both = out.join(right, (F.col("delegate_id") == F.col("_i")) & (F.col("pattern") == F.col("_p")) & F.col("j").eqNullSafe(F.col("_y")), "left")
    return both.withColumn("pattern_is_valid", F.coalesce("_v", "pattern_is_valid")).drop("_i", "_p", "_y", "_v")


def validity_filter(merged: DataFrame, which: str = "all") -> DataFrame:
    """F-16: ``all``, ``valid`` or ``invalid``."""
    return {"all": merged, "valid": merged.filter("pattern_is_valid"), "invalid": merged.filter("NOT pattern_is_valid")}[which]


def build_merged(occurrences: DataFrame, persons: DataFrame, authority: DataFrame, remappings: DataFrame | None = None, new_persons: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """D-14: occurrences with their persons, years, ages and mismatches; sentinel and null ids are gone."""
    if new_persons is not None:
        persons = append_new_persons(persons, new_persons)
    people = person_name_mismatch(attach_years(drop_null_ids(first_per_key(persons, ["delegate_id"])), authority))
    rows = occurrences if remappings is None else remap_ids(occurrences, remappings).drop("remapped")
    rows = drop_null_ids(drop_sentinels(rows))
    merged = mark_validity(join_persons(rows, people), overrides)
    return merged.withColumn("age_at_event", age(F.col("j"), F.col("birth_year"))).withColumn("row_name_mismatch", F.coalesce(~F.contains(F.lower("pattern"), F.col("surname")), F.lit(False)))


def apply_person_edits(persons: DataFrame, edits: DataFrame) -> DataFrame:
    """S-J10: ``edits(delegate_id, ...)`` update matched persons where they hold a value and add unmatched ones."""
    columns = [c for c in edits.columns if c != "delegate_id"]
    right = first_per_key(edits, ["delegate_id"]).select(F.col("delegate_id").alias("_id"), *(F.col(c).alias(f"_e_{c}") for c in columns))
    both = persons.join(right, F.col("delegate_id") == F.col("_id"), "full_outer")
    value = lambda c: F.coalesce(F.col(f"_e_{c}"), F.col(c)) if c in columns and c in persons.columns else F.col(f"_e_{c}") if c in columns else F.col(c)
    names = [*persons.columns, *(c for c in columns if c not in persons.columns)]
    return both.select(*(F.coalesce("delegate_id", "_id").alias(c) if c == "delegate_id" else value(c).alias(c) for c in names))


def missing_ids(occurrences: DataFrame, persons: DataFrame) -> DataFrame:
    """U-04: ids of occurrences that the registry lacks."""
    ids = drop_null_ids(drop_sentinels(occurrences)).select("delegate_id").distinct()
    return ids.join(persons.select("delegate_id"), "delegate_id", "left_anti")


def missing_persons(occurrences: DataFrame, persons: DataFrame, authority: DataFrame) -> DataFrame:
    """S-J13 and C-17: a row for each missing id, filled from the authority."""
    one = first_per_key(authority.select(canonical_id(F.col("id_persoon")).alias("_id"), first_column(authority, AUTHORITY_NAME).alias("fullname"), as_int(first_column(authority, BIRTH)).alias("birth_year"), as_int(first_column(authority, DEATH)).alias("death_year")), ["_id"])
    return missing_ids(occurrences, persons).join(one, F.col("delegate_id") == F.col("_id"), "left").drop("_id")


def authority_status(persons: DataFrame, authority: DataFrame) -> DataFrame:
    """S-J14: ``in_authority`` of each person."""
    ids = authority.select(canonical_id(F.col("id_persoon")).alias("_id")).distinct()
    return persons.join(ids, F.col("delegate_id") == F.col("_id"), "left").withColumn("in_authority", F.col("_id").isNotNull()).drop("_id")


def not_in_authority(persons: DataFrame, authority: DataFrame) -> DataFrame:
    """F-27."""
    return authority_status(persons, authority).filter("NOT in_authority").drop("in_authority")


#: Characters of the grams by which ids are found inside other ids.
GRAM = 3


def _id_grams(c: Column, n: Column) -> Column:
    """The distinct substrings of ``n`` characters; none of shorter texts."""
    places = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(c, i, n)))


def authority_lookup(ids: DataFrame, authority: DataFrame, fields: list[str]) -> DataFrame:
    """S-J15: ``ids(delegate_id)`` with ``fields`` of the authority: by the canonical id, else of the ids that contain it, whatever the case.

    Of several matches the first non-null value counts, by authority id and value. Containment is asked
    for ids without an exact match alone, each once: of an id's grams the one that the fewest authority
    ids have leads to candidates, which are verified. An id shorter than a gram is a gram itself, and its
    matches are added up by gram before they meet it, as half of all authority ids may hold one digit.
    """
    best = lambda df, *keys: df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("_id"), F.col(c)))).alias(c) for c in fields))
    asked = ids.select("delegate_id", canonical_id(F.col("delegate_id")).alias("_asked")).distinct()
    right = authority.select(canonical_id(F.col("id_persoon")).alias("_id"), *fields).filter("_id <> ''")
    exact = asked.join(right, F.col("_asked") == F.col("_id"))
    low = F.lower("_id").alias("_low")
    missed = asked.join(right.select("_id"), F.col("_asked") == F.col("_id"), "left_anti").select("delegate_id", F.lower("_asked").alias("_want")).filter("_want <> ''")
    rest = missed.select("_want").distinct()
    size = F.least(F.length("_want"), F.lit(GRAM))
    wanted = rest.select("_want", F.explode(_id_grams(F.col("_want"), size)).alias("_gram"))
    # Only grams that some id asks for are cut from the authority's ids.
    known = right.select("_id", low, F.explode(F.flatten(F.array(*(_id_grams(F.lower("_id"), F.lit(n)) for n in range(1, GRAM + 1))))).alias("_gram"))
    known = known.join(wanted.select("_gram").distinct(), "_gram", "left_semi")
    counts = known.groupBy("_gram").agg(F.count("*").alias("_df"))
    rare = wanted.join(counts, "_gram", "left").groupBy("_want").agg(F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), "_gram")).alias("_gram"))
    values = right.select(F.col("_id"), *(F.col(c).alias(c) for c in fields))
    long = known.join(rare.filter(F.length("_want") > GRAM), "_gram").filter(F.contains("_low", F.col("_want"))).select("_want", "_id").distinct()
    inside = best(long.join(values, "_id"), "_want")
    short = best(known.join(rare.filter(F.length("_want") <= GRAM).select("_gram").distinct(), "_gram", "left_semi").join(values, "_id"), "_gram").withColumnRenamed("_gram", "_want")
    partial = missed.join(inside.unionByName(short), "_want").drop("_want")
    found = best(exact, "delegate_id").unionByName(partial)
    return ids.join(found, "delegate_id", "left")


def name_lookup(persons: DataFrame) -> DataFrame:
    """S-J18: one name for each id, the first in order."""
    return first_per_key(persons.select("delegate_id", "fullname"), ["delegate_id"])


def fill_from_supplement(persons: DataFrame, supplement: DataFrame, fields: list[str]) -> DataFrame:
    """S-J26: blank fields from a supplement with the same ids; a ``fullname`` that is blank then is made of the name's parts."""
    right = first_per_key(supplement, ["delegate_id"]).select(F.col("delegate_id").alias("_id"), *(F.col(c).alias(f"_s_{c}") for c in fields))
    both = persons.join(right, F.col("delegate_id") == F.col("_id"), "left")
    filled = both.select(*(F.coalesce(nullif_blank(F.col(c)), F.col(f"_s_{c}")).alias(c) if c in fields else F.col(c) for c in persons.columns))
    parts = [F.col(c) if c in filled.columns else F.lit(None).cast("string") for c in NAME_PARTS]
    return filled.withColumn("fullname", F.coalesce(nullif_blank(F.col("fullname")), nullif_blank(full_name(*parts)), F.col("fullname"))) if "fullname" in filled.columns else filled


def add_active_persons(persons: DataFrame, active: DataFrame, supplement: DataFrame | None = None) -> DataFrame:
    """S-J27: active ids that the registry lacks. With a supplement: its rows of those ids, named by surname and forename; without: the ids alone.

    Where the registry has ``cons_id_str`` or ``active_after_corrections``, they are the id and true.
    """
    new = active.select("delegate_id").distinct()
    if supplement is None:
        return append_new_persons(persons, new)
    rows = first_per_key(supplement, ["delegate_id"]).join(new, "delegate_id", "left_semi")
    part = lambda c: F.coalesce(F.col(c), F.lit("")) if c in supplement.columns else F.lit("")
    made = {"fullname": F.regexp_replace(F.concat(part(NAME_PARTS[0]), F.lit(", "), part(NAME_PARTS[1])), "^[, ]+|[, ]+$", ""), "cons_id_str": F.col("delegate_id"), "active_after_corrections": F.lit(True)}
    return append_new_persons(persons, rows.select(*(made.get(c, F.col(c) if c in supplement.columns else F.lit(None)).cast(persons.schema[c].dataType).alias(c) for c in persons.columns)))


def missing_fields(persons: DataFrame, fields: list[str]) -> DataFrame:
    """A-32: how many of ``fields`` are blank for each person."""
    return persons.withColumn("n_missing", reduce(lambda a, b: a + b, (is_blank(F.col(c)).cast("int") for c in fields)))


def blank_counts(persons: DataFrame) -> DataFrame:
    """A-34: blank cells of each column, one row."""
    return persons.agg(*(F.count_if(is_blank(F.col(c))).alias(c) for c in persons.columns))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "delegate_id") -> DataFrame:
    """U-02: ``key, change``: new, removed or changed between two snapshots of the same columns."""
    rest = [c for c in old.columns if c != key]
    pack = lambda df, n: df.select(F.col(key).alias(f"_k{n}"), F.struct(*rest).alias(f"_v{n}"))
    both = pack(old, 0).join(pack(new, 1), F.col("_k0") == F.col("_k1"), "full_outer")
    change = F.when(F.col("_k0").isNull(), "new").when(F.col("_k1").isNull(), "removed").when(~F.col("_v0").eqNullSafe(F.col("_v1")), "changed")
    return both.select(F.coalesce("_k0", "_k1").alias(key), change.alias("change")).filter("change IS NOT NULL")


def id_check(df: DataFrame, column: str) -> DataFrame:
    """A-30: rows, distinct and repeated ids of a column, one row; ``df.dtypes`` has the types."""
    return df.agg(F.count(column).alias("n"), F.count_distinct(column).alias("n_distinct"), (F.count(column) - F.count_distinct(column)).alias("n_repeated"))


def filter_options(persons: DataFrame, merged: DataFrame) -> DataFrame:
    """A-21: one row with the bounds of the years and the sorted provinces; ``name_options`` has the names."""
    return merged.agg(F.coalesce(F.min("j"), F.lit(1700)).alias("min_year"), F.coalesce(F.max("j"), F.lit(1800)).alias("max_year"), F.sort_array(F.collect_set("namens")).alias("provinces"))


def name_options(persons: DataFrame, name: str = "fullname") -> DataFrame:
    """A-21: the distinct names, sorted; a frame of its own, as there is one for nearly each person."""
    return persons.filter(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("name")).distinct().orderBy("name")


def person_slice(df: DataFrame, person: str) -> DataFrame:
    """F-18."""
    return df.filter(canonical_id(F.col("delegate_id")) == person)


def slice_or_person(merged: DataFrame, persons: DataFrame, person: str) -> DataFrame:
    """F-19: the slice of a person; the registry's row where no occurrence is left."""
    rows = person_slice(merged, person)
    alone = person_slice(persons, person).join(merged.select("delegate_id").distinct(), "delegate_id", "left_anti")
    return rows.unionByName(alone.select(*(c for c in alone.columns if c in merged.columns)), allowMissingColumns=True)


def province_year_filter(merged: DataFrame, provinces: list[str] | None = None, first: int | None = None, last: int | None = None, column: str = "namens") -> DataFrame:
    """F-11."""
    out = merged if not provinces else merged.filter(F.col(column).isin(*provinces))
    return out if first is None and last is None else out.filter(F.col("j").between(first if first is not None else -(2**31), last if last is not None else 2**31 - 1))
