"""The registered queries of the quality-control operators, each beside its SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import columns as X
from quillmark.functions import names as N
from quillmark.functions.steps import shared_folder, written
from quillmark.operators import corrections as C
from quillmark.operators import detect as D
from quillmark.operators import evaluate as E
from quillmark.operators import events as V
from quillmark.operators import registry as R
from quillmark.operators import search as Q
from quillmark.operators import sequence as W
from quillmark.operators import signals as S
from quillmark.operators import suggest as G
from quillmark.operators.export import export_unique_persons
from quillmark.plans.views import DERIVED, derived
from quillmark.sources import snapshots

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: SQL of the merged rows, after ``DERIVED``.
MERGED = """,
people AS (
  SELECT p.*, coalesce(geboortejaar, hlife - 40) AS birth_year, coalesce(overlijden, hlife + 30) AS death_year, min_year, max_year,
    lower(trim(split_part(fullname, ',', 1))) AS surname, coalesce(NOT contains(lower(p.pattern), lower(trim(split_part(fullname, ',', 1)))), false) AS name_mismatch
  FROM persons p LEFT JOIN authority ON delegate_id = id_persoon),
mapped AS (
  SELECT x.row_id, coalesce(r.to_id, x.delegate_id) AS delegate_id, x.pattern, x.date, x.j, x.offset_, x.class, x.namens, r.to_id IS NOT NULL AS remapped
  FROM occurrences x LEFT JOIN remappings r ON x.delegate_id = r.from_id),
merged AS (
  SELECT m.row_id, m.delegate_id, m.pattern, m.date, m.j, m.offset_, m.class, m.namens, fullname, p.pattern AS pattern_p, provincie, birth_year, death_year, min_year, max_year,
    surname, name_mismatch,
    coalesce(lower(m.pattern) NOT IN ('invalid', '<invalid>', 'none', '<none>'), true) AS pattern_is_valid,
    m.j - birth_year AS age_at_event, coalesce(NOT contains(lower(m.pattern), surname), false) AS row_name_mismatch
  FROM mapped m LEFT JOIN people p ON m.delegate_id = p.delegate_id
  WHERE m.delegate_id IS NOT NULL AND m.delegate_id NOT IN ('-1', '-20'))"""
MODAL = """,
freq AS (SELECT delegate_id, pattern, count(*) AS n FROM merged WHERE pattern IS NOT NULL GROUP BY ALL),
modals AS (SELECT delegate_id, pattern AS modal FROM (SELECT *, row_number() OVER (PARTITION BY delegate_id ORDER BY n DESC, pattern) AS k FROM freq) WHERE k = 1)"""
#: The same with missing patterns as empty ones, as the summary counts.
FILLED = """,
ffreq AS (SELECT delegate_id, coalesce(pattern, '') AS pattern, count(*) AS n FROM merged GROUP BY ALL),
fmodals AS (SELECT delegate_id, pattern AS modal FROM (SELECT *, row_number() OVER (PARTITION BY delegate_id ORDER BY n DESC, pattern) AS k FROM ffreq) WHERE k = 1)"""
CLEAN = """,
clean AS (
  SELECT * FROM merged WHERE pattern IS NOT NULL AND class <> 'president'
    AND NOT regexp_matches(lower(pattern), '^(lunae?|martis|martie|mercurii|mereurii|mercurit|jovis|joris|veneris|sabbathi|dominicae?)\\b|^praeside\\b|\\npraesent|\\b[hb][il]?[oea]t\\s+eerst|\\b[bp]ataafs|^is\\s+na\\s+v[oe]orgaande')),
cfreq AS (SELECT delegate_id, pattern, count(*) AS n FROM clean GROUP BY ALL),
anchors AS (SELECT delegate_id, regexp_replace(lower(trim(pattern)), '\\s+', ' ', 'g') AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY delegate_id ORDER BY n DESC, pattern) AS k FROM cfreq) WHERE k = 1)"""
FOLDED = """,
folded AS (SELECT row_id, tier, to_id FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY tier_rank DESC, to_id DESC) AS k FROM corrections) WHERE k = 1)"""
ORDERED = """,
actual AS (
  SELECT x.*, prov_rank, row_number() OVER (PARTITION BY date ORDER BY offset_ NULLS LAST, row_id) AS actual_pos
  FROM occurrences x LEFT JOIN province_order p ON lower(trim(x.namens)) = lower(trim(p.provincie)) WHERE date IS NOT NULL),
ordered AS (SELECT *, abs(actual_pos - row_number() OVER (PARTITION BY date ORDER BY prov_rank NULLS LAST, actual_pos)) AS pos_diff FROM actual)"""


def _bare(c: str) -> str:
    return f"trim(regexp_replace({c}, '^(?:{'|'.join(sorted(map(re.escape, N.INFIXES), key=len, reverse=True)).replace(chr(39), chr(39) * 2)})\\s*', '', 'i'))"


def _apart(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 ELSE levenshtein({a}, {b}) / greatest(length({a}), length({b})) END)"


def _thousandth(c: str) -> str:
    """Rounded to three digits, halves to even, as Spark's bround."""
    v = f"({c} * 1000)"
    return f"(CASE WHEN abs({v} - floor({v}) - 0.5) < 1e-9 THEN floor({v}) + floor({v}) % 2 ELSE floor({v} + 0.5) END / 1000)"


def _query(select: str | None, *ctes: str) -> Callable:
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(partial(derived, spark, sf_dir))

        _FOUND[f.__name__] = (run, None if select is None else f"{DERIVED}{''.join(ctes)} {select}")
        return f

    return add


def _merged(t: Callable[[str], DataFrame]) -> DataFrame:
    return R.build_merged(t("occurrences"), t("persons"), t("authority"), t("remappings"))


@_query("SELECT row_id, delegate_id, pattern, j, fullname, pattern_p, birth_year, death_year, surname, name_mismatch, row_name_mismatch, pattern_is_valid, age_at_event FROM merged", MERGED)
def merged_rows(t):
    return _merged(t).select("row_id", "delegate_id", "pattern", "j", "fullname", "pattern_p", "birth_year", "death_year", "surname", "name_mismatch", "row_name_mismatch", "pattern_is_valid", "age_at_event")


_SUMMARY = """,
sums AS (
  SELECT delegate_id, count(j) AS n_occurrences, count(*) AS n_rows, min(j) AS first_year, max(j) AS last_year, count(DISTINCT pattern) AS n_patterns,
    count(*) FILTER (age_at_event < 25 OR age_at_event > 70 OR j > death_year) AS n_alive_flags, count(*) FILTER (name_mismatch) AS n_name_mismatch
  FROM merged GROUP BY delegate_id),
gaps AS (SELECT delegate_id, coalesce(max(g), 0) AS max_gap_years FROM (SELECT delegate_id, j - lag(j) OVER (PARTITION BY delegate_id ORDER BY j) AS g FROM (SELECT DISTINCT delegate_id, j FROM merged WHERE j IS NOT NULL)) GROUP BY delegate_id),
anomalies AS (SELECT f.delegate_id, sum(CASE WHEN levenshtein(pattern, modal) > 0.5 * greatest(length(pattern), length(modal)) THEN n ELSE 0 END)::BIGINT AS n_pattern_anomalies FROM ffreq f JOIN fmodals m ON f.delegate_id = m.delegate_id GROUP BY f.delegate_id),
summary AS (
  SELECT p.delegate_id, fullname, coalesce(n_occurrences, 0) AS n_occurrences, coalesce(n_rows, 0) AS n_rows, first_year, last_year, coalesce(n_patterns, 0) AS n_patterns,
    coalesce(modal, '') AS modal, coalesce(n_pattern_anomalies, 0) AS n_pattern_anomalies, coalesce(n_alive_flags, 0) AS n_alive_flags,
    coalesce(n_name_mismatch, 0) AS n_name_mismatch, coalesce(max_gap_years, 0) AS max_gap_years,
    coalesce(n_pattern_anomalies, 0) * 2 + coalesce(n_alive_flags, 0) * 2 + least(coalesce(max_gap_years, 0), 50) / 10 AS issue_score
  FROM persons p LEFT JOIN sums s ON p.delegate_id = s.delegate_id LEFT JOIN gaps g ON p.delegate_id = g.delegate_id
    LEFT JOIN anomalies a ON p.delegate_id = a.delegate_id LEFT JOIN fmodals m ON p.delegate_id = m.delegate_id)"""


def _summary(t: Callable[[str], DataFrame]) -> DataFrame:
    return S.person_summary(_merged(t), t("persons"))


@_query("SELECT * FROM summary", MERGED, FILLED, _SUMMARY)
def person_summary(t):
    return _summary(t)


@_query("SELECT delegate_id, issue_score FROM summary WHERE n_alive_flags > 0 OR max_gap_years >= 10 OR n_pattern_anomalies > 0", MERGED, FILLED, _SUMMARY)
def issue_score(t):
    return S.suspicious(_summary(t)).select("delegate_id", "issue_score")


@_query("SELECT delegate_id, n_pattern_anomalies FROM anomalies", MERGED, FILLED, _SUMMARY)
def pattern_anomalies(t):
    return S.pattern_anomalies(_merged(t))


@_query("SELECT row_id, coalesce(age_at_event < 25, false) AS too_young, coalesce(age_at_event > 70, false) AS too_old, coalesce(j > death_year, false) AS after_death FROM merged", MERGED)
def alive_flags(t):
    return S.alive_flags(_merged(t)).select("row_id", "too_young", "too_old", "after_death")


@_query("SELECT row_id, j < min_year AS before_active, j > max_year AS after_active FROM merged WHERE j < min_year OR j > max_year", MERGED)
def active_period_flags(t):
    return S.alive_flags(_merged(t)).filter("before_active OR after_active").select("row_id", "before_active", "after_active")


@_query("SELECT delegate_id, count(*) AS n FROM merged WHERE row_name_mismatch GROUP BY delegate_id ORDER BY n DESC, delegate_id LIMIT 30", MERGED)
def name_mismatch(t):
    return S.mismatch_breakdown(_merged(t))


@_query("SELECT delegate_id, j AS to_year, p AS from_year, row_id AS to_row, r AS from_row, j - p AS gap FROM (SELECT delegate_id, j, row_id, lag(j) OVER w AS p, lag(row_id) OVER w AS r FROM merged WHERE j IS NOT NULL WINDOW w AS (PARTITION BY delegate_id ORDER BY j, row_id)) WHERE j - p > 1", MERGED)
def timeline_gaps(t):
    return W.timeline_gaps(_merged(t), 1)


@_query("SELECT delegate_id, max_gap_years FROM gaps", MERGED, FILLED, _SUMMARY)
def max_gap(t):
    return S.max_gaps(_merged(t))


@_query("SELECT row_id, namens, prov_rank, actual_pos, pos_diff FROM ordered WHERE pos_diff >= 2", ORDERED)
def day_order_violations(t):
    return W.violations(W.day_order(t("occurrences"), t("province_order")), 2).select("row_id", "namens", "prov_rank", "actual_pos", "pos_diff")


@_query("SELECT namens, count(*) AS n, sum(pos_diff)::BIGINT AS sum_diff FROM ordered WHERE pos_diff >= 2 GROUP BY namens", ORDERED)
def violations_by_province(t):
    return W.violations_by_province(W.day_order(t("occurrences"), t("province_order")), 2).drop("mean_diff")


@_query("SELECT count(DISTINCT date) AS n_days, count(DISTINCT CASE WHEN pos_diff >= 3 THEN date END) AS n_bad_days FROM ordered", ORDERED)
def day_counts(t):
    return W.day_counts(W.day_order(t("occurrences"), t("province_order")), 3)


@_query("SELECT row_id, pos_diff FROM ordered ORDER BY pos_diff DESC, row_id LIMIT 200", ORDERED)
def top_violations(t):
    return S.top_rows(W.day_order(t("occurrences"), t("province_order")).select("row_id", "pos_diff"), [F.desc("pos_diff"), "row_id"], 200)


@_query("SELECT o.row_id, o.date, o.namens, o.actual_pos FROM ordered o WHERE date IN (SELECT date FROM ordered WHERE pos_diff >= 6)", ORDERED)
def day_roster(t):
    o = W.day_order(t("occurrences"), t("province_order"))
    return W.day_roster(o, W.violations(o, 6)).select("row_id", "date", "namens", "actual_pos")


@_query("SELECT x.row_id, coalesce(f.to_id, x.delegate_id) AS delegate_id FROM occurrences x LEFT JOIN folded f ON x.row_id = f.row_id", FOLDED)
def correction_fold(t):
    return C.apply_corrections(t("occurrences"), C.fold(t("corrections"))).select("row_id", "delegate_id")


@_query("SELECT tier, count(*) AS total, count(x.row_id) AS applied, count(*) - count(x.row_id) AS stale, count(DISTINCT delegate_id) AS n_from, count(DISTINCT to_id) AS n_to FROM corrections c LEFT JOIN occurrences x ON c.row_id = x.row_id GROUP BY tier")
def correction_stats(t):
    return C.tier_statistics(t("corrections"), t("occurrences"))


@_query("SELECT x.delegate_id AS from_id, to_id, count(*) AS n FROM folded f JOIN occurrences x ON f.row_id = x.row_id GROUP BY ALL", FOLDED)
def from_to_breakdown(t):
    return C.from_to(C.fold(t("corrections")), t("occurrences"))


@_query("SELECT tier, count(*) AS n, (1000 * count(*)) // (SELECT count(*) FROM occurrences) AS per_mille FROM corrections GROUP BY tier")
def correction_progress(t):
    return C.progress(t("corrections"), t("occurrences"))


@_query("SELECT x.row_id, x.delegate_id, x.pattern, x.j, to_id AS new_delegate_id FROM folded f JOIN occurrences x ON f.row_id = x.row_id", FOLDED)
def changed_rows(t):
    return C.changed_rows(t("occurrences"), C.fold(t("corrections"))).select("row_id", "delegate_id", "pattern", "j", "new_delegate_id")


@_query("SELECT c.row_id, tier, c.to_id, x.delegate_id AS old_id, x.pattern, x.j, p.fullname AS to_name FROM corrections c LEFT JOIN occurrences x ON c.row_id = x.row_id LEFT JOIN persons p ON c.to_id = p.delegate_id")
def correction_context(t):
    return C.with_context(t("corrections").drop("tier_rank"), t("occurrences"), t("persons"))


@_query("SELECT DISTINCT x.delegate_id FROM occurrences x WHERE row_id IN (SELECT row_id FROM corrections)")
def corrected_persons(t):
    return C.corrected_persons(t("occurrences"), t("corrections"))


@_query("SELECT x.row_id FROM occurrences x WHERE row_id NOT IN (SELECT row_id FROM corrections)")
def hide_corrected(t):
    return C.hide_corrected(t("occurrences"), t("corrections")).select("row_id")


@_query("SELECT p.delegate_id FROM persons p WHERE delegate_id IN (SELECT coalesce(f.to_id, x.delegate_id) FROM occurrences x LEFT JOIN folded f ON x.row_id = f.row_id)", FOLDED)
def active_persons(t):
    return C.active_persons(t("persons"), C.apply_corrections(t("occurrences"), C.fold(t("corrections")))).select("delegate_id")


@_query("SELECT row_id, 'active' AS tier, to_id FROM corrections WHERE tier = 'staged' UNION ALL SELECT row_id, tier, to_id FROM corrections WHERE tier = 'approved'")
def load_staged(t):
    return C.move_tier(t("corrections").drop("tier_rank"), "staged", "active", replace=True)


@_query("SELECT delegate_id AS from_id, r.to_id, count(*) AS n FROM occurrences x JOIN remappings r ON x.delegate_id = r.from_id GROUP BY ALL")
def remap_counts(t):
    return R.remap_counts(t("occurrences"), t("remappings"))


@_query("SELECT count(*) FILTER (delegate_id IN ('-1', '-20')) AS n_sentinels FROM occurrences")
def sentinel_count(t):
    return R.sentinel_count(t("occurrences"))


@_query("SELECT row_id, delegate_id, pattern FROM occurrences WHERE delegate_id IN ('-1', '-20')")
def unresolved_rows(t):
    return R.unresolved(t("occurrences")).select("row_id", "delegate_id", "pattern")


@_query("SELECT delegate_id, CASE WHEN trim(fullname) = '' THEN naam ELSE fullname END AS fullname FROM persons p LEFT JOIN authority ON delegate_id = id_persoon")
def authority_enrichment(t):
    return R.enrich_persons(t("persons"), t("authority"), []).select("delegate_id", "fullname")


@_query("SELECT count(*) FILTER (trim(fullname) = '') AS n_enriched FROM persons")
def enriched_count(t):
    p = t("persons")
    return R.enriched_count(p, R.enrich_persons(p, t("authority"), []))


@_query("SELECT delegate_id, birth_year, death_year, min_year, max_year FROM people", MERGED)
def lifespan_estimates(t):
    return R.attach_years(t("persons"), t("authority")).select("delegate_id", "birth_year", "death_year", "min_year", "max_year")


@_query("SELECT DISTINCT x.delegate_id, naam AS fullname, geboortejaar AS birth_year, overlijden AS death_year FROM occurrences x LEFT JOIN authority ON x.delegate_id = id_persoon WHERE x.delegate_id IS NOT NULL AND x.delegate_id NOT IN ('-1', '-20') AND x.delegate_id NOT IN (SELECT delegate_id FROM persons)")
def missing_persons(t):
    return R.missing_persons(t("occurrences"), t("persons"), t("authority"))


@_query("SELECT delegate_id, fullname, 4 - (CASE WHEN trim(fullname) IN ('', 'nan') THEN 0 ELSE 1 END) - 3 AS n_missing FROM persons")
def missing_fields(t):
    return R.missing_fields(t("persons"), ["delegate_id", "fullname", "pattern", "provincie"]).select("delegate_id", "fullname", "n_missing")


@_query("SELECT p.delegate_id, id_persoon IS NOT NULL AS in_authority FROM persons p LEFT JOIN authority ON delegate_id = id_persoon AND geboortejaar IS NOT NULL")
def authority_status(t):
    return R.authority_status(t("persons"), t("authority").filter("geboortejaar IS NOT NULL")).select("delegate_id", "in_authority")


@_query(
    """SELECT coalesce(a.delegate_id, b.delegate_id) AS delegate_id, CASE WHEN a.delegate_id IS NULL THEN 'new' WHEN b.delegate_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM persons WHERE CAST(delegate_id AS INTEGER) % 17 <> 3) a
  FULL JOIN (SELECT delegate_id, CASE WHEN CAST(delegate_id AS INTEGER) % 23 = 5 THEN NULL ELSE fullname END AS fullname, pattern, provincie FROM persons WHERE CAST(delegate_id AS INTEGER) % 19 <> 4) b ON a.delegate_id = b.delegate_id
WHERE a.delegate_id IS NULL OR b.delegate_id IS NULL OR a.fullname IS DISTINCT FROM b.fullname OR a.pattern IS DISTINCT FROM b.pattern OR a.provincie IS DISTINCT FROM b.provincie"""
)
def snapshot_diff(t):
    number = F.col("delegate_id").cast("int")
    later = t("persons").filter(number % 19 != 4).withColumn("fullname", F.when(number % 23 != 5, F.col("fullname")))
    return R.snapshot_diff(t("persons").filter(number % 17 != 3), later)


@_query("SELECT coalesce(a.delegate_id, c.delegate_id) AS delegate_id, coalesce(c.fullname, a.fullname) AS fullname FROM persons a FULL JOIN (SELECT id_persoon AS delegate_id, naam AS fullname FROM authority WHERE hlife IS NOT NULL) c ON a.delegate_id = c.delegate_id")
def person_edits(t):
    edits = t("authority").filter("hlife IS NOT NULL").select(F.col("id_persoon").alias("delegate_id"), F.col("naam").alias("fullname"))
    return R.apply_person_edits(t("persons"), edits).select("delegate_id", "fullname")


@_query("SELECT * FROM persons WHERE contains(lower(delegate_id), 'ro') OR contains(lower(fullname), 'ro') OR contains(lower(pattern), 'ro') OR contains(lower(provincie), 'ro')")
def search_global(t):
    return Q.search(t("persons"), "ro")


@_query("SELECT * FROM persons WHERE regexp_matches(lower(fullname), '^[a-d].*, c1')")
def search_column(t):
    return Q.search(t("persons"), "^[a-d].*, C1", "column", "fullname")


@_query("SELECT * FROM persons WHERE lower(provincie) = 'asia' OR lower(pattern) = 'asia' OR lower(fullname) = 'asia'")
def search_strict(t):
    return Q.search(t("persons"), "ASIA", "strict")


@_query("SELECT row_id FROM occurrences WHERE regexp_matches(lower(pattern), '^lunae?\\b')")
def session_header_filter(t):
    return t("occurrences").filter(N.is_session_header(F.col("pattern"))).select("row_id")


_POSITIONS = """,
pos AS (SELECT row_id, delegate_id, date, row_number() OVER (PARTITION BY date ORDER BY offset_ NULLS LAST, row_id) - 1 AS rank FROM occurrences WHERE date IS NOT NULL)"""


@_query("SELECT a.row_id, b.row_id AS neighbour_id, b.delegate_id AS neighbour_person, b.rank - a.rank AS delta FROM pos a JOIN pos b ON a.date = b.date AND abs(a.rank - b.rank) <= 2 AND a.row_id <> b.row_id", _POSITIONS)
def day_neighbors(t):
    return W.neighbours(W.day_positions(t("occurrences")), 2)


@_query("SELECT a.row_id AS centre_id, b.row_id, b.rank FROM pos a JOIN pos b ON a.date = b.date AND abs(a.rank - b.rank) <= 5 WHERE a.delegate_id = '-20'", _POSITIONS)
def day_context(t):
    rows = t("occurrences").filter("delegate_id = '-20'")
    return W.day_context(W.day_positions(t("occurrences")), rows, 5).select("centre_id", "row_id", "rank")


@_query("SELECT a.delegate_id AS a, b.delegate_id AS b, count(*) AS n FROM pos a JOIN pos b ON a.date = b.date AND abs(a.rank - b.rank) <= 5 AND a.delegate_id <> b.delegate_id GROUP BY ALL", _POSITIONS)
def cooccurrence_edges(t):
    return W.cooccurrence(W.day_positions(t("occurrences")), 5)


@_query("SELECT * FROM freq", MERGED, MODAL)
def pattern_freq(t):
    return S.pattern_frequency(_merged(t))


@_query("SELECT * FROM fmodals", MERGED, FILLED)
def modal_pattern(t):
    return S.modal_of(S.filled_frequency(_merged(t)))


@_query("SELECT * FROM anchors", MERGED, CLEAN)
def anchor_table(t):
    return D.anchor_table(_merged(t)).anchors


_NORM = "regexp_replace(lower(trim(pattern)), '\\s+', ' ', 'g')"
_CANDIDATES = f""",
cand AS (
  SELECT row_id, delegate_id, p AS pattern FROM (SELECT c.row_id, c.delegate_id, {_NORM} AS p, anchor FROM clean c LEFT JOIN anchors a ON c.delegate_id = a.delegate_id)
  WHERE length(p) >= 6 AND (length(p) >= 1.4 * coalesce(length(anchor), 1)
    OR (length(p) - length(replace(p, ' ', '')) > coalesce(length(anchor) - length(replace(anchor, ' ', '')), 0) AND length(p) >= coalesce(length(anchor), 1))))"""
_CANDIDATES = _CANDIDATES.replace("trim(pattern)", "trim(c.pattern)")


@_query("SELECT * FROM cand", MERGED, CLEAN, _CANDIDATES)
def concat_prefilter(t):
    m = _merged(t)
    return D.concat_prefilter(m, D.anchor_table(m).anchors).select("row_id", "delegate_id", "pattern")


@_query("SELECT (SELECT count(*) FROM merged) AS n_rows, (SELECT count(*) FROM clean) AS n_clean, (SELECT count(*) FROM clean WHERE length(pattern) >= 6) AS n_long, (SELECT count(*) FROM cand) AS n_candidates", MERGED, CLEAN, _CANDIDATES)
def prefilter_funnel(t):
    m = _merged(t)
    return D.funnel(m, D.anchor_table(m).anchors)


_FRAGMENTS = f""",
nfreq AS (SELECT delegate_id, {_NORM} AS pattern, count(*) AS n FROM clean GROUP BY ALL),
short AS (SELECT f.delegate_id, f.pattern, n, anchor FROM nfreq f JOIN anchors a ON f.delegate_id = a.delegate_id
  WHERE f.delegate_id IN (SELECT delegate_id FROM nfreq GROUP BY delegate_id HAVING count(*) >= 3) AND length(f.pattern) < 0.75 * length(anchor)),
joined AS (SELECT a.delegate_id, a.anchor, a.pattern AS fragment_a, b.pattern AS fragment_b, unnest([a.pattern || b.pattern, b.pattern || a.pattern, a.pattern || ' ' || b.pattern, b.pattern || ' ' || a.pattern]) AS w, unnest([0, 1, 2, 3]) AS way
  FROM short a JOIN short b ON a.delegate_id = b.delegate_id AND a.pattern < b.pattern),
scored AS (SELECT *, levenshtein(w, anchor) / greatest(length(w), length(anchor)) AS s FROM joined)"""


@_query("SELECT delegate_id, fragment_a, fragment_b, w AS joined FROM (SELECT *, row_number() OVER (PARTITION BY delegate_id, fragment_a, fragment_b ORDER BY s, way) AS k FROM scored) WHERE k = 1 AND s <= 0.15", MERGED, CLEAN, _FRAGMENTS)
def fragment_candidates(t):
    m = _merged(t)
    return D.detect_fragments(m, D.anchor_table(m)).select("delegate_id", "fragment_a", "fragment_b", "joined")


@_query(f"SELECT c.delegate_id, c.pattern, count(*) AS n FROM (SELECT delegate_id, trim(pattern) AS pattern FROM clean) c JOIN anchors a ON c.delegate_id = a.delegate_id WHERE length({_NORM}) >= 1.5 * length(anchor) GROUP BY ALL".replace("trim(pattern))", "trim(c.pattern))"), MERGED, CLEAN)
def suspicious_length_ratio(t):
    m = _merged(t)
    return D.suspicious_lengths(m, D.anchor_table(m)).select("delegate_id", "pattern", "n")


@_query("SELECT t.threshold, count(*) FILTER (d <= t.threshold AND label) AS tp, count(*) FILTER (d <= t.threshold AND NOT label) AS fp, count(*) FILTER (d > t.threshold AND label) AS fn, count(*) FILTER (d > t.threshold AND NOT label) AS tn FROM (SELECT levenshtein(lower(f.pattern), lower(modal)) / greatest(length(f.pattern), length(modal)) AS d, f.pattern LIKE 'vau %' AS label FROM freq f JOIN modals m ON f.delegate_id = m.delegate_id), (SELECT unnest([0.05::DOUBLE, 0.15, 0.25, 0.35, 0.45]) AS threshold) t GROUP BY ALL", MERGED, MODAL)
def threshold_sweep(t):
    m = _merged(t)
    scored = S.pattern_frequency(m).join(S.modal_patterns(m), "delegate_id").select(X.distance(F.lower("pattern"), F.lower("modal")).alias("score"), F.startswith("pattern", F.lit("vau ")).alias("label"))
    return E.threshold_sweep(scored, [0.05, 0.15, 0.25, 0.35, 0.45])


@_query("SELECT delegate_id, row_number() OVER (ORDER BY issue_score DESC, fullname, delegate_id) AS place FROM summary QUALIFY place BETWEEN 21 AND 40", MERGED, FILLED, _SUMMARY)
def review_queue_page(t):
    ranked = _summary(t).withColumn("status_rank", F.lit(0))
    return S.page(ranked, S.sort_keys("queue"), 2, 20).select("delegate_id", "place")


@_query("SELECT p.delegate_id, coalesce(l.patterns, p.pattern) AS patterns FROM persons p LEFT JOIN (SELECT delegate_id, string_agg(DISTINCT pattern, ';' ORDER BY pattern) AS patterns FROM merged WHERE pattern IS NOT NULL GROUP BY delegate_id) l ON p.delegate_id = l.delegate_id", MERGED)
def pattern_lists(t):
    return S.pattern_lists(_merged(t), t("persons"))


@_query(f"SELECT m.row_id, m.delegate_id, m.j AS year, m.pattern AS part, modal, {_thousandth(_apart('m.pattern', 'modal'))} AS distance FROM merged m JOIN modals o ON m.delegate_id = o.delegate_id WHERE m.pattern IS NOT NULL", MERGED, MODAL)
def pattern_distances(t):
    return S.pattern_distances(_merged(t))


@_query("SELECT DISTINCT fullname AS name FROM persons WHERE fullname IS NOT NULL")
def name_options(t):
    return R.name_options(t("persons"))


_IDS = """,
wanted AS (
  SELECT DISTINCT CASE WHEN c_custkey % 10 = 0 THEN 'aB' || c_custkey WHEN c_custkey % 7 = 0 THEN c_custkey || '.0' WHEN c_custkey % 3 = 0 THEN substr(cast(c_custkey AS string), 2) WHEN c_custkey % 11 = 0 THEN 'none' || c_custkey ELSE cast(c_custkey AS string) END AS delegate_id FROM base),
marked AS (SELECT CASE WHEN cast(id_persoon AS int) % 5 = 0 THEN 'Ab' || id_persoon || '-x' ELSE id_persoon END AS id_persoon, naam, geboortejaar FROM authority)"""
_IDS_JOINED = _IDS + """,
asked AS (SELECT delegate_id, regexp_replace(trim(delegate_id), '^([0-9]+)\\.0$', '\\1') AS a FROM wanted),
pairs AS (
  SELECT delegate_id, m.* FROM asked JOIN marked m ON a = id_persoon
  UNION ALL SELECT delegate_id, m.* FROM asked JOIN marked m ON a <> '' AND contains(lower(id_persoon), lower(a)) WHERE a NOT IN (SELECT id_persoon FROM marked))"""


@_query("SELECT w.delegate_id, f.naam, f.geboortejaar FROM wanted w LEFT JOIN (SELECT delegate_id, arg_min(naam, {'i': id_persoon, 'v': naam}) FILTER (naam IS NOT NULL) AS naam, arg_min(geboortejaar, {'i': id_persoon, 'v': geboortejaar}) FILTER (geboortejaar IS NOT NULL) AS geboortejaar FROM pairs GROUP BY delegate_id) f ON w.delegate_id = f.delegate_id", _IDS_JOINED)
def authority_lookup(t):
    return R.authority_lookup(t("wanted", _IDS), t("marked", _IDS), ["naam", "geboortejaar"])


_Q = lambda x: x.replace("'", "''")
_PREFIX = f"(?i)^({'|'.join(_Q(re.escape(p)) for p in sorted(N.canonical_prefixes(), key=len, reverse=True))})(?:\\s+|$)"
_CANONICAL = f""",
canonical AS (SELECT * FROM (VALUES {", ".join(f"('{_Q(v)}', '{_Q(p)}')" for v, p in N.canonical_prefixes().items())}) AS x(variant, prefix))"""


@_query(f"SELECT pattern, coalesce(c.prefix, '') AS prefix, trim(regexp_replace(trim(pattern), '{_PREFIX}', '')) AS core FROM (SELECT DISTINCT pattern FROM occurrences WHERE pattern IS NOT NULL) LEFT JOIN canonical c ON lower(regexp_extract(trim(pattern), '{_PREFIX}', 1)) = c.variant", _CANONICAL)
def prefix_strip(t):
    p = t("occurrences").filter("pattern IS NOT NULL").select("pattern").distinct()
    return p.select("pattern", N.strip_prefix(F.col("pattern")).alias("s")).select("pattern", "s.prefix", "s.core")


@_query("SELECT 'occurrences' AS what, count(*) AS n FROM merged UNION ALL SELECT 'persons', count(*) FROM persons UNION ALL SELECT 'placeholders', count(*) FROM occurrences WHERE delegate_id IN ('-1', '-20') UNION ALL SELECT 'remapped', count(*) FROM mapped WHERE remapped UNION ALL SELECT 'enriched', count(*) FILTER (trim(fullname) = '') FROM persons", MERGED)
def overview(t):
    p = t("persons")
    return S.overview(p, _merged(t), R.unresolved(t("occurrences")), R.remap_ids(t("occurrences"), t("remappings")).filter("remapped"), R.enriched_count(p, R.enrich_persons(p, t("authority"), [])))


@_query("SELECT o.row_id, 'active' AS tier, f.to_id, o.delegate_id AS from_id, p.fullname AS name, 'manual' AS source, '2024-01-01' AS updated_at, 'bulk' AS action_id FROM occurrences o JOIN folded f ON o.row_id = f.row_id LEFT JOIN persons p ON f.to_id = p.delegate_id", FOLDED)
def new_corrections(t):
    rows = t("occurrences").select("row_id", "delegate_id").join(C.fold(t("corrections")).select("row_id", F.col("to_id").alias("to")), "row_id")
    return C.new_corrections(rows, F.col("to"), t("persons"), updated_at=F.lit("2024-01-01"), action_id="bulk")


@_query("SELECT namens, count(*) AS n FROM merged GROUP BY namens", MERGED)
def occurrences_by_province(t):
    return S.occurrences_by(_merged(t), "namens")


@_query("SELECT min(j) AS min_year, max(j) AS max_year, list_sort(list(DISTINCT namens)) AS provinces FROM merged", MERGED)
def filter_options(t):
    return R.filter_options(t("persons"), _merged(t))


@_query("SELECT least(floor(20 * levenshtein(lower(pattern), lower(modal)) / greatest(length(pattern), length(modal))), 19)::BIGINT AS bin, sum(n)::BIGINT AS n FROM freq f JOIN modals m ON f.delegate_id = m.delegate_id GROUP BY bin", MERGED, MODAL)
def distance_histogram(t):
    m = _merged(t)
    d = S.pattern_frequency(m).join(S.modal_patterns(m), "delegate_id").withColumn("mean_distance", X.distance(F.lower("pattern"), F.lower("modal")))
    return S.distance_histogram(d, 20)


@_query("SELECT row_id, unnest([r, row_id]) AS boundary FROM (SELECT 1 AS row_id, 1 AS r) WHERE false UNION ALL SELECT DISTINCT k, k FROM (SELECT unnest([p, row_id]) AS k FROM (SELECT row_id, lag(row_id) OVER w AS p, j - lag(j) OVER w AS g FROM merged WHERE j IS NOT NULL WINDOW w AS (PARTITION BY delegate_id ORDER BY j, row_id)) WHERE g > 1)", MERGED)
def gap_boundaries(t):
    return C.gap_boundary_rows(_merged(t), 1).select("row_id", F.col("row_id").alias("boundary"))


def _even(c: str) -> str:
    """Rounded to four digits, halves to even, as Spark's bround."""
    v = f"({c} * 10000)"
    return f"(CASE WHEN abs({v} - floor({v}) - 0.5) < 1e-9 THEN floor({v}) + floor({v}) % 2 ELSE floor({v} + 0.5) END / 10000)"


_TIGHT = "regexp_replace(lower(trim(pattern)), '\\s+', ' ', 'g')"
#: Names of each person, candidate rows, their neighbours, splits, and the scores of halves.
CONCAT = f""",
names AS (SELECT DISTINCT delegate_id AS person, {_TIGHT} AS name FROM clean WHERE pattern <> ''),
forms AS (SELECT person, name, {_bare("name")} AS bare FROM names),
cand AS (
  SELECT row_id, delegate_id, raw, pattern, coalesce(anchor, '') AS anchor
  FROM (SELECT row_id, delegate_id, pattern AS raw, {_TIGHT} AS pattern FROM clean) LEFT JOIN anchors USING (delegate_id)
  WHERE length(pattern) >= 6 AND (length(pattern) >= 1.4 * coalesce(length(anchor), 1)
    OR length(pattern) - length(replace(pattern, ' ', '')) > coalesce(length(anchor) - length(replace(anchor, ' ', '')), 0) AND length(pattern) >= coalesce(length(anchor), 1))),
pos AS (SELECT row_id, delegate_id, date, row_number() OVER (PARTITION BY date ORDER BY offset_ NULLS LAST, row_id) AS rank FROM merged WHERE date IS NOT NULL),
near AS (
  SELECT c.row_id, n.delegate_id AS person, min(n.rank - p.rank) AS delta
  FROM cand c JOIN pos p ON c.row_id = p.row_id JOIN pos n ON n.date = p.date AND n.rank BETWEEN p.rank - 2 AND p.rank + 2
  WHERE n.delegate_id <> p.delegate_id AND n.delegate_id IN (SELECT person FROM names) GROUP BY ALL),
rest AS (SELECT * FROM cand WHERE row_id IN (SELECT row_id FROM near)),
compound AS (
  SELECT DISTINCT delegate_id, pattern FROM rest WHERE least({_apart("pattern", "anchor")}, {_apart(_bare("pattern"), _bare("anchor"))}) <= 0.25
    AND anchor IN (SELECT name FROM names WHERE person = delegate_id)),
open AS (SELECT * FROM rest ANTI JOIN compound USING (delegate_id, pattern)),
cuts AS (SELECT pattern, k AS split, trim(substr(pattern, 1, k)) AS l, trim(substr(pattern, k + 1)) AS r FROM (SELECT pattern, unnest(range(0, length(pattern))) AS k FROM (SELECT DISTINCT pattern FROM cand WHERE length(pattern) >= 4))
  WHERE substr(pattern, k + 1, 1) = ' ' OR k BETWEEN greatest(2, floor(length(pattern) * 0.3)) AND least(length(pattern) - 2, floor(length(pattern) * 0.7))),
halves AS (SELECT * FROM cuts WHERE length(l) >= 3 AND length(r) >= 3),
asked AS (SELECT DISTINCT person, unnest([l, r]) AS half FROM open JOIN near USING (row_id) JOIN halves USING (pattern)),
half_forms AS (SELECT person, half, {_bare("half")} AS half_bare FROM asked),
scores AS (
  SELECT person, half, min(least({_apart("half", "name")}, CASE WHEN half_bare <> '' AND bare <> '' THEN {_apart("half_bare", "bare")} ELSE 1.0 END)) AS s
  FROM half_forms JOIN forms USING (person) GROUP BY ALL),
placed AS (SELECT row_id, split, l, r, side, s, delta, person FROM (SELECT row_id, split, l, r, unnest(['l', 'r']) AS side, unnest([l, r]) AS half FROM open JOIN halves USING (pattern)) JOIN near USING (row_id) JOIN scores USING (person, half) WHERE s <= 0.35),
nearest AS (SELECT row_id, split, any_value(l) AS l, any_value(r) AS r, min({{'s': s, 'd': delta, 'p': person}}) FILTER (side = 'l') AS bl, min({{'s': s, 'd': delta, 'p': person}}) FILTER (side = 'r') AS br FROM placed GROUP BY row_id, split),
owned AS (SELECT *, CASE WHEN anchor = '' THEN 1.0 ELSE least({_apart("l", "anchor")}, {_apart(_bare("l"), _bare("anchor"))}) END AS ol, CASE WHEN anchor = '' THEN 1.0 ELSE least({_apart("r", "anchor")}, {_apart(_bare("r"), _bare("anchor"))}) END AS orr FROM nearest JOIN open USING (row_id)),
options AS (
  SELECT row_id, delegate_id, raw, anchor, (bl.s + br.s) / 2 AS score, split, 'A' AS kind, l, r, bl.s AS ls, br.s AS rs, bl.p AS lp, br.p AS rp FROM owned WHERE bl.p <> br.p
  UNION ALL SELECT row_id, delegate_id, raw, anchor, (ol + br.s) / 2, split, 'B', l, r, ol, br.s, delegate_id, br.p FROM owned WHERE ol <= 0.35 AND br IS NOT NULL
  UNION ALL SELECT row_id, delegate_id, raw, anchor, (bl.s + orr) / 2, split, 'C', l, r, bl.s, orr, bl.p, delegate_id FROM owned WHERE orr <= 0.35 AND bl IS NOT NULL),
best AS (SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score, split, kind) = 1)"""


@_query(
    f"""SELECT raw AS pattern, b.delegate_id, row_id, anchor, {_even("score")} AS score, split::INTEGER AS split, kind AS "case", l AS split_left, r AS split_right, lp AS left_person, rp AS right_person,
  {_even("ls")} AS left_score, {_even("rs")} AS right_score, n AS n_occurrences
FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY delegate_id, raw ORDER BY score, row_id) = 1) b JOIN freq f ON b.delegate_id = f.delegate_id AND b.raw = f.pattern""",
    MERGED, MODAL, CLEAN, CONCAT,
)
def concat_candidates(t):
    m = written(_merged(t))
    return D.detect_concat(m, D.anchor_table(m))[0]


#: The same by whole names alone.
CONCAT_WHOLE = re.sub(r"trim\(regexp_replace\(([^,()]*)" + re.escape(_bare("@").split("@")[1]), r"\1", CONCAT)


@_query(
    f"""SELECT raw AS pattern, b.delegate_id, row_id, {_even("score")} AS score, kind AS "case" FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY delegate_id, raw ORDER BY score, row_id) = 1) b""",
    MERGED, MODAL, CLEAN, CONCAT_WHOLE,
)
def concat_whole_names(t):
    m = written(_merged(t))
    return D.compare_scorers(m, D.anchor_table(m))[0].select("pattern", "delegate_id", "row_id", "score", "case")


@_query(
    """SELECT reason, count(*) AS n FROM (
  SELECT delegate_id, raw, arg_min(reason, row_id) AS reason FROM (
    SELECT row_id, delegate_id, raw, 'no_neighbors' AS reason FROM cand WHERE row_id NOT IN (SELECT row_id FROM near)
    UNION ALL SELECT row_id, delegate_id, raw, 'compound_name' FROM rest SEMI JOIN compound USING (delegate_id, pattern)
    UNION ALL SELECT row_id, delegate_id, raw, 'score_too_high' FROM open WHERE row_id NOT IN (SELECT row_id FROM best)) GROUP BY ALL) GROUP BY reason""",
    MERGED, MODAL, CLEAN, CONCAT,
)
def concat_rejections(t):
    m = written(_merged(t))
    return D.rejection_counts(D.detect_concat(m, D.anchor_table(m))[1])


@_query(
    f"""SELECT pattern, min(least({_apart("pattern", "anchor")}, CASE WHEN pb <> '' AND ab <> '' THEN {_apart("pb", "ab")} ELSE 1.0 END)) AS compound_score
FROM (SELECT DISTINCT {_TIGHT} AS pattern, {_bare(_TIGHT)} AS pb FROM clean), (SELECT DISTINCT anchor, {_bare("anchor")} AS ab FROM anchors) GROUP BY pattern""",
    MERGED, CLEAN,
)
def compound_score(t):
    m = written(_merged(t))
    return D.compound_scores(m, D.anchor_table(m).anchors)


#: Scores of all unresolved patterns with all persons, in the operator's whole numbers.
_SUGGESTED = """,
labelled AS (SELECT delegate_id, pattern, count(*) AS n FROM merged WHERE pattern IS NOT NULL AND try_cast(delegate_id AS DOUBLE) > 0 GROUP BY ALL),
asked AS (SELECT row_id, pattern, j, class FROM occurrences WHERE delegate_id IN ('-1', '-20')),
known AS (SELECT DISTINCT pattern FROM (SELECT pattern FROM labelled UNION ALL SELECT pattern FROM asked WHERE pattern IS NOT NULL)),
bits AS (SELECT pattern, ' ' || unnest([x FOR x IN string_split_regex(lower(pattern), '\\s+') IF x <> '']) || ' ' AS p FROM known),
grams AS (
  SELECT pattern, 'char' AS space, unnest([substr(p, i, k) FOR i IN range(1, length(p) - k + 2)]) AS term FROM bits, (VALUES (2), (3), (4)) AS s(k) WHERE length(p) > k
  UNION ALL SELECT pattern, 'char', p FROM bits WHERE length(p) BETWEEN 2 AND 4
  UNION ALL SELECT pattern, 'word', unnest(regexp_extract_all(lower(pattern), '\\w+')) FROM known
  UNION ALL SELECT pattern, 'word', unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM (SELECT pattern, regexp_extract_all(lower(pattern), '\\w+') AS w FROM known)),
tf AS (SELECT pattern, space, term, count(*) AS c FROM grams GROUP BY ALL),
ptf AS (SELECT delegate_id, space, term, sum(n * c) AS n FROM labelled JOIN tf USING (pattern) GROUP BY ALL),
idf AS (SELECT space, term, ln((1.0 + (SELECT count(DISTINCT delegate_id) FROM labelled)) / (1 + count(*))) + 1 AS idf FROM ptf GROUP BY ALL),
praw AS (SELECT delegate_id, space, term, (1 + ln(n)) * idf AS w FROM ptf JOIN idf USING (space, term)),
pw AS (SELECT delegate_id, space, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY delegate_id, space)) * 268435456)::BIGINT AS w FROM praw),
qraw AS (SELECT pattern, space, term, (1 + ln(c)) * idf AS w FROM tf JOIN idf USING (space, term) WHERE pattern IN (SELECT pattern FROM asked)),
qw AS (SELECT pattern, space, term, round(CASE space WHEN 'char' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * w / sqrt(sum(w * w) OVER (PARTITION BY pattern, space)) * 268435456)::BIGINT AS w FROM qraw),
scores AS (SELECT pattern, delegate_id, sum(q.w * p.w)::BIGINT AS s FROM qw q JOIN pw p USING (space, term) GROUP BY ALL HAVING s >= 7205759403792794),
years AS (SELECT delegate_id, min(j) AS first_year, max(j) AS last_year FROM merged WHERE pattern IS NOT NULL GROUP BY delegate_id),
ranked AS (
  SELECT row_id, s.delegate_id AS person, round(s / 72057594037927936.0::DOUBLE, 3) AS score, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, s.delegate_id) AS place
  FROM asked a JOIN scores s ON a.pattern = s.pattern JOIN years y ON s.delegate_id = y.delegate_id WHERE j IS NULL OR j BETWEEN first_year - 5 AND last_year + 5)"""


@_query(
    "SELECT a.row_id, "
    + ", ".join(f"max(person) FILTER (place = {i}) AS person_{i}, coalesce(max(score) FILTER (place = {i}), 0.0) AS score_{i}" for i in (1, 2, 3))
    + " FROM asked a LEFT JOIN ranked r ON a.row_id = r.row_id GROUP BY a.row_id",
    MERGED, _SUGGESTED,
)
def suggestions_topk(t):
    return G.suggest(R.unresolved(t("occurrences")), G.build_store(written(_merged(t))))


_EVIDENCE = f""",
suspects AS (SELECT c.delegate_id, c.pattern, {_thousandth("length(c.norm) / length(anchor)")} AS ratio, c.norm FROM (SELECT DISTINCT delegate_id, trim(pattern) AS pattern, {_TIGHT} AS norm FROM clean) c JOIN anchors a ON c.delegate_id = a.delegate_id WHERE length(c.norm) >= 1.4995 * length(anchor)),
mpos AS (SELECT row_id, delegate_id, date, row_number() OVER (PARTITION BY date ORDER BY offset_ NULLS LAST, row_id) AS rank FROM merged WHERE date IS NOT NULL),
seen AS (SELECT DISTINCT a.delegate_id, b.delegate_id AS near FROM mpos a JOIN mpos b ON a.date = b.date AND b.rank BETWEEN a.rank - 5 AND a.rank + 5 AND a.delegate_id <> b.delegate_id WHERE a.delegate_id IN (SELECT delegate_id FROM suspects)),
words AS (SELECT *, string_split(norm, ' ') AS w, greatest(1, len(string_split(norm, ' ')) // 2) AS mid FROM suspects WHERE ratio >= 1.5),
halved AS (SELECT delegate_id, pattern, ratio, array_to_string(w[:mid], ' ') AS l, array_to_string(w[mid + 1:], ' ') AS r FROM words),
shown AS (
  SELECT h.delegate_id, h.r, n.near, a.anchor, CASE WHEN {_bare("h.r")} = '' THEN {_apart("h.r", "a.anchor")} ELSE least({_apart("h.r", "a.anchor")}, {_apart(_bare("h.r"), _bare("a.anchor"))}) END AS s
  FROM (SELECT DISTINCT delegate_id, r FROM halved WHERE r <> '') h JOIN seen n ON h.delegate_id = n.delegate_id JOIN anchors a ON n.near = a.delegate_id WHERE a.anchor <> ''),
closest AS (SELECT * FROM shown WHERE s < 1 QUALIFY row_number() OVER (PARTITION BY delegate_id, r ORDER BY s, near) = 1)"""


@_query(
    f"""SELECT h.delegate_id, h.pattern, h.ratio, h.l AS "left", h.r AS "right", length({_bare("h.l")}) < 2 AS left_is_infix, coalesce({_thousandth("c.s")}, 1.0) AS score, c.near, c.anchor AS near_anchor, coalesce(k.n_near, 0) AS n_near
FROM halved h LEFT JOIN closest c ON h.delegate_id = c.delegate_id AND h.r = c.r LEFT JOIN (SELECT delegate_id, count(*) AS n_near FROM seen GROUP BY delegate_id) k ON h.delegate_id = k.delegate_id""",
    MERGED, CLEAN, _EVIDENCE,
)
def neighbour_evidence(t):
    m = written(_merged(t))
    table = D.anchor_table(m)
    return D.neighbour_evidence(D.suspicious_lengths(m, table), table)


@_query(
    f"""SELECT row_id, pattern, min((l_s + r_s) / 2) AS best FROM (
  SELECT c.row_id, c.pattern, h.split, min({_apart("h.l", "a.anchor")}) AS l_s, min({_apart("h.r", "a.anchor")}) AS r_s
  FROM cand c JOIN halves h USING (pattern) JOIN pos p ON c.row_id = p.row_id JOIN pos n ON n.date = p.date AND n.rank BETWEEN p.rank - 2 AND p.rank + 2 AND n.row_id <> p.row_id JOIN anchors a ON n.delegate_id = a.delegate_id
  GROUP BY ALL) GROUP BY ALL""",
    MERGED, CLEAN, CONCAT,
)
def best_split_scores(t):
    m = written(_merged(t))
    return D.best_split_scores(m, D.anchor_table(m))


_LOG = """,
events AS (
  SELECT row_id, tier, CASE WHEN row_id % 3 = 0 AND tier = 'staged' THEN NULL ELSE to_id END AS to_id,
    CASE tier WHEN 'staged' THEN '1995-01-' WHEN 'approved' THEN '1996-02-' ELSE '1997-03-' END || lpad(cast(row_id % 28 + 1 AS string), 2, '0') AS updated_at, 'a' || cast(row_id % 5 AS string) AS action_id FROM corrections
  UNION ALL SELECT row_id, tier, to_id || '0', '1996-02-' || lpad(cast(row_id % 28 + 1 AS string), 2, '0'), 'b' FROM corrections WHERE tier = 'staged' AND row_id % 4 = 0)"""


@_query("SELECT row_id, tier, to_id, updated_at FROM (SELECT * FROM events WHERE updated_at <= '1996-02-15' QUALIFY row_number() OVER (PARTITION BY row_id, tier ORDER BY updated_at DESC) = 1) WHERE to_id IS NOT NULL", _LOG)
def corrections_as_of(t):
    log = V.compact(V.correction_events(t("events", _LOG)), "1995-12-31")
    return V.corrections_of(V.as_of(log, "1996-02-15")).select("row_id", "tier", "to_id", "updated_at")


@_query("SELECT delegate_id, CASE WHEN trim(fullname) = '' THEN naam ELSE fullname END AS fullname, CASE WHEN trim(fullname) = '' THEN cast(geboortejaar AS string) END AS birth_year FROM persons p LEFT JOIN authority ON delegate_id = id_persoon")
def enrichment_edits(t):
    p = t("persons").withColumn("birth_year", F.lit(None).cast("string"))
    log = V.enrichment_events(p, t("authority"), {"fullname": "naam", "birth_year": "geboortejaar"}, F.lit("2024-01-01"), "enrich")
    return R.apply_person_edits(p, V.edits_of(V.as_of(log), ["fullname", "birth_year"])).select("delegate_id", "fullname", "birth_year")


_EXTRA = """,
extra AS (SELECT id_persoon AS delegate_id, 'Van ' || naam AS geslachtsnaam, CASE WHEN hlife IS NULL THEN 'J' || id_persoon END AS voornaam, geboortejaar AS birth_year FROM authority WHERE cast(id_persoon AS int) % 4 <> 1)"""


@_query(
    """SELECT a.delegate_id, CASE WHEN p.delegate_id IS NULL THEN e.geslachtsnaam || coalesce(', ' || e.voornaam, '') WHEN trim(p.fullname) <> '' THEN p.fullname WHEN e.delegate_id IS NULL THEN p.fullname ELSE e.geslachtsnaam || coalesce(', ' || e.voornaam, '') END AS fullname,
  coalesce(l.patterns, p.pattern) AS patterns
FROM (SELECT DISTINCT delegate_id FROM fixed WHERE delegate_id NOT IN ('-1', '-20')) a LEFT JOIN persons p ON a.delegate_id = p.delegate_id LEFT JOIN extra e ON a.delegate_id = e.delegate_id
  LEFT JOIN (SELECT delegate_id, string_agg(DISTINCT pattern, ';' ORDER BY pattern) AS patterns FROM fixed WHERE pattern IS NOT NULL GROUP BY delegate_id) l ON a.delegate_id = l.delegate_id
WHERE p.delegate_id IS NOT NULL OR e.delegate_id IS NOT NULL""",
    FOLDED, ", fixed AS (SELECT coalesce(f.to_id, x.delegate_id) AS delegate_id, x.pattern FROM occurrences x LEFT JOIN folded f ON x.row_id = f.row_id)", _EXTRA,
)
def unique_persons(t):
    p = t("persons").withColumns({c: F.lit(None).cast("string") for c in ("geslachtsnaam", "voornaam")})
    root = f"{shared_folder(p.sparkSession)}/unique-{uuid.uuid4().hex}"
    export_unique_persons(t("occurrences"), t("corrections"), p, t("extra", _EXTRA), ["geslachtsnaam", "voornaam"], root)
    return snapshots.read(p.sparkSession, root, "persons").select("delegate_id", "fullname", "patterns")


_SCORED = f"""scored AS (SELECT f.delegate_id, f.pattern, {_apart("f.pattern", "modal")} AS score, f.pattern LIKE 'vau %' AS label FROM freq f JOIN modals m ON f.delegate_id = m.delegate_id)"""


def _scored(t):
    m = _merged(t)
    return S.pattern_frequency(m).join(S.modal_patterns(m), "delegate_id").select("delegate_id", "pattern", X.distance(F.col("pattern"), F.col("modal")).alias("score"), F.startswith("pattern", F.lit("vau ")).alias("label"))


_SAMPLE = f""",
{_SCORED},
zone AS (SELECT pattern, score, min(delegate_id) AS delegate_id, CASE WHEN abs(score * 10000 - floor(score * 10000) - 0.5) < 1e-7 THEN floor(score * 10000) + floor(score * 10000) % 2 ELSE floor(score * 10000 + 0.5) END AS p FROM scored WHERE score BETWEEN 0.1 AND 0.9 AND NOT pattern LIKE '%red%' GROUP BY pattern, score),
cuts AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.5) AS b, quantile_cont(p, 0.75) AS c, count(*) AS n FROM zone),
quarters AS (SELECT z.*, 1 + (p > a)::INT + (p > b)::INT + (p > c)::INT AS quartile, n FROM zone z, cuts),
drawn AS (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY md5('0:' || pattern), pattern, score) AS place, greatest(1, round_even(40 * count(*) OVER (PARTITION BY quartile) / n, 0)) AS take FROM quarters)"""


@_query("SELECT pattern, score, quartile, place, CASE WHEN place <= round_even(take * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM drawn WHERE place <= take", MERGED, MODAL, _SAMPLE)
def labelling_sample(t):
    zone = E.ambiguous_zone(_scored(t), 0.1, 0.9).filter("NOT pattern LIKE '%red%'")
    return E.stratified_sample(zone, 40).select("pattern", "score", "quartile", "place", "split")


@_query("SELECT label, count(*) AS n, min(score) AS min, max(score) AS max FROM scored GROUP BY label", MERGED, MODAL, f", {_SCORED}")
def score_description(t):
    return E.describe_scores(_scored(t)).select("label", "n", "min", "max")


@_query("SELECT * FROM persons WHERE coalesce(regexp_matches(fullname, '(?i)ro'), false) OR coalesce(regexp_matches(delegate_id, '(?i)ro'), false)")
def search_name(t):
    return Q.search_name_or_id(t("persons"), "ro")


@_query("SELECT row_id, namens, j FROM merged WHERE namens IN ('ASIA', 'EUROPE', 'unknown') AND j BETWEEN 1994 AND 1996", MERGED)
def province_years(t):
    return R.province_year_filter(_merged(t), ["ASIA", "EUROPE", "unknown"], 1994, 1996).select("row_id", "namens", "j")


@_query("SELECT row_id, delegate_id, pattern FROM merged WHERE delegate_id = '25' UNION ALL SELECT NULL, delegate_id, pattern FROM persons WHERE delegate_id = '25' AND delegate_id NOT IN (SELECT delegate_id FROM merged)", MERGED)
def person_rows(t):
    return R.slice_or_person(_merged(t), t("persons"), "25").select("row_id", "delegate_id", "pattern")


_SYNONYMS = """,
synonyms AS (SELECT delegate_id, ARRAY(pattern, 'vau ' || pattern) AS patterns, 5 AS freq_a, 1 AS freq_b FROM persons WHERE cast(delegate_id AS int) % 3 = 0)"""


@_query("SELECT delegate_id, CASE WHEN n_rows > 0 AND cast(delegate_id AS INTEGER) % 3 = 0 THEN greatest(n_patterns - 1, 1) WHEN n_rows > 0 THEN greatest(n_patterns, 1) ELSE 0 END AS n_patterns FROM summary", MERGED, FILLED, _SUMMARY)
def patterns_without_ghosts(t):
    return S.person_summary(_merged(t), t("persons"), t("synonyms", _SYNONYMS)).select("delegate_id", "n_patterns")


@_query("SELECT m.delegate_id, m.pattern AS part, count(*) AS n, min(j) AS first_year, max(j) AS last_year, count(c.row_id) AS n_corrected FROM merged m LEFT JOIN (SELECT DISTINCT row_id FROM corrections) c ON m.row_id = c.row_id WHERE pattern IS NOT NULL GROUP BY ALL", MERGED)
def unique_patterns(t):
    return S.unique_patterns(_merged(t), t("corrections")).drop("mean_distance")


@_query("SELECT pattern, label FROM (SELECT pattern, namens AS label, count(*) AS n FROM occurrences GROUP BY ALL) WHERE pattern IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY n DESC, label) = 1")
def majority_labels(t):
    return E.majority_label(t("occurrences").filter("pattern IS NOT NULL").select("pattern", F.col("namens").alias("label")))


@_query("SELECT threshold, count(*) FILTER (score <= threshold) AS n FROM scored, (SELECT unnest([0.1::DOUBLE, 0.2, 0.4, 0.8]) AS threshold) GROUP BY threshold", MERGED, MODAL, f", {_SCORED}")
def candidates_by_threshold(t):
    return E.candidates_by_threshold(_scored(t), [0.1, 0.2, 0.4, 0.8])


@_query("SELECT delegate_id, fullname FROM persons")
def name_lookup(t):
    return R.name_lookup(t("persons"))


@_query("SELECT f.* FROM freq f WHERE NOT (pattern LIKE 'vau %' AND delegate_id IN (SELECT delegate_id FROM persons))", MERGED, MODAL)
def without_dismissed(t):
    found = S.pattern_frequency(_merged(t))
    return C.without_dismissed(found, found.filter("pattern LIKE 'vau %'").join(t("persons").select("delegate_id"), "delegate_id", "left_semi"))


_REVIEW = """,
review AS (SELECT DISTINCT CASE WHEN row_id % 10 = 0 THEN 'never seen' ELSE pattern END AS pattern, delegate_id, '1' AS to_id, row_id % 3 <> 0 AS confirmed FROM occurrences WHERE row_id % 5 = 0 AND pattern IS NOT NULL AND delegate_id IS NOT NULL)"""


@_query("SELECT DISTINCT x.row_id, r.to_id FROM occurrences x JOIN review r ON x.pattern = r.pattern AND x.delegate_id = r.delegate_id WHERE confirmed", _REVIEW)
def confirmed_rows(t):
    return C.confirmed_rows(t("occurrences"), t("review", _REVIEW)).select("row_id", "to_id")


@_query("SELECT pattern, delegate_id FROM review r WHERE confirmed AND NOT EXISTS (SELECT 1 FROM occurrences x WHERE x.pattern = r.pattern AND x.delegate_id = r.delegate_id)", _REVIEW)
def unmatched_review(t):
    return C.unmatched_review(t("occurrences"), t("review", _REVIEW)).select("pattern", "delegate_id")


_FALSE = """,
truth AS (SELECT DISTINCT upper(pattern) || ' ' AS pattern, pattern LIKE 'vau %' AS label FROM occurrences WHERE pattern LIKE 'vau %' OR pattern LIKE 'l%'),
rejected AS (SELECT DISTINCT pattern FROM occurrences WHERE pattern IS NOT NULL AND NOT pattern LIKE 'Lunae%')"""


@_query("SELECT pattern, CASE WHEN pattern LIKE 'vau %' THEN 'false_negative' WHEN pattern LIKE 'l%' THEN 'right' ELSE 'unlabelled' END AS outcome FROM rejected", _FALSE)
def false_negatives(t):
    return E.false_negatives(t("rejected", _FALSE), t("truth", _FALSE)).select("pattern", "outcome")


@_query(
    "SELECT raw AS pattern, b.delegate_id, lp AS left_person, rp AS right_person, x.anchor AS left_anchor, y.anchor AS right_anchor FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY delegate_id, raw ORDER BY score, row_id) = 1) b LEFT JOIN anchors x ON lp = x.delegate_id LEFT JOIN anchors y ON rp = y.delegate_id",
    MERGED, MODAL, CLEAN, CONCAT,
)
def concat_anchors(t):
    m = written(_merged(t))
    table = D.anchor_table(m)
    return D.with_anchors(D.detect_concat(m, table)[0], table.anchors).select("pattern", "delegate_id", "left_person", "right_person", "left_anchor", "right_anchor")


@_query("SELECT a.row_id, 'staged' AS tier, person AS to_id, o.delegate_id AS from_id, p.fullname AS name, 'suggestion' AS source FROM asked a JOIN ranked r ON a.row_id = r.row_id JOIN occurrences o ON a.row_id = o.row_id LEFT JOIN persons p ON p.delegate_id = person WHERE place = 1 AND score >= 0.8", MERGED, _SUGGESTED)
def accepted_suggestions(t):
    rows = R.unresolved(t("occurrences"))
    found = written(G.suggest(rows, G.build_store(written(_merged(t)))))
    return C.accept_suggestions(rows.select("row_id", "delegate_id"), found, t("persons"), 0.8).drop("updated_at")


_DECISIONS = """,
before AS (SELECT DISTINCT pattern, delegate_id, true AS valid FROM occurrences WHERE row_id % 4 = 0 AND pattern IS NOT NULL AND delegate_id IS NOT NULL),
after AS (SELECT DISTINCT pattern, delegate_id, false AS valid FROM occurrences WHERE row_id % 6 = 0 AND pattern IS NOT NULL AND delegate_id IS NOT NULL)"""


@_query("SELECT * FROM after UNION ALL SELECT * FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.pattern = b.pattern AND a.delegate_id = b.delegate_id)", _DECISIONS)
def decisions(t):
    return C.add_decisions(t("before", _DECISIONS), t("after", _DECISIONS), ["pattern", "delegate_id"])


def _parts(c: str) -> str:
    """Prefix and core of a text in lower case."""
    return f"(SELECT x AS {c}, coalesce(prefix, '') AS {c}_p, trim(regexp_replace(x, '{_PREFIX}', '')) AS {c}_c FROM (SELECT DISTINCT lower(trim({c})) AS x FROM named) LEFT JOIN canonical ON lower(regexp_extract(x, '{_PREFIX}', 1)) = variant)"


_NORMALISED = "CASE WHEN {0}_p = '' THEN {0}_c WHEN {0}_c = '' THEN {0}_p ELSE {0}_p || ' ' || {0}_c END"
#: Whole and core of each pattern and of its person's own.
_NAMED = f"""{_CANONICAL},
named AS (SELECT DISTINCT pattern AS a, pattern_p AS b FROM merged WHERE pattern IS NOT NULL AND pattern_p IS NOT NULL),
left_parts AS (SELECT a, {_NORMALISED.format("a")} AS a_n FROM {_parts("a")}),
right_parts AS (SELECT b, {_NORMALISED.format("b")} AS b_n FROM {_parts("b")}),
cored AS (
  SELECT n.a, n.b, a_n, b_n, trim(regexp_replace(a_n, '{_PREFIX}', '')) AS a_c, trim(regexp_replace(b_n, '{_PREFIX}', '')) AS b_c
  FROM named n JOIN left_parts l ON lower(trim(n.a)) = l.a JOIN right_parts r ON lower(trim(n.b)) = r.b)"""


@_query(
    f"""SELECT a AS pattern, b AS own, least({_apart("a_n", "b_n")}, CASE WHEN a_c = '' OR b_c = '' THEN 1.0 ELSE {_apart("a_c", "b_c")} END, CASE WHEN a_c = '' THEN 1.0 ELSE {_apart("a_c", "b_n")} END, CASE WHEN b_c = '' THEN 1.0 ELSE {_apart("a_n", "b_c")} END) AS distance FROM cored""",
    MERGED, _NAMED,
)
def prefix_distances(t):
    names = _merged(t).filter("pattern IS NOT NULL AND pattern_p IS NOT NULL").select("pattern", F.col("pattern_p").alias("own")).distinct()
    return names.withColumn("distance", N.prefix_distance(F.col("pattern"), F.col("own")))


@_query("SELECT DISTINCT n.a AS pattern, a_n AS normalised, a_c AS core FROM cored n", MERGED, _NAMED)
def prefix_normal_forms(t):
    names = _merged(t).filter("pattern IS NOT NULL AND pattern_p IS NOT NULL").select("pattern").distinct()
    low = F.lower(F.trim("pattern"))
    return names.select("pattern", N.normalise_prefix(low).alias("normalised"), N.core(low).alias("core"))


_DAYS = """,
days AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN cast(date AS string) WHEN row_id % 3 = 1 THEN 'no day' END AS day, CASE WHEN row_id % 5 = 0 THEN NULL ELSE month(date) END AS m, day(date) AS d, j FROM occurrences)"""


@_query("SELECT row_id, coalesce(try_cast(day AS DATE), try_cast(cast(j AS VARCHAR) || '-' || lpad(cast(m AS VARCHAR), 2, '0') || '-' || lpad(cast(d AS VARCHAR), 2, '0') AS DATE), try_cast(cast(j AS VARCHAR) || '-01-01' AS DATE)) AS day FROM days", _DAYS)
def day_keys(t):
    return t("days", _DAYS).select("row_id", X.day_key(F.col("day"), F.col("j"), F.col("m"), F.col("d")).alias("day"))


@_query("SELECT space, term, count(DISTINCT pattern) AS n_patterns, sum(c)::BIGINT AS n FROM tf GROUP BY ALL", MERGED, _SUGGESTED)
def ngram_counts(t):
    known = _merged(t).filter("pattern IS NOT NULL AND try_cast(delegate_id AS double) > 0").select("pattern").union(R.unresolved(t("occurrences")).filter("pattern IS NOT NULL").select("pattern")).distinct()
    terms = G.terms_of(known.withColumn("q", F.col("pattern")), "q", F.lit(1))
    return terms.groupBy("space", "term").agg(F.count_distinct("q").alias("n_patterns"), F.sum("n").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql is not None}
