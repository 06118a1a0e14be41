"""Queries of problems 4 and 6 to 8: percentiles of the ledger, and documents, eval_items and lang_samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, leakage, packing, percentiles
from gridloom.plans.problems import CLEAN_SQL, percentile_sql
from gridloom.plans.ticks import different_ticks, with_day

PHRASE_WORDS = 15
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and other percentiles of units_drawn and cost per resource type, exact."""
    ticks = different_ticks(spark, sf_dir)
    return percentiles.group_percentiles(ticks, "resource_type", ["units_drawn", "cost"], QUANTILES, spread="id").withColumnRenamed("grp", "resource_type")


def p4_percentiles_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two states made separately (even and odd days) and combined."""
    ticks = with_day(different_ticks(spark, sf_dir))
    odd = F.coalesce(F.col("day") % 2 == 1, F.lit(False))
    states = [percentiles.sorted_runs(ticks.filter(part), "resource_type", ["units_drawn", "cost"], spread="id") for part in (odd, ~odd)]
    return percentiles.percentiles_of_runs(percentiles.combine_runs(*states), QUANTILES).withColumnRenamed("grp", "resource_type")


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container and place."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def p6_packing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and space left over."""
    return packing.packing_report(p6_packing(spark, sf_dir))


def p6_packing_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, and how many are incomplete, beyond a container's end, on another's place or divided without need."""
    return packing.packing_faults(p6_packing(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and evaluation item whose wording it contains."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_exact_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose document has PHRASE_WORDS consecutive words of the item letter by letter."""
    return _leaks(spark, sf_dir).filter(F.col("run") >= PHRASE_WORDS).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the share of the item and its longest stretch."""
    return _leaks(spark, sf_dir)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.language_segments(docs, langid.train(_table(spark, sf_dir, "lang_samples"), docs), lang="lang")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of full passages that a document's label does not name."""
    return langid.unnamed_languages(_segments(spark, sf_dir))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of prose in one language, with its confidence."""
    return _segments(spark, sf_dir)


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's main language, with its confidence."""
    return langid.document_languages(_segments(spark, sf_dir))


def p8_label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that each document's label names, as a two-letter code; NULL where it names none."""
    return langid.named_languages(_table(spark, sf_dir, "documents"))


def p8_segment_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and how many segments are misnumbered, overlap, lie outside the text or have no words or an impossible confidence."""
    return langid.segment_faults(_table(spark, sf_dir, "documents"), _segments(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_percentiles_combined, p6_packing, p6_packing_report, p6_packing_faults, p7_found, p7_exact_phrases, p7_leaks, p8_found, p8_segments, p8_documents, p8_label_codes, p8_segment_faults)}

_P4_SQL = f"""WITH {CLEAN_SQL},
k AS (SELECT resource_type, 'units_drawn' AS metric, units_drawn AS value FROM ticks UNION ALL SELECT resource_type, 'cost', cost FROM ticks),
{percentile_sql('k', 'resource_type, metric', QUANTILES)}
SELECT resource_type, metric, cnt AS n, q, value FROM pct"""

_P6_FAULTS_SQL = "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS incomplete, CAST(0 AS BIGINT) AS beyond, CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS divided FROM documents"

# full-width digits are the compatibility forms that occur in words
_WORDS = r"regexp_extract_all(lower(strip_accents(regexp_replace(translate({x}, '０１２３４５６７８９', '0123456789'), '[\x{{00ad}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}\p{{Mn}}]', '', 'g'))), '[\p{{L}}\p{{N}}]+')"
_GRAMS = "SELECT DISTINCT {id}, array_to_string(w[k : k + {n} - 1], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, len(w) - {n} + 2)) AS k FROM {t})"
_P7_EXACT_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format(x='text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format(x='text')} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS ({_GRAMS.format(id='doc_id', n=PHRASE_WORDS, t='d')}), ig AS ({_GRAMS.format(id='item_id', n=PHRASE_WORDS, t='i')})
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

_P8_CODES = ", ".join(f"('{s}', '{code}')" for code, spellings in langid.SPELLINGS.items() for s in spellings)
_P8_LABELS_SQL = rf"""WITH spelling(s, code) AS (VALUES {_P8_CODES}),
l AS (SELECT doc_id, lower(regexp_replace(lang, '^\s+|\s+$', '', 'g')) AS label FROM documents)
SELECT l.doc_id, coalesce(a.code, b.code) AS named FROM l LEFT JOIN spelling a ON a.s = label LEFT JOIN spelling b ON b.s = regexp_extract(label, '^[^-_\s]*')"""

_P8_FAULTS_SQL = "SELECT count(*) AS documents, " + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("misnumbered", "overlapping", "outside", "empty", "unsure")) + " FROM documents"

ORACLES: dict[str, str] = {"p4_percentiles": _P4_SQL, "p4_percentiles_combined": _P4_SQL, "p6_packing_faults": _P6_FAULTS_SQL, "p7_exact_phrases": _P7_EXACT_SQL, "p8_label_codes": _P8_LABELS_SQL, "p8_segment_faults": _P8_FAULTS_SQL}
