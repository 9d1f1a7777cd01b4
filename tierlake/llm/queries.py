"""The queries of the operators of this subpackage, each over the whole table it is meant for, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierlake.llm import encode, language, neardup, packing, quality, sitelines, spans, unify


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lang_codes.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: quality.not_running(_docs(s, d)),
        "p1_stats": lambda s, d: quality.statistics(_docs(s, d)),
        "p3_found": lambda s, d: unify.lookalike_pairs(_docs(s, d)),
        "p3_forms": lambda s, d: unify.forms_of(_docs(s, d)),
        "p3_groups": lambda s, d: unify.groups(_docs(s, d)),
        "p4_found": lambda s, d: sitelines.repeated_lines(_docs(s, d)),
        "p4_sequences": lambda s, d: sitelines.mined(_docs(s, d))[0],
        "p4_clean": lambda s, d: sitelines.without_site_lines(_docs(s, d)).select("doc_id", "text"),
        "p5_found": lambda s, d: language.relabelled(_docs(s, d), _codes(s, d)),
        "p5_segments": lambda s, d: language.segments(_docs(s, d), _codes(s, d)),
        "p5_documents": lambda s, d: language.every_document(_docs(s, d), _codes(s, d)),
        "p7_found": lambda s, d: neardup.near_pairs(_docs(s, d)),
        "p7_groups": lambda s, d: neardup.groups(_docs(s, d), 0.5, 3),
        "p8_ids": lambda s, d: encode.encode(_docs(s, d)),
        "p8_counts": lambda s, d: encode.encode(_docs(s, d), ids=False),
        "p9_found": lambda s, d: packing.split_documents(_docs(s, d)),
        "p9_containers": lambda s, d: packing.containers(_docs(s, d)),
        "p10_found": lambda s, d: spans.span_pairs(_docs(s, d)),
        "p10_shared": lambda s, d: spans.shared_shares(_docs(s, d)),
    }


_LINES = """
  each_line AS (
    SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
  lines AS (SELECT doc_id, source, raw, line_no, trim(raw, ' ' || chr(9)) AS line FROM each_line),
  sizes AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
  often AS (
    SELECT l.source, l.line FROM lines l JOIN sizes s ON l.source = s.source WHERE l.line <> ''
    GROUP BY l.source, l.line, s.n HAVING count(DISTINCT l.doc_id) >= 5 AND count(DISTINCT l.doc_id) >= 0.3 * s.n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"WITH {_LINES} SELECT l.doc_id, CAST(l.line_no AS BIGINT) AS line_no FROM lines l JOIN often o ON l.source = o.source AND l.line = o.line",
        "p4_clean": f"""WITH {_LINES},
  kept AS (
    SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (WHERE o.line IS NULL) AS text
    FROM lines l LEFT JOIN often o ON l.source = o.source AND l.line = o.line GROUP BY l.doc_id)
  SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.source IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
  FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    }
