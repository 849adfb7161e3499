"""The corpus pipeline: quality, near duplicates, exact repeats, benchmark, packing. Its stages lie with the operators they call.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from speechlake.llm.stages import STAGES, decontaminate, exact_repeats, near_duplicates, packing, quality, run

__all__ = ["ORACLE_SQL", "STAGES", "decontaminate", "exact_repeats", "near_duplicates", "packing", "quality", "run"]

#: Compression, similarity graphs and best-fit search can't be said in SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None
