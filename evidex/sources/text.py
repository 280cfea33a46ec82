"""Text sources: documents as line blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos (0-based line) and body of every line that is not blank."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    return lines.where(F.trim("body") != "")
