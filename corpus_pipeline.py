"""The corpus pipeline: stages that follow one another over documents.

Documents that the quality classifier or the line rules reject go, one document of each group of
near duplicates stays, personal data is replaced, and what is left is packed into sequences. Every
stage works on all that the one before it kept; all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from blockflow.llm.common import table
from blockflow.llm.lines import drop_lines
from blockflow.llm.packing import pack_documents
from blockflow.llm.quadratic import reject_low
from blockflow.llm.sanitise import hide_personal_data
from blockflow.llm.sketches import drop_copies
from blockflow.session import checkpointed

STAGES = [
    ("quality classifier", reject_low),
    ("quality rules", drop_lines),
    ("near duplicates", drop_copies),
    ("personal data", hide_personal_data),
    ("packing", pack_documents),
]
ORACLE_SQL = None  # a fitted classifier and a vocabulary's merges are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
