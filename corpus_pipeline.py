"""A corpus pipeline over `documents`: four stages of the llm subpackage in a row.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.  Rows are carried whole,
and nothing but the near-duplicate stage moves texts between executors.

doc_id and text have to be there; further columns of any name are carried through
the filters and left out by the packing.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkmill.llm import language, packing, simhash, toxicity
from sparkmill.llm.bytebpe import byte_bpe_50k
from sparkmill.llm.scratch import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts unlike every language that the labels teach.

    Null, empty and blank texts have no letters and go.  Rows of null lang or null doc_id teach nothing
    but stay if their text does.  Without any labelled row nothing can be told from a language, so all go.
    Very long texts are judged whole.  Repeated rows stay or go together, as often as they occur.
    """
    return language.accepted(docs, language.fit(docs.where(~language.held_out("doc_id", language.FOLDS, language.HELD))))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of toxicity 0.7 or more.

    Null, empty and blank texts have no hits and stay.  Rows of null doc_id are judged but teach nothing; labels
    that are null, or of ids that are not among docs, are left out.  Without labels the general insults
    decide.  Very long texts are judged whole.  Repeated rows stay or go together.
    """
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near-duplicates.

    Null, empty and blank texts are one group.  Rows of null doc_id come last and stay only where their group
    has no id.  Texts of one id and one group: that of least hash stays; rows of one id and text: any
    one, whole.  Very long texts are fingerprinted whole.
    """
    return simhash.representatives(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids.

    Null and empty texts are the end id alone.  A null doc_id is an id like any other.  Very long texts are
    cut into pieces of 2048.  Repeated rows are packed as often as they occur.
    """
    return packing.digests(packing.pack(docs, byte_bpe_50k()))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and the packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
