"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next one's ``docs``. All but the last return the columns of ``documents``, whatever further columns there are and however they are named.
An empty table gives an empty result.
"""

from __future__ import annotations

from loomwright.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from loomwright.llm.common import written
from loomwright.sources.tables import table


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score reaches the threshold go; the model is trained on the labelled ones.

    Every row is scored by its own text; null and empty texts get the score of no words. Without labels of both classes no row goes.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the largest doc_id stays, once. Null counts as empty; rows without doc_id stay."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of each component of similar documents the smallest doc_id stays.

    Documents without words are similar to none. Rows that repeat a doc_id are one document; rows without doc_id stay.
    """
    return jaccard_join.drop_near_duplicates(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that overlap a benchmark item go; every row is judged by its own text. An empty benchmark takes none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """What stays, in sequences of at most 2048 tokens; a document without text is its end id alone. The columns are those of packing."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Training, similarity classes and packing have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, beginning with the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
