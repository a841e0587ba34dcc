"""A training-data pipeline over ``documents``: five stages, each written and read again.

A stage takes (spark, docs, sf_dir), ``docs`` being what its predecessor kept,
and returns the columns of ``documents``; the last returns packed rows.
"""

from lodestar.llm import decontaminate, jaccard, language, mixing, token_packing
from lodestar.llm.store import materialise, table

ORACLE_SQL = None


def identified(spark, docs, sf_dir):
    """Documents whose language cannot be told go."""
    return language.keep_identified(docs)


def distinct(spark, docs, sf_dir):
    """One document of each near-duplicate component stays."""
    return jaccard.drop_near_copies(docs)


def uncontaminated(spark, docs, sf_dir):
    """Documents with a passage of a test item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Sources at their target weights, a document twice at most."""
    return mixing.mixed_documents(docs)


def packed(spark, docs, sf_dir):
    """Rows of token ids."""
    return token_packing.pack_tokens(docs)


STAGES = [("identified", identified), ("distinct", distinct), ("uncontaminated", uncontaminated), ("mixed", mixed), ("packed", packed)]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
