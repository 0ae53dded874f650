"""The corpus pipeline: documents through five training-data operators, one stage after the other.

Each stage gets all documents that its predecessor kept, and all but the last return the columns of documents. Rows are told
apart by their whole content, so a null doc_id or one of several rows is a document like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tapeline.llm import byte_bpe, language_id, mixing, near_copies, suffix_dedup
from tapeline.llm.common import keyed, shared_dir, table

#: The column that holds a row's key inside a stage, beside the columns of documents under names of their place.
ROW = "row_key"


def _placed(docs):
    """docs under the names c0, c1, ..., which clash with nothing, with each row's key; and the places of the columns of documents."""
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    return keyed(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), ROW), at


def _renamed(rows, docs):
    """The columns of docs again, in their order and under their names, also where those have dots or differ by case alone."""
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _with_text(rows, docs, at, text):
    """Rows with another text, and its length where docs have n_chars."""
    rows = rows.withColumn(at["text"], text)
    return rows.withColumn(at["n_chars"], F.char_length(at["text"]).cast(docs.schema[docs.columns.index("n_chars")].dataType)) if "n_chars" in at else rows


def _inputs(rows, at, *names):
    return rows.select(ROW, *[F.col(at[c]).alias(c) for c in names])


def language(spark, docs, sf_dir):
    """Documents whose language can't be told go: no letter, or no language with a score of 0.4.

    Null and empty texts have no letter. Each row is judged by itself, so repeated rows stay or go together, and a null doc_id or lang changes
    nothing; without a row that has both a text and a lang nothing can be learnt, and all rows go. Empty table: no rows. Other columns,
    whatever their names, stay as they are.
    """
    return language_id.keep_known(docs, least_score=0.4)


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of near copies (5-word Jaccard of 0.8 or more) stays: the one of smallest doc_id, null last.

    Texts without words, null ones among them, are copies of each other; of rows that are equal in all columns one stays. Empty table: no
    rows. Other columns, whatever their names, stay as they are.
    """
    rows, at = _placed(docs)
    keep = near_copies.near_copies(_inputs(rows, at, "doc_id", "text"), ROW).select(F.col("component").alias(ROW)).distinct()
    return _renamed(rows.join(keep, ROW, "left_semi").dropDuplicates([ROW]), docs)


def repeated_bytes(spark, docs, sf_dir):
    """Bytes of 100-byte strings that start earlier go; a character that is cut apart goes as a whole.

    A null text becomes an empty one, a null doc_id counts as the largest. Rows equal in all columns are copies, each with its own
    text afterwards. n_chars follows the text, where there is one. Empty table: no rows. Other columns, whatever their names, stay as they are.
    """
    rows, at = _placed(docs)
    found = suffix_dedup.suffix_dedup(_inputs(rows, at, "doc_id", "text"), length=100, as_text=True, key=ROW).select(F.col("key").alias(ROW), "kept")
    rest = rows.drop(at["text"]).dropDuplicates([ROW]).join(found, ROW)
    return _renamed(_with_text(rest, docs, at, F.col("kept")), docs)


def mixed(spark, docs, sf_dir):
    """The words that the mix takes: a row for each time that it takes the whole text, and one with the stretches taken once more.

    Those are joined by single spaces, and their n_chars follows. Rows without words, null texts among them, or of which nothing is taken,
    go; a null source is one like any other; equal rows are drawn for separately. Empty table: no rows. Other columns, whatever their names, stay as they are.
    """
    rows, at = _placed(docs)
    taken = mixing.mixed_texts(_inputs(rows, at, "doc_id", "text", "source"), ROW).withColumnRenamed("key", ROW)
    both = rows.dropDuplicates([ROW]).join(taken, ROW)
    whole = _renamed(both.where("whole > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("whole")))), docs)
    words = F.regexp_extract_all(at["text"], F.lit(mixing.WORDS), F.lit(0))
    cut = lambda w: F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(w, p["offset"] + 1, p["words"]))), " ")
    # the words are the only element of an array, so that a text is split once and not for each of its pieces
    part = _with_text(both.where(F.size("pieces") > 0), docs, at, F.element_at(F.transform(F.array(words), cut), 1))
    return whole.union(_renamed(part, docs))


def tokens(spark, docs, sf_dir):
    """Token counts and digests of the ids and of the decoded bytes, a row for each copy.

    A null text is an empty one, a null doc_id stays null; repeated rows give a row each. Empty table: no rows. Other columns are ignored.
    """
    return byte_bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_bytes", repeated_bytes), ("mixed", mixed), ("tokens", tokens)]
#: SQL can't express the trained classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
