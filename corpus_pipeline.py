"""A training corpus from documents, in five stages: language, toxicity, near-duplicates, repeats, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the one before it kept; all but the
last return the columns of ``documents``. Other columns are left out, whatever their names.

Null and empty texts have no language and go in the first stage. Long texts are judged whole in every stage. Rows
that repeat an id, or have none, are documents of their own; where id and text are both the same, one row stays. An
empty table gives an empty corpus; without labels nothing is called toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL has no n-gram classifiers, random fields, alignments or suffix arrays: tests compare with plain Python.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose two nearest languages are nearly tied; lang becomes the found one.

    The classifiers learn from the stage's own documents (their text and non-null lang, held-out rows apart).
    """
    from palimpsest.llm.language_id import identify, learn_languages

    found = identify(docs.select(*COLUMNS), learn_languages(docs))
    kept = found.filter((F.col("lang_pred") != "und") & ~F.col("lang_ambiguous"))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches one half; ties at one half go. Learned from ``labels`` of ids not held out."""
    from palimpsest.llm.toxicity import learn_toxicity, tag_toxicity

    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return tag_toxicity(docs.select(*COLUMNS), model).filter(F.col("toxicity") < 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of copies and near copies: rows are told apart by id and text, not by id alone.

    Of a class the row of the smallest id stays, a null id last; blank texts are copies of nothing.
    """
    from palimpsest.llm.near_texts import near_duplicates as classes

    # text whose order is that of the ids, also below zero
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0") if whole else F.col("doc_id").cast("string")
    digest = F.base64(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    key = F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise(F.concat(F.lit("0"), number)), F.lit(" "), digest)
    rows = docs.select(*COLUMNS, key.alias("row_key"))
    dropped = classes(rows, id_col="row_key").filter(~F.col("kept")).select("row_key").distinct()
    kept = rows.join(dropped.hint("shuffle_merge"), "row_key", "left_anti")
    again = rows.filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")).groupBy("row_key").count().filter("count > 1").select("row_key")
    again = stored(again, "again")
    once = kept.join(again.hint("shuffle_merge"), "row_key", "left_anti").select(*COLUMNS)
    one = kept.join(again.hint("shuffle_merge"), "row_key", "left_semi").groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return once.unionByName(one.select("row.*"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every passage of 200 bytes or more that stands elsewhere too, from each place; n_chars follows the text.

    No row goes, also where nothing of its text is left.
    """
    from palimpsest.llm.repeats import remove_repeats

    return remove_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a text of which nothing is left is its end id alone."""
    import public_tokenizers

    from palimpsest.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
