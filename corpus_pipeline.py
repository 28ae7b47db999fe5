"""From documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all rows of docs; its result is written as Parquet and
reread as the next stage's docs. All but the last return the columns of documents, so each can be run, checked and repeated by
itself.

1. toxicity: documents that the clause grammar scores at 0.5 or more go. Learned from `labels`.
2. near_duplicates: of each group of texts that share 0.8 of their 5-word shingles or more, directly or over others, the document
   with the smallest doc_id stays.
3. substring_dedup: words under windows of 13 words that also start in a document with a smaller doc_id go; a text that loses words
   is what is left, joined by single spaces, and n_chars is counted anew. Documents that lose all their words go.
4. decontamination: documents with a passage of `benchmark` go.
5. packing: the pieces of the documents and their places in sequences of 2048 tokens.

In stage 2 rows with one doc_id count as one document: they stay or go together, but of rows with the same text too, one stays; the
other stages judge each row by its own text. Rows with a null doc_id are told apart by their texts and come after all others. Null texts are empty ones; they stay until texts without
words are found to be equal, and one of them stays. Extra columns are kept by the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, fits_broadcast, materialize, prepare, read_table, row_key, scratch_dir, text_key

#: SQL cannot express the stages; tests compare each with a brute-force version.
ORACLE_SQL = None


KEY = "row@key"


def named(docs: DataFrame) -> DataFrame:
    """The keys of docs as doc_id, and their texts."""
    return docs.select(row_key().alias("doc_id"), "text")


def without(docs: DataFrame, gone: DataFrame, key=None) -> DataFrame:
    """docs less the rows whose keys (row_key() if not given) are doc_ids in gone; these are sent to the documents while they are few, else both are dealt by key."""
    gone = materialize(gone.select(F.col("doc_id").alias(KEY)).distinct())
    gone = F.broadcast(gone) if fits_broadcast(gone.count(), 80) else gone
    return docs.withColumn(KEY, row_key() if key is None else key).join(gone, KEY, "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import fit, score_of

    prepare(spark)
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(score_of(F.col("text"), model) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash import similar_groups

    prepare(spark)
    kept = without(docs, similar_groups(named(docs)).where("doc_id <> group_id"))
    # Rows that repeat a doc_id and its text are copies too; only rows of doc_ids that occur twice are compared.
    twice = materialize(named(kept).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    own = kept.withColumn(KEY, row_key())
    return without(kept, twice).unionByName(own.join(twice.toDF(KEY), KEY, "left_semi").dropDuplicates([KEY, "text"]).select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from graphloom.llm.substrings import remove_repeats

    prepare(spark)
    # The other columns travel under names that meet none of the operator's.
    rest = {c: f"rest@{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    kept = remove_repeats(docs.withColumnsRenamed(rest), keep=tuple(rest.values()), original=True).where("n_removed = 0 OR n_removed < n_words")

    def column(c: str):
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(F.col(rest[c]))
        return F.col("kept_text" if c == "text" else rest.get(c, c))

    return kept.select(*[column(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontaminate import agree, matches

    benchmark = read_table(spark, sf_dir, "benchmark")
    keyed = docs.select(text_key().alias("doc_id"), "text")
    return without(docs, agree(matches(keyed, benchmark), keyed, benchmark), text_key())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.packing import pack

    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), scratch_dir(spark))
        discard(before)
    return docs
