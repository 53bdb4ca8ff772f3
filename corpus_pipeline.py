"""A corpus pipeline: toxic documents go, then those without a language, then near copies; personal data is masked; what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept, from a Parquet table. All stages but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import language, nearcopies, packing, pii, toxicity
from packetloom.llm.common import documents, small_batches, written
from packetloom.operators.joins import lookup

#: A document of so many characters that needs more phrases a character than this is in none of the languages.
NOISE_RATE, NOISE_CHARS = 0.6, 40
#: Against less labelled text than this, in characters, rates are high for any text, and none is called noise.
NOISE_SAMPLE = 10_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    small_batches(spark)
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.trained(spark, docs, sf_dir))
    return scored.filter(F.col("toxic_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no language go: those without a letter, and longer ones that fit none of the learned languages, as noise and other scripts do.

    Those need over NOISE_RATE phrases a character in every language; text of the languages needs less than half of that. Shorter ones stay, and so do all that have a letter where labelled text is missing or short.
    """
    small_batches(spark)
    sample = language.labelled_sample(docs.filter(~language.held_out(docs["doc_id"], 3, 1)), "lang", "text")
    found = language.identify(docs.select(*COLUMNS), sample or {"any": "a"}, rate="phrase_rate")
    noise = F.lit(sum(map(len, sample.values())) >= NOISE_SAMPLE) & (F.col("phrase_rate") > NOISE_RATE) & (F.length("text") >= NOISE_CHARS)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & ~noise).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row stays: that with the smallest id, nulls last, of several such that with the smallest hash."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    found = written(nearcopies.near_copies(docs), "components")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = written(lookup(found, written(first, "first"), ["root"], "inner").filter("row <> first.row").select("row").distinct(), "gone")
    # rows that agree in all columns share a hash; of those one stays
    repeated = written(found.groupBy("row").count().filter("count > 1").select("row").join(gone, "row", "left_anti"), "repeated")
    hashed = docs.withColumn("row", nearcopies.row_hash(docs))
    once = hashed.join(repeated, "row", "left_semi").select(*COLUMNS).distinct()
    return hashed.join(gone.union(repeated), "row", "left_anti").select(*COLUMNS).union(once)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows."""
    small_batches(spark)
    return pii.mask(docs.select(*COLUMNS), pii.trained()).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_without_language),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
