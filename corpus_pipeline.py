"""Raw documents to token ids in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.  A doc_id names
one document: rows that repeat it are copies of that document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.catalog.base import query
from abacist.llm import exact_dedup, jaccard, langid, mixing, pieces
from abacist.llm.common import small, written

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of whose n-grams the language covers less than this are rejected.  Of 2499 labelled held-out
#: documents of sf0.1 none is below 0.58, of their stretches of 1 to 10 words none below 0.41; made-up words of
#: random Latin letters reach 0.27 in 3 words and 0.12 in 20, of Cyrillic or Greek ones 0.01.
LEAST_COVERED = 0.3
NEAR = jaccard.Rule(words=5, percent=80)
#: No SQL: the first stage is a trained model.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: no letters, or n-grams of no language."""
    model = langid.train(docs)
    judged = model.predict(docs, pred="_lang_pred_", score="_lang_score_", covered="_lang_covered_")
    sure = (F.col("_lang_pred_") != langid.UNKNOWN) & (F.col("_lang_covered_") >= LEAST_COVERED)
    return judged.filter(sure).select(*[f"`{c}`" for c in docs.columns])


def _without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """docs without the ids in `drop`, a written table of one column `doc_id`."""
    return docs.join(small(drop), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of repeated rows one."""
    groups = written(exact_dedup.exact_dedup(docs))
    drop = groups.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    repeated = groups.filter("kept AND doc_id IS NOT NULL AND group_size > 1").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    drop, repeated = written(drop), written(repeated)
    once = docs.join(small(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*[f"`{c}`" for c in docs.columns])
    return _without(docs, written(drop.unionByName(repeated))).unionByName(once)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies join, the one with the smallest doc_id stays."""
    found = written(jaccard.jaccard_components(docs, NEAR))
    drop = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return _without(docs, written(drop))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as often as the mix takes them, to whole documents: the last one of a source is in if at least half of it is taken."""
    mixed = mixing.mix(docs).filter("size > 0 AND doc_id IS NOT NULL")
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = mixed.groupBy("doc_id").agg(F.max(times).alias("_times_of_mix_")).filter("_times_of_mix_ > 0")
    joined = docs.join(small(written(taken)), "doc_id")
    return joined.withColumn("_times_of_mix_", F.explode(F.sequence(F.lit(1), F.col("_times_of_mix_")))).select(*[f"`{c}`" for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row: doc_id, source, n_tokens, token_ids, ids_sha256."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), pieces.load(PIECES))
    return encoded.select("doc_id", "source", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "token_ids", "ids_sha256")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def register() -> None:
    query("pipeline", ORACLE_SQL)(run)
