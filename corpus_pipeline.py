"""From raw documents to token ids: toxicity, line dedup, near-dedup, mixing and encoding, each stage on what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweir.llm import bpe, common, line_dedup, minhash, mixing, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold. The model learns from the labelled documents among them."""
    model = toxicity.trained(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, with_spans=False).filter(F.col("score") < toxicity.THRESHOLD).select("_row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier documents hold; n_chars follows the text. A document that had a word and has none left was nothing but copies, and goes."""
    words = lambda c: F.length(F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(common.SPACE))) > 0
    left = line_dedup.lines_left(docs)
    left = left.filter(words("_lines.text") | ~words("_row.text"))
    changed = F.col("_lines.n_dropped") > 0
    text = F.when(changed, F.col("_lines.text")).otherwise(F.col("_row.text"))
    chars = F.when(changed, F.char_length("_lines.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    now = {"text": text.alias("text"), "n_chars": chars.alias("n_chars")}
    return left.select(*(now.get(c, common.of("_row", c)) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by a similarity of 80 % or more on five-word shingles."""
    return minhash.near_dedup(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, each as often as it is taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of ids and their digest, and the digest of their decoding."""
    return bpe.digests(docs, bpe.default_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: Training a model can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared folder and read by the next. What a stage has stored for itself is deleted when its result is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = common.mark()
        docs = common.stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        common.sweep(spark, mark, but_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
