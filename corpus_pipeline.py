"""A corpus pipeline of five stages; each calls one operator of the ``llm`` subpackage.

Every stage but the last returns the columns of ``documents`` for the rows it
keeps.  ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again as the next one's input.

Defined cases, of all stages: a row is decided by itself, whether its id is null,
repeated or shared with other texts, because each stage that has to find rows
again gives them a written key of its own; null and empty texts are texts
without words; texts of any length are used whole; an empty table gives an empty
table; further columns are kept whatever their names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm import decontaminate as _decontaminate
from twinweave.llm import mixing, quality, simhash, tokenfile
from twinweave.llm.common import written
from twinweave.llm.queries import table, tokenizer_path
from twinweave.storage import made, release


#: Work folders of the stages that were called, as far as their tables may still be read.
_used: set[int] = set()


def _stage(function):
    """A stage that first removes what the stages before it wrote on their way and nothing reads any more.

    A stage's rows may be computed at any time, before or after other stages are
    called: the tables that they are read from stay as long as a plan has them.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _used.difference_update(release(_used))
        begun = made()
        out = function(spark, docs, sf_dir)
        _used.update(range(begun, made()))
        return out

    return run_stage


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written once with a key of their own under a name that no column has, and that name."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with numbers for column names, so that none can have the name of a result, and these names."""
    names = [f"d{n}" for n in range(len(docs.columns))]
    return docs.toDF(*names), names


def _kept(keyed: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among keys, without the key."""
    return keyed.join(keys.select(key), key, "left_semi").drop(key)


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go.  Each row is scored by its own text; of
    equal texts all stay or all go; a null text is scored as the empty one.  Rows
    pass the scoring whole, so nothing is shuffled."""
    numbered, names = _numbered(docs)
    rows = numbered.select("*", F.col(names[docs.columns.index("doc_id")]).alias("doc_id"))
    scores = quality.quality_scores(rows, table(spark, sf_dir, "labels"), text=names[docs.columns.index("text")], keep=tuple(names))
    return scores.where("predicted = 1").select(*names).toDF(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: of the smallest id (null last) the
    smallest row key.  Rows that share an id but are unlike both stay; texts
    without words are one group."""
    keyed, key = _keyed(docs)
    found = simhash.near_duplicates(keyed, row=key)
    return _kept(keyed, key, found.where(F.col(key) == F.col("component_row")))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; a text without words is not contaminated, and
    equal rows all stay or all go."""
    numbered, names = _numbered(docs)
    marked = _decontaminate.decontaminate(
        numbered, table(spark, sf_dir, "benchmark"), keep=tuple(names), text=names[docs.columns.index("text")])
    return marked.where("not contaminated").select(*names).toDF(*docs.columns)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix has it; its quality weight is the score of the
    classifier, learned from the labelled rows of the whole ``documents`` table.
    Null sources are one source; equal rows are dealt copies one by one."""
    keyed, key = _keyed(docs)
    labels = table(spark, sf_dir, "labels")
    model = quality.train(table(spark, sf_dir, "documents"), labels)
    weighed = quality.quality_scores(keyed, labels, keep=("text", "source", key), model=model)
    copies = mixing.mix(weighed, row=key, weight="score").where("copies > 0").select(key, F.col("copies").alias("n"))
    # the number of copies travels beside the whole row, whose columns may have any name
    rows = keyed.select(F.col(key), F.struct(*docs.columns).alias("whole")).join(copies, key)
    return rows.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("whole.*")


@_stage
def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-packed token files in order of id (null first), read back: one row for
    each row, repeated ones in order of text; a null text has the end id alone."""
    return tokenfile.tokens_written_and_read(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_file),
]

#: The classifier, SimHash and BPE stages have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the rows that the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
