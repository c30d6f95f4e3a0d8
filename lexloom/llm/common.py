"""Shared helpers of the llm operators: table access, checkpoints, word rules."""

from __future__ import annotations

import os
import tempfile

import regex
from pyspark.sql import DataFrame, SparkSession

#: The spellings of the palochka after lower-casing, and the letter they stand for.
PALOCHKA = "ӏ"
PALOCHKA_FOLD = {ord("ӏ"): "ӏ", ord("Ӏ"): "ӏ", ord("1"): "ӏ", ord("i"): "ӏ"}
WORD = regex.compile(r"[\p{L}\p{N}]+")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased, palochkas folded."""
    return WORD.findall(text.lower().translate(PALOCHKA_FOLD))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only where none is named (tests) a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexloom-ckpt-"))


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through reliable storage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def opaque(df: DataFrame) -> DataFrame:
    """The same lazy rows behind a plan that the optimiser can recognise twice.

    An exchange above Python code is not reused in a self-join, as the outputs of the two
    copies get different ids; over this leaf both sides read one exchange.
    """
    spark = df.sparkSession
    jdf = df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def tokenizer_dir() -> str:
    """Folder of the public vocabulary files; LEXLOOM_TOKENIZERS overrides the default."""
    return os.environ.get("LEXLOOM_TOKENIZERS", "/opt/tokenizers")
