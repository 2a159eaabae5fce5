"""Value abstraction, vocabulary ids and sub-word tokens over a corpus."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracefold import rules
from tracefold.functions.hashing import api_token
from tracefold.functions.literals import any_of, first_match
from tracefold.operators.ordering import number_rows
from tracefold.operators.subwords import (bpe_decode, bpe_encode, bpe_train, bpe_vocab,  # noqa: F401
                                          spaced, split_identifier, word_counts)
from tracefold.session import shuffle_partitions


def abstract_number(value: Column) -> Column:
    """Token of an unsigned 64-bit or signed integer (``DECIMAL(20,0)``)."""
    value = value.cast("decimal(20,0)")
    big = lambda n: F.lit(Decimal(n))
    magic = [(value == big(n), F.lit(f"<MAGIC_{hex(n)}>")) for n in rules.MAGIC_NUMBERS]
    limit = rules.SMALL_INT_LIMIT
    address = any_of([value.between(big(lo), big(hi)) for lo, hi in rules.ADDRESS_RANGES]
                     + [value >= big(rules.KERNEL_ADDRESS_MIN)])
    return first_match(magic + [
        (value.between(-limit, limit), F.concat(F.lit("<INT_"), value.cast("string"), F.lit(">"))),
        (address, F.lit("<MEM_ADDR>")),
        (value.isNull(), F.lit("<NULL>"))], F.lit("<LARGE_INT>"))


def abstract_string(value: Column) -> Column:
    """Token of a text value; patterns are anchored at the start."""
    clean = F.substring(F.regexp_replace(value, "[^a-zA-Z0-9_]", "_"), 1, 16)
    return first_match([
        (value.isNull(), F.lit("<NULL>")),
        (value.rlike("(?i)^https?://"), F.lit("<URL>")),
        (value.rlike(r"^(?:[A-Za-z]:\\|/[a-z]+/)"), F.lit("<PATH>")),
        (value.rlike(r"(?U)^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), F.lit("<IP_ADDR>")),
        (value.rlike("(?d)^[0-9A-Fa-f]+$") & (F.length(value) > 8), F.lit("<HEX_STRING>")),
        (value.rlike("(?d)^[A-Za-z0-9+/]{20,}={0,2}$"), F.lit("<BASE64>")),
        (F.length(value) <= 16, F.concat(F.lit("<STR_"), clean, F.lit(">")))],
        F.lit("<LONG_STRING>"))


# --- fixed vocabulary -----------------------------------------------------------------

def vocab_table(spark: SparkSession) -> DataFrame:
    """The fixed token list with its ids (299 rows)."""
    tokens = F.array(*[F.lit(t) for t in rules.vocabulary()])
    return spark.range(1).select(F.posexplode(tokens).alias("token_id", "token"))


def encode_tokens(df: DataFrame, column: str = "token") -> DataFrame:
    """Add ``token_id``; an unknown token gets the UNK id."""
    vocab = vocab_table(df.sparkSession).withColumnRenamed("token", column)
    unk = rules.vocabulary().index("<UNK>")
    return (df.join(F.broadcast(vocab), column, "left")
            .withColumn("token_id", F.coalesce("token_id", F.lit(unk))))


def decode_tokens(df: DataFrame, column: str = "token_id") -> DataFrame:
    vocab = vocab_table(df.sparkSession).withColumnRenamed("token_id", column)
    return (df.join(F.broadcast(vocab), column, "left")
            .withColumn("token", F.coalesce("token", F.lit("<UNK>"))))


def integer_token(value: Column) -> Column:
    """Small integers have their own token, others share one."""
    limit = rules.VOCAB_INT_LIMIT
    return F.when(value.between(-limit, limit),
                  F.concat(F.lit("<int>."), value.cast("string"))).otherwise("<LARGE_INT>")


def semantic_id(nodes: DataFrame, repair_operators: bool = False) -> DataFrame:
    """Vocabulary id of a graph node: operator, control, literal, then node type.

    Operator names use their camel-case suffix, which the vocabulary lacks, so
    they give UNK.  ``repair_operators`` maps them to the operator tokens.
    """
    op = F.substring_index("operator_type", ".", -1)
    if repair_operators:
        op = first_match([(op == name, F.lit(kind))
                          for kind, name in rules.OPERATOR_OF_TYPE.items()], op)
    number = F.regexp_extract("value", r"^\s*([+-]?\d{1,38})\s*$", 1)
    literal = F.when(number != "", integer_token(number.cast("decimal(38,0)"))) \
        .otherwise("<UNK>")
    token = first_match([
        (F.col("operator_type").isNotNull(), F.concat(F.lit("<op>."), op)),
        (F.col("control_type").isNotNull(), F.concat(F.lit("<ctrl>."), "control_type")),
        (F.col("type") == "LITERAL", F.coalesce(literal, F.lit("<UNK>")))],
        F.concat(F.lit("<node>."), "type"))
    return encode_tokens(nodes.withColumn("token", token)).withColumnRenamed(
        "token_id", "semantic_id")


# --- sub-words --------------------------------------------------------------------------

def pooled_name_vector(encoded: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Mean of the vectors of all sub-words; zeros when none.

    Vectors have up to ``dim`` values and go to their texts whole, as they are stored: a row per
    value, or a sum and a count for each before the shuffle, would be several times larger.
    """
    held = vectors.select("token_id", "vector").where(F.size("vector") > 0)
    means = [F.avg(F.get("vector", F.lit(i))) for i in range(dim)]
    parts = (encoded.select("text_id", F.explode("token_ids").alias("token_id"))
             .where(F.col("text_id").isNotNull()).join(held, "token_id").select("text_id", "vector")
             .repartition(shuffle_partitions(encoded.sparkSession), "text_id")
             .groupBy("text_id").agg(F.slice(F.array(*means), F.lit(1), F.max(F.size("vector"))).alias("parts")))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (encoded.select("text_id").join(parts, "text_id", "left")
            .select("text_id", F.coalesce("parts", zeros).alias("vector")))


def hash_api_tokens(imports: DataFrame) -> DataFrame:
    """Token id of every named import with its place in the file: (file_id, pos, id)."""
    named = imports.where(F.coalesce("func", F.lit("")) != "")
    placed = number_rows(named.select("file_id", "seq", "func"), ["seq", "func"], ["file_id"], "pos")
    return placed.select("file_id", "pos", api_token(F.col("func")).alias("id"))
