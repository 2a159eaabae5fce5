"""Bucket hashes that agree with the published feature layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracefold import rules
from tracefold.functions.literals import let

_CHARS = r"[\s\S]"


def polynomial(text: Column, factor: int, seed: int) -> Column:
    """``h = h * factor + code`` over the characters, wrapped to 32 bits."""
    # An empty string has no characters: extraction gives [] and the seed stays.
    chars = F.regexp_extract_all(text, F.lit(_CHARS), F.lit(0))
    return F.aggregate(
        chars, F.lit(seed).cast("bigint"),
        lambda h, c: (h * factor + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))


def digest_bucket(digest: Column, digits: int, buckets: int) -> Column:
    """Remainder of a hex digest too wide for BIGINT, folded 15 digits at a time."""
    value = F.lit(0).cast("bigint")
    for start in range(0, digits, 15):
        size = min(15, digits - start)
        part = F.conv(F.substring(digest, start + 1, size), 16, 10).cast("bigint")
        value = (value * (16 ** size % buckets) + part % buckets) % buckets
    return value


MD5_DIGITS, SHA1_DIGITS = 32, 40


def buckets_of(text: Column, buckets: int = rules.HASH_BUCKETS) -> Column:
    """The up to three buckets (md5, sha1, polynomial) a text sets to one."""
    raw = F.encode(text, "UTF-8")
    return F.array_distinct(F.array(
        let(F.md5(raw), lambda digest: digest_bucket(digest, MD5_DIGITS, buckets)),
        let(F.sha1(raw), lambda digest: digest_bucket(digest, SHA1_DIGITS, buckets)),
        polynomial(text, 31, 0) % buckets))


def bucket_columns(df: DataFrame, keys: list[str], text: Column,
                   buckets: int = rules.HASH_BUCKETS) -> DataFrame:
    """Keys with the three buckets of a text as columns ``_b0`` to ``_b2``.

    The digests are columns of their own, so each is computed once.
    """
    raw = F.encode("_t", "UTF-8")
    digests = df.select(*keys, text.alias("_t")).select(
        *keys, "_t", F.md5(raw).alias("_m"), F.sha1(raw).alias("_s"))
    return digests.select(
        *keys, digest_bucket(F.col("_m"), MD5_DIGITS, buckets).alias("_b0"),
        digest_bucket(F.col("_s"), SHA1_DIGITS, buckets).alias("_b1"),
        (polynomial(F.col("_t"), 31, 0) % buckets).alias("_b2"))


def clean_api(name: Column) -> Column:
    """Lower case without the DLL prefix before the last ``!``."""
    return F.substring_index(F.lower(name), "!", -1)


def api_token(name: Column) -> Column:
    return (polynomial(clean_api(name), 33, rules.API_HASH_SEED)
            % (rules.API_VOCAB - 1) + 1).cast("int")


def name_ngrams(name: Column, size: int = 3) -> Column:
    """Distinct character n-grams of a cleaned name; a short name stays whole."""
    def cut(clean: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(clean) - (size - 1)),
                            lambda i: F.substr(clean, i, F.lit(size)))
        return F.when(F.length(clean) < size, F.array(clean)).otherwise(
            F.array_distinct(grams))
    return let(clean_api(name), cut)
