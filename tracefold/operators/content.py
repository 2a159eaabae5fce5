"""Byte statistics over chunks of content: partial results per chunk, merged per file.

Counts of byte values add up, windows that cross a border are read from the overlap, and byte
ranges (sections, the overlay) travel to the chunks they touch.  On a bucketed chunk store
those joins move ranges only; no file has to fit into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracefold import rules
from tracefold.functions.bytes import block_sums, byte_counts, range_counts
from tracefold.functions.literals import first_match, raw
from tracefold.sources.chunks import CHUNK


def merged_entropy(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon entropy per key of the sum of 256 counts per row; 0 without bytes.

    Only bytes that occur travel, and byte 0, which keeps keys without bytes.
    """
    totals = (counted.select(*keys, F.posexplode("counts").alias("byte", "c"))
              .where((F.col("c") > 0) | (F.col("byte") == 0))
              .groupBy(*keys, "byte").agg(F.sum("c").alias("c")))
    n, weighted = F.sum("c"), F.sum(F.when(F.col("c") > 0, F.col("c") * F.log2("c")))
    return totals.groupBy(*keys).agg(n.alias("bytes"), F.when(
        n > 0, F.abs(F.log2(n) - weighted / n)).otherwise(0.0).alias("entropy"))


def content_entropy(chunks: DataFrame) -> DataFrame:
    """(file_id, bytes, entropy) of whole files."""
    counts = byte_counts("bytes", F.lit(0).cast("long"), F.col("n"))
    return merged_entropy(chunks.select("file_id", counts.alias("counts")), ["file_id"])


def touched(ranges: DataFrame, size: int) -> DataFrame:
    """One row per range (``low`` to ``high``, not empty) and chunk that it touches."""
    first, last = F.floor(F.col("low") / size), F.floor((F.col("high") - 1) / size)
    return ranges.where(F.col("high") > F.col("low")).withColumn("chunk", F.explode(F.sequence(first, last)))


def section_entropy(chunks: DataFrame, sections: DataFrame, size: int = CHUNK) -> DataFrame:
    """(file_id, seq, entropy) of sections given by ``raw_ptr`` and ``raw_size``.

    Bytes behind the end of the file do not count; a section without bytes has entropy 0.
    """
    low = F.greatest("raw_ptr", F.lit(0)).cast("long")
    spans = sections.select("file_id", "seq", low.alias("low"), (F.col("raw_ptr") + F.col("raw_size")).cast("long").alias("high"))
    asked = (touched(spans, size).groupBy("file_id", "chunk")
             .agg(F.collect_list(F.struct("seq", "low", "high")).alias("spans")))  # section headers of one file
    inside = chunks.join(asked, ["file_id", "chunk"])
    place = lambda end: F.least(F.greatest(end - F.col("offset"), F.lit(0)), F.col("n"))
    spans = F.transform("spans", lambda s: F.struct(
        s["seq"].alias("seq"), place(s["low"]).alias("low"), place(s["high"]).alias("high")))
    counted = range_counts(inside.select("file_id", "bytes", spans.alias("spans")))
    return (sections.select("file_id", "seq").join(merged_entropy(counted, ["file_id", "seq"]), ["file_id", "seq"], "left")
            .select("file_id", "seq", F.round(F.coalesce("entropy", F.lit(0.0)), 4).alias("entropy")))


def overlay(chunks: DataFrame, sections: DataFrame, size: int = CHUNK) -> DataFrame:
    """Data after the last section: offset, size, entropy and embedded payloads."""
    mark = rules.EMBEDDED_PE_MARK
    ends = sections.groupBy("file_id").agg(F.max(F.col("raw_ptr") + F.col("raw_size")).alias("end"))
    files = (chunks.groupBy("file_id").agg(F.max(F.col("offset") + F.col("n")).alias("high"))
             .join(ends, "file_id", "left")
             .withColumn("low", F.greatest(F.coalesce("end", F.lit(0)), F.lit(0)).cast("long")).drop("end"))
    found = F.col("high") - F.col("low") > rules.OVERLAY_MIN
    parts = chunks.join(touched(files.where(found), size), ["file_id", "chunk"])
    start = F.greatest(F.col("low") - F.col("offset"), F.lit(0)).cast("long")
    parts = parts.withColumns({
        "counts": byte_counts("bytes", start, F.col("n")),
        # The mark may reach into the overlap; what begins there belongs to the next chunk.
        "marked": F.contains(F.expr(
            "substring(bytes, cast(greatest(low - offset, 0) + 1 as int), "
            f"cast(n - greatest(low - offset, 0) + {len(mark) // 2 - 1} as int))"), raw(mark)),
        "head": F.when(F.col("low") >= F.col("offset"),
                       F.expr("substring(bytes, cast(low - offset + 1 as int), 16)"))})
    facts = parts.groupBy("file_id").agg(F.bool_or("marked").alias("marked"), F.max("head").alias("head"))
    entropy = merged_entropy(parts.select("file_id", "counts"), ["file_id"])
    archive = first_match([(F.startswith("head", raw(p)), F.lit(k)) for p, k in rules.OVERLAY_ARCHIVES], F.lit("none"))
    shown = F.col("head").isNotNull()
    return (files.join(facts, "file_id", "left").join(entropy, "file_id", "left")
            .select("file_id", shown.alias("has_overlay"),
                    F.when(shown, F.col("high") - F.col("low")).otherwise(0).alias("overlay_size"),
                    F.when(shown, F.col("low")).otherwise(0).alias("overlay_offset"),
                    F.round(F.coalesce("entropy", F.lit(0.0)), 4).alias("overlay_entropy"),
                    F.coalesce(F.startswith("head", raw("4D5A")) | F.col("marked"), F.lit(False)).alias("embedded_pe"),
                    F.when(shown, archive).otherwise("none").alias("archive_detected")))


def byte_chunk_means(chunks: DataFrame) -> DataFrame:
    """Means of all overlapping 512-byte windows, scaled to [0, 1]: (file_id, pos, mean) rows.

    Each window is two neighbouring 256-byte blocks; the second one of a chunk's last window
    comes from the overlap.  Chunks begin at multiples of 256 bytes.  No shuffle.
    """
    stride = rules.CHUNK_STRIDE
    sums = chunks.select("file_id", F.floor(F.col("offset") / stride).alias("_first"), "n",
                         F.octet_length("bytes").alias("_held"), block_sums("bytes", F.lit(stride)).alias("_s"))
    windows = F.ceil(F.col("n") / stride).cast("int")

    def mean(i):
        total = F.element_at("_s", i) + F.coalesce(F.try_element_at("_s", i + 1), F.lit(0))
        length = F.least(F.lit(rules.CHUNK_BYTES), F.col("_held") - (i - 1) * stride)
        return total / length / 255.0

    means = F.when(windows > 0, F.transform(F.sequence(F.lit(1), windows), mean)).otherwise(
        F.array().cast("array<double>"))
    return sums.select("file_id", "_first", F.posexplode(means).alias("_i", "mean")).select(
        "file_id", (F.col("_first") + F.col("_i")).cast("int").alias("pos"), "mean")
