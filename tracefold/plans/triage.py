"""Flagship report: which files look packed or carry indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracefold.operators import identity, layout, text_rules

COUNTED = ["urls", "ip_addresses", "emails", "commands", "ransomware_indicators",
           "persistence_indicators", "base64_blobs"]


def triage(files: DataFrame) -> DataFrame:
    """One row per file: route, entropy, category counts and signature hits.

    All of it lies inside one file, so the plan is one scan and one projection:
    nothing is shuffled and content is read once.
    """
    content = F.col("content")
    read = layout.file_entropy(
        identity.route(identity.identify(files)).withColumns({
            "_facts": text_rules.string_facts(content),
            "signatures": F.coalesce(F.size(text_rules.signature_hits(content)).cast("bigint"), F.lit(0))}))
    number = lambda name: F.coalesce(
        F.size(F.filter("_facts", lambda x: x == name)).cast("bigint"), F.lit(0))
    counts = [number(name).alias(name) for name in COUNTED]
    return read.select("file_id", "route", "file_type", "file_entropy", "entropy_class",
                       *counts, "signatures")
