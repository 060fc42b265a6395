"""Provider news payloads to headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def parse_payloads(payloads: DataFrame, source: str = "provider") -> DataFrame:
    """Both payload schemas: flat (epoch seconds) and nested under ``content`` (ISO text).

    Items without a title or a time are dropped. A url may be a string or a struct with ``url``.
    """
    field = lambda path: F.get_json_object("payload", path)
    has_content = field("$.content").isNotNull()
    either = lambda name: F.when(has_content, field(f"$.content.{name}")).otherwise(field(f"$.{name}"))

    def link(name):
        as_struct = F.nullif(either(f"{name}.url"), F.lit(""))
        text = either(name)
        as_text = F.when(~text.startswith("{"), F.nullif(text, F.lit("")))
        return F.coalesce(as_struct, as_text)

    epoch = F.try_to_number(field("$.providerPublishTime"), F.lit("9999999999999")).cast("bigint")
    iso = F.try_to_timestamp(F.coalesce(either("pubDate"), either("displayTime")))
    keep = [c for c in payloads.columns if c != "payload"]
    return payloads.select(
        *keep,
        F.coalesce(F.timestamp_seconds(epoch), iso).alias("published_at"),
        either("title").alias("text"),
        F.lit(source).alias("source"),
        F.coalesce(F.nullif(field("$.link"), F.lit("")), link("canonicalUrl"), link("clickThroughUrl"),
                   F.lit("")).alias("url"),
    ).where(F.col("text").isNotNull() & F.col("published_at").isNotNull())
