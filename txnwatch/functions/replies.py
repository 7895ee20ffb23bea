"""Reading model replies: nested response JSON and fenced JSON answers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_PATH = "$.candidates[0].content.parts[0].text"


def response_text(response: Column) -> Column:
    return F.get_json_object(response, TEXT_PATH)


def strip_fences(reply: Column) -> Column:
    return F.trim(F.regexp_replace(reply, "```(json)?", ""), F.lit(" \t\r\n"))


def heading_and_summary(
    reply: Column, fallback_heading: Column, fallback_summary: Column
) -> Column:
    """Struct(heading, summary); a part that is missing or empty takes its fallback."""
    parsed = F.from_json(strip_fences(reply), "heading STRING, summary STRING")

    def part(name: str, fallback: Column) -> Column:
        return F.coalesce(F.nullif(parsed[name], F.lit("")), fallback).alias(name)

    return F.struct(part("heading", fallback_heading), part("summary", fallback_summary))
