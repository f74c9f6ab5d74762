"""Messages and queries as records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def images_in(content: Column) -> Column:
    """How many items of a message's JSON content are objects of type image. Content that is no list, or no JSON, has none."""
    items = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")
    found = F.filter(items, lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string") == "image", F.lit(False)))
    return F.coalesce(F.size(found), F.lit(0)).cast("long")
