"""Text expressions: cleaning, the product text and the token buckets of the embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the product text, and limits that a caller may ask for.
DESCRIPTION_LIMIT = 500
REVIEWS_LIMIT = 300
PART_SEPARATOR = " | "


def clean_text(text: Column) -> Column:
    """Null becomes ''; whitespace runs become one space, then tags go, then the ends are trimmed."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.trim(F.regexp_replace(spaced, r"<[^>]+>", ""))


def product_text(
    title: Column,
    brand: Column,
    category: Column,
    description: Column,
    reviews: Column,
    description_limit: int | None = None,
    reviews_limit: int | None = None,
) -> Column:
    """The text that stands for a product; parts that are null are left out.

    Description and reviews are whole unless limits are given, such as DESCRIPTION_LIMIT and REVIEWS_LIMIT.
    """

    def part(label: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(label), value))

    if description_limit is not None:
        description = F.when(
            F.char_length(description) > description_limit,
            F.concat(F.left(description, F.lit(description_limit)), F.lit("...")),
        ).otherwise(description)
    if reviews_limit is not None:
        reviews = F.left(reviews, F.lit(reviews_limit))
    return F.concat_ws(
        PART_SEPARATOR,
        part("Title: ", title),
        part("Brand: ", brand),
        part("Category: ", category),
        part("Description: ", description),
        part("Reviews: ", reviews),
    )
