"""Web pages as files: addresses are modules, links are imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import suffixes


def hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, href): every quoted link, as written."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def module_keys(pages: DataFrame) -> DataFrame:
    """(page_id, candidates): the address without scheme and query, then its suffixes."""
    address = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return pages.select("page_id", F.concat(F.array(address), suffixes(address, "/")).alias("candidates"))
