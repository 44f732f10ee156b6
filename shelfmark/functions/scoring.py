"""The preference score of one copy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions.text import contains_any, is_blank


def preference_score(*, status: Column, catalog_status: Column, catalog_name: Column,
                     file_name: Column, revision: Column, extension: Column,
                     excluded: Column, manual: Column) -> Column:
    name = F.coalesce(catalog_name, file_name)
    base = (F.when(manual, V.SCORE_MANUAL)
            .when(catalog_status == "Verified", V.SCORE_VERIFIED).otherwise(0))
    region = (F.when(contains_any(name, V.TOP_REGION_TAGS), V.SCORE_TOP_REGION)
              .when(contains_any(name, ["(Europe)"]), V.SCORE_EUROPE)
              .when(contains_any(name, ["(Japan)"]), V.SCORE_JAPAN).otherwise(0))
    extras = (F.when(~is_blank(revision), V.SCORE_REVISION).otherwise(0)
              + F.when(contains_any(name, V.UNFINISHED_TAGS), V.SCORE_UNFINISHED).otherwise(0)
              + F.when(status == "Corrupt", V.SCORE_CORRUPT).otherwise(0)
              + F.when(F.lower(extension) == ".zip", V.SCORE_ZIP).otherwise(0))
    return (F.when(excluded | (status == "Missing"), V.SCORE_INELIGIBLE)
            .otherwise(base + region + extras).cast("int"))
