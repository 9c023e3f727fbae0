"""One filter for both arms of a search, and the check of search requests."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_YEAR = r"^[+-]?[0-9]{1,18}$"


def filled(value: str | None) -> bool:
    return bool(value and value.strip())


@dataclass(frozen=True)
class ArchiveFilter:
    """Optional equalities, all of which must hold; blank ones say nothing. The year is a number written as text."""

    project_name: str | None = None
    volume_name: str | None = None
    item_name: str | None = None
    form_year: str | None = None

    def year(self) -> int | None:
        if not filled(self.form_year):
            return None
        text = self.form_year.strip()
        if not re.fullmatch(_YEAR, text, re.ASCII):
            raise ValueError(f"form_year must be a year such as 2023: {self.form_year}")
        return int(text)

    def predicate(self) -> Column:
        """For any table with the columns that are asked for: plain equalities, which Spark pushes to the scan or prunes partitions by. True without any."""
        names = ("project_name", "volume_name", "item_name")
        parts = [F.col(n) == getattr(self, n) for n in names if filled(getattr(self, n))]
        year = self.year()
        if year is not None:
            parts.append(F.col("form_year") == year)
        return functools.reduce(operator.and_, parts, F.lit(True)) if len(parts) != 1 else parts[0]


def check_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: vector_query, keyword_query, form_year (text) and others. Those that can be searched, with `year` as a number, and the others with a `reason`.

    A request needs a vector or a keyword query that is not blank, and a year that is blank or a number."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    text = F.trim("form_year")
    year = F.when(text.rlike(_YEAR), text.try_cast("bigint"))
    none = blank("vector_query") & blank("keyword_query")
    reason = F.when(none, "a vector or a keyword query is needed").when(~blank("form_year") & year.isNull(), F.concat(F.lit("form_year must be a year such as 2023: "), "form_year"))
    df = requests.withColumns({"year": year, "reason": reason})
    return df.where("reason is null").drop("reason"), df.where("reason is not null").drop("year")
