"""Members of zip archives as a table function of SQL: SELECT .. FROM archives, LATERAL zip_members(content)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lithic.sources import zip_members

NAME = "zip_members"


@udtf(returnType="name string, size long, is_pdf boolean, error string", useArrow=True)
class ZipMembers:
    """One row a member from the central directory of an archive or of its end; one row with the error where it cannot be read, none for null."""

    def eval(self, content: bytes):
        if content is None:
            return
        try:
            for name, size in zip_members(bytes(content)):
                yield name, size, name.lower().endswith(".pdf"), None
        except ValueError as x:
            yield None, None, None, f"{type(x).__name__}: {x}"


def register(spark: SparkSession) -> str:
    """Make the function known to a session; gives its name."""
    spark.udtf.register(NAME, ZipMembers)
    return NAME
