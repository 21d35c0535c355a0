"""Arithmetic and small text rules of splitting and offsets, as Column expressions.

Every function takes columns or plain numbers, so that the same rule serves a
table of millions of rows and a single planning value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("bigint")


def int_div(a: Column | int, b: Column | int) -> Column:
    """Whole-number quotient (``div`` of SQL)."""
    return F.call_function("div", _col(a), _col(b))


def aligned_job_count(jobs: Column | int, partitions: Column | int) -> Column:
    """The multiple of ``partitions`` that is nearest to ``jobs``.

    A tie goes down, but never below one job per partition.
    """
    jobs, partitions = _col(jobs), _col(partitions)
    over = F.when(partitions > 0, F.try_mod(jobs, partitions))
    goes_down = (over * 2 <= partitions) & (jobs - over >= partitions)
    return (
        F.when(over.isNull() | (over == 0), jobs)
        .when(goes_down, jobs - over)
        .otherwise(jobs - over + partitions)
    )


def even_share_start(job: Column | int, total: Column | int, jobs: Column | int) -> Column:
    """First 0-based ordinal of ``job`` when ``total`` rows are shared out evenly.

    The remainder goes to the front jobs, one row each.
    """
    job, total, jobs = _col(job), _col(total), _col(jobs)
    return job * int_div(total, jobs) + F.least(job, total % jobs)


def even_share_job(ordinal: Column | int, total: Column | int, jobs: Column | int) -> Column:
    """The job of a 0-based ordinal; inverse of :func:`even_share_start`."""
    ordinal, total, jobs = _col(ordinal), _col(total), _col(jobs)
    share, extra = int_div(total, jobs), total % jobs
    front = extra * (share + 1)
    # No row lies behind the front jobs when the share is 0.
    behind = extra + int_div(ordinal - front, F.greatest(share, F.lit(1)))
    return F.when(ordinal < front, int_div(ordinal, share + 1)).otherwise(behind)


def partition_of_job(job: Column | int, partitions: Column | int) -> Column:
    """Jobs go to the partitions in turn."""
    return F.pmod(_col(job), _col(partitions)).cast("int")


def partition_of_ordinal(ordinal: Column | int, partitions: Column | int) -> Column:
    """Rows go to the partitions in turn; ``ordinal`` is 0-based."""
    return F.pmod(_col(ordinal), _col(partitions)).cast("int")


def offset_text(partition: Column, start: Column, end: Column) -> Column:
    """``partition:first:last``; an empty growth reads ``p:100:99``."""
    return F.concat_ws(":", partition.cast("string"), start.cast("string"), (end - 1).cast("string"))


def first_nonempty(preferred: Column, fallback: Column) -> Column:
    """The fallback where the preferred text is null or empty; blanks count as text."""
    return F.coalesce(F.nullif(preferred, F.lit("")), fallback)


def dataset_label(database: Column, table: Column) -> Column:
    return F.concat_ws(":", database, table)


def dataset_description(kind: Column, database: Column, table: Column) -> Column:
    return F.when(
        kind == "series", F.format_string("Measurement '%s' in bucket '%s'", table, database)
    ).otherwise(F.format_string("Collection '%s' in database '%s'", table, database))


def byte_length(value: Column) -> Column:
    return F.octet_length(value).cast("bigint")
