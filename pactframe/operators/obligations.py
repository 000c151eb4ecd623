"""Open obligations with their contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pactframe.functions.columns import day
from pactframe.operators.tenancy import in_scope


def obligations_due(obligations: DataFrame, contracts: DataFrame, as_of, scope: DataFrame | None = None) -> DataFrame:
    """Open obligations; overdue when due before ``as_of``, unassigned without an assignee id.

    With no due date overdue is NULL.  Obligations of unknown contracts drop out.
    """
    names = in_scope(contracts, scope).select(F.col("id").alias("contract_id"), "ref", "supplier")
    return (
        obligations.filter(F.col("status") == "open")
        .join(names, "contract_id")
        .select(
            *[obligations[c] for c in obligations.columns],
            "ref",
            "supplier",
            (F.col("due_date") < day(as_of)).alias("overdue"),
            F.col("assignee_id").isNull().alias("unassigned"),
        )
    )
