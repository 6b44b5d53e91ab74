"""Credit-history feature blocks as aggregate-expression builders.

Each block is a list of aggregate expressions over one grouping key plus an
optional HAVING condition, so blocks that share a key are *fused into one
``groupBy``* (one shuffle) instead of being computed separately and joined
back, which is what a pandas merge-fold does.

Blocks
------
loan block (J1-J8)       per loan, over the monthly history
bureau manual (J9-J17)   per client, over the loans
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.constants import (DAYS_PAST_DUE, LOAN_TYPE_LONG, LOAN_TYPE_SHORT, LONG_TERM_YEARS,
                                NON_DPD_STATUSES, STATUS_CODES)
from riskfold.functions.expressions import first_match, map_values, not_in
from riskfold.operators.aggregate import coded_value_at_latest, gathered


@dataclass
class AggBlock:
    """Aggregates over one key: ``aggs`` inside the groupBy, ``having`` on
    its output, ``finals`` computed from the aggregated columns, ``drop``
    helper columns removed at the end."""
    aggs: list[Column]
    having: Column | None = None
    finals: dict[str, Column] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)


def run_block(df: DataFrame, key: str, *blocks: AggBlock, gather: bool = False) -> DataFrame:
    """Evaluate one or more blocks over the same key with a single groupBy;
    ``gather``: the statistics are far wider than the rows, which are brought together first."""
    aggs = [a for b in blocks for a in b.aggs]
    rows = df.where(F.col(key).isNotNull())
    out = (gathered(rows, key) if gather else rows).groupBy(key).agg(*aggs)
    for b in blocks:
        if b.having is not None:
            out = out.where(b.having)
    finals = {k: v for b in blocks for k, v in b.finals.items()}
    if finals:
        out = out.withColumns(finals)
    drops = [d for b in blocks for d in b.drop]
    return out.drop(*drops) if drops else out


# --- J1-J8: one row per loan from its monthly status history -----------------

LOAN_TYPE_COLUMNS = [f"LOAN_TYPE_{LOAN_TYPE_LONG}", f"LOAN_TYPE_{LOAN_TYPE_SHORT}"]


def loan_length_columns(months: Column, first_month: Column) -> dict[str, Column]:
    """What the loan block says of a loan's length, from its months on record and the first of them."""
    years = F.bround(first_month / F.lit(-12.0), 1)
    long_term = F.coalesce(years >= LONG_TERM_YEARS, F.lit(False))
    return {"MONTHS_LOAN_DURATION": months, "YEAR_LOAN_DURATION": years,
            LOAN_TYPE_COLUMNS[0]: long_term.cast("int"), LOAN_TYPE_COLUMNS[1]: (~long_term).cast("int")}


def loan_block(month: str = "MONTHS_BALANCE", status: str = "STATUS",
               codes: list[str] = STATUS_CODES) -> AggBlock:
    """Per-loan features of the monthly history.

    MONTHS_LOAN_DURATION  months on record (non-null month count)
    STATUS                last known status (at the latest month)
    {code}_x              0 for every code: the original frame of the last
                          status carries these constant columns into the
                          merge, where they meet the counts below
    DPD_FLAG              months whose status is not C/X/0 (null counts)
    {code}_y              months in each status
    MEAN_DAYS_PAST_DUE    mean of the status mapped to days past due
    YEAR_LOAN_DURATION    earliest month / -12, rounded half-even to 0.1
    LOAN_TYPE_*           long term (>= 5 years) / short term indicator

    A loan whose statuses are all null has no status counts and drops out.
    """
    st = F.col(status)
    last_status, decode_status = coded_value_at_latest(status, month, codes)
    aggs = [F.count(month).alias("MONTHS_LOAN_DURATION"),
            last_status.alias("_last_status"),
            F.sum(not_in(st, NON_DPD_STATUSES).cast("int")).alias("DPD_FLAG"),
            F.count(status).alias("_n_status")]
    aggs += [F.count_if(st == F.lit(c)).alias(f"{c}_y") for c in codes]
    aggs += [F.avg(map_values(st, DAYS_PAST_DUE).cast("double")).alias("MEAN_DAYS_PAST_DUE"),
             F.min(month).alias("_first_month")]
    lengths = loan_length_columns(F.col("MONTHS_LOAN_DURATION"), F.col("_first_month"))
    finals = {"STATUS": decode_status(F.col("_last_status"))}
    finals.update({f"{c}_x": F.lit(0) for c in codes})
    finals.update({c: v for c, v in lengths.items() if c != "MONTHS_LOAN_DURATION"})
    return AggBlock(aggs, having=F.col("_n_status") > 0, finals=finals,
                    drop=["_n_status", "_first_month", "_last_status"])


def loan_block_columns(codes: list[str] = STATUS_CODES) -> list[str]:
    """Output order of :func:`loan_block` (as in the original merge)."""
    return (["MONTHS_LOAN_DURATION", "STATUS"] + [f"{c}_x" for c in codes] + ["DPD_FLAG"]
            + [f"{c}_y" for c in codes] + ["MEAN_DAYS_PAST_DUE", "YEAR_LOAN_DURATION"] + LOAN_TYPE_COLUMNS)


def loan_rollup_inputs(df: DataFrame, codes: list[str] = STATUS_CODES) -> DataFrame:
    """Per-loan frame as it enters the client roll-up: the loan block plus
    the constant columns the original adds when the bare codes and the
    ``STATUS_{code}`` dummies are missing after the merge."""
    extra = {c: F.lit(0) for c in codes}
    extra.update({f"STATUS_{c}": F.lit(0) for c in codes})
    return df.withColumns(extra)


def loan_rollup_constant_columns(codes: list[str] = STATUS_CODES) -> list[str]:
    """Columns of the per-loan frame that are constant 0 (merge artefacts)."""
    return [f"{c}_x" for c in codes] + list(codes) + [f"STATUS_{c}" for c in codes]


def loan_rollup_numeric_columns(codes: list[str] = STATUS_CODES) -> list[str]:
    cols = [c for c in loan_block_columns(codes) if c != "STATUS"]
    return cols + list(codes) + [f"STATUS_{c}" for c in codes]


# --- J9-J17: manual bureau features per client -------------------------------

@dataclass
class BureauRoles:
    """Column roles of the loan table (credit names by default)."""
    status: str = "CREDIT_ACTIVE"
    credit_type: str = "CREDIT_TYPE"
    max_overdue: str = "AMT_CREDIT_MAX_OVERDUE"
    sum_overdue: str = "AMT_CREDIT_SUM_OVERDUE"
    prolong: str = "CNT_CREDIT_PROLONG"
    debt: str = "AMT_CREDIT_SUM_DEBT"
    total: str = "AMT_CREDIT_SUM"
    end_date: str = "DAYS_CREDIT_ENDDATE"
    day_overdue: str = "CREDIT_DAY_OVERDUE"
    active_value: str = "Active"


def proportion_repaid(debt: Column, total: Column) -> Column:
    """Share of the credit repaid from summed debt and credit.

    both zero -> 1; negative debt -> 1; debt on zero credit -> 0;
    positive credit -> 1 - debt/credit; otherwise null.
    """
    return first_match([
        ((total == 0) & (debt == 0), F.lit(1.0)),
        (debt < 0, F.lit(1.0)),
        ((total == 0) & (debt > 0), F.lit(0.0)),
        (total > 0, F.lit(1.0) - debt / total),
    ])


def bureau_manual_block(status_values: list[str], type_values: list[str],
                        roles: BureauRoles = BureauRoles()) -> AggBlock:
    """J9-J16 per client; J17's inner merge is the HAVING condition: a client
    needs a non-null loan status and a non-null credit amount."""
    r = roles
    st, total = F.col(r.status), F.col(r.total)
    aggs = [F.count_if(st == F.lit(v)).alias(v) for v in status_values]
    aggs += [F.count_if(F.col(r.credit_type) == F.lit(v)).alias(f"{r.credit_type}_{v}") for v in type_values]
    debt_filled = F.when(total.isNotNull(), F.coalesce(F.col(r.debt), total))
    aggs += [
        F.max(F.coalesce(F.col(r.max_overdue), F.lit(0))).alias(r.max_overdue),
        F.avg(r.sum_overdue).alias(r.sum_overdue),
        F.coalesce(F.sum(r.prolong), F.lit(0)).alias(r.prolong),
        F.sum(debt_filled).alias(r.debt),
        F.sum(total).alias(r.total),
        F.count_if((st == F.lit(r.active_value)) & (F.col(r.end_date) < 0)).alias("LOAN_ACTIVE_PAST_DEADLINE"),
        F.avg(r.day_overdue).alias(r.day_overdue),
        F.count(r.status).alias("_n_status"),
        F.count(r.total).alias("_n_total"),
    ]
    finals = {"PROPORTION_REPAID": proportion_repaid(F.col(r.debt), F.col(r.total))}
    return AggBlock(aggs, having=(F.col("_n_status") > 0) & (F.col("_n_total") > 0), finals=finals,
                    drop=["_n_status", "_n_total"])


def bureau_manual_columns(status_values: list[str], type_values: list[str],
                          roles: BureauRoles = BureauRoles()) -> list[str]:
    r = roles
    return (list(status_values) + [f"{r.credit_type}_{v}" for v in type_values]
            + [r.max_overdue, r.sum_overdue, r.prolong, r.debt, r.total, "PROPORTION_REPAID",
               "LOAN_ACTIVE_PAST_DEADLINE", r.day_overdue])
