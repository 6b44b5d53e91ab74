"""Client feature table: seven credit tables -> one wide row per client.

Plan shape (K = SK_ID_CURR, B = SK_ID_BUREAU, P = SK_ID_PREV)::

    bureau_balance --groupBy(B)--> loan sums --join(B) bureau ids--groupBy(K)--+
    bureau --------------------------------------------groupBy(K)--------------+-inner(K)-> bureau block
    previous_application --groupBy(K)--+
    POS_CASH_balance -----groupBy(K)---+-left(K) fold driven by previous apps -> history block
    installments --join(P)----groupBy(K)-+
    credit_card  --join(P)----groupBy(K)-+
    current_app (encoded) -left(K)- bureau block -left(K)- history block

Every aggregation that shares a key and an input is one ``groupBy``: the
numeric roll-up, the category counts and the hand-made credit features of
a table are computed in the same pass.  All client-level sides come out of
an aggregation hash-partitioned on K, so the final joins are co-partitioned
and add no shuffle.  Payment histories keyed by P meet the P -> K bridge as
narrow rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.constants import DAYS_PAST_DUE, NON_DPD_STATUSES, STATUS_CODES
from riskfold.operators.aggregate import (aggregate_through, agg_numeric_exprs, count_categorical_exprs, gathered,
                                          numeric_feature_columns)
from riskfold.operators.credit import (LOAN_TYPE_COLUMNS, AggBlock, BureauRoles, bureau_manual_block, loan_block,
                                       loan_length_columns, loan_rollup_constant_columns, loan_rollup_inputs,
                                       loan_rollup_numeric_columns, run_block)
from riskfold.operators.encode import CategoryEncoding

CLIENT = "SK_ID_CURR"
LOAN = "SK_ID_BUREAU"
PREV = "SK_ID_PREV"


@dataclass
class FeaturePlan:
    """Parameters of the client feature plan.

    ``vocabulary`` maps table -> column -> categories (declared or fitted).
    ``installments_name`` is the prefix the installment features are
    published under; the original model contract uses the credit card
    prefix for them, which is kept as the default.
    """
    vocabulary: dict[str, dict[str, list[str]]]
    roles: BureauRoles = field(default_factory=BureauRoles)
    status_codes: list[str] = field(default_factory=lambda: list(STATUS_CODES))
    installments_name: str = "credit_card_balance"
    bureau_how: str = "inner"
    driver_block: str = "previous_application"  # whose clients the history block holds

    def vocab(self, table: str) -> dict[str, list[str]]:
        return self.vocabulary.get(table, {})


# --- bureau_balance -> per loan ------------------------------------------------

def loan_features(bureau_balance: DataFrame, plan: FeaturePlan) -> DataFrame:
    """One row per loan (loans without any status are dropped)."""
    return run_block(bureau_balance, LOAN, loan_block(codes=plan.status_codes), gather=True)


def _status_hits(plan: FeaturePlan) -> dict[tuple[str, str], str]:
    """(column, category) -> the per-loan count of it, for all that :func:`loan_columns` needs."""
    wanted = [(c, v) for c, values in plan.vocab("bureau_balance").items() for v in values]
    wanted += [("STATUS", v) for v in (*plan.status_codes, *NON_DPD_STATUSES, *DAYS_PAST_DUE)]
    return {at: f"_hits{i}" for i, at in enumerate(dict.fromkeys(wanted))}


def loan_level(bureau_balance: DataFrame, plan: FeaturePlan) -> DataFrame:
    """One pass over the monthly history per loan: the counts and month sums that
    the generic numeric and category roll-ups and the loan block follow from
    (:func:`loan_columns`).  They are a third as many as the columns, and
    moved in their place."""
    month = F.col("MONTHS_BALANCE")
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count(month).alias("_months"), F.sum(month).alias("_month_sum"),
            F.max(month).alias("_last_month"), F.min(month).alias("_first_month"), F.count("STATUS").alias("_n_status")]
    aggs += [F.count_if(F.col(c) == F.lit(v)).alias(name) for (c, v), name in _status_hits(plan).items()]
    return run_block(bureau_balance, LOAN, AggBlock(aggs), gather=True)


def loan_columns(loans: DataFrame, plan: FeaturePlan) -> DataFrame:
    """:func:`loan_level` rows with the generic columns (``bureau_balance_*``) and the
    columns of the loan block; its HAVING becomes the ``_has_status`` flag so both
    roll-ups can be taken from the same rows."""
    n, total, rows, first = (F.col(c) for c in ("_months", "_month_sum", "_rows", "_first_month"))
    hits = {at: F.col(name) for at, name in _status_hits(plan).items()}
    stats = {"count": n, "mean": F.when(n > 0, total / n), "max": F.col("_last_month"), "min": first,
             "sum": F.coalesce(total, F.lit(0))}
    cols = {f"bureau_balance_MONTHS_BALANCE_{s}": v for s, v in stats.items()}
    for c, values in plan.vocab("bureau_balance").items():
        for v in values:
            cols[f"bureau_balance_{c}_{v}_count"] = hits[c, v]
            cols[f"bureau_balance_{c}_{v}_count_norm"] = hits[c, v] / rows
    known = sum((hits["STATUS", v] for v in DAYS_PAST_DUE), F.lit(0))
    days = sum((hits["STATUS", v] * d for v, d in DAYS_PAST_DUE.items()), F.lit(0))
    cols["DPD_FLAG"] = rows - sum((hits["STATUS", v] for v in NON_DPD_STATUSES), F.lit(0))
    cols["MEAN_DAYS_PAST_DUE"] = F.when(known > 0, days / known)
    cols.update({f"{c}_y": hits["STATUS", c] for c in plan.status_codes})
    cols.update(loan_length_columns(n, first))
    cols["_has_status"] = F.col("_n_status") > 0
    return loans.withColumns(cols)


def _generic_loan_columns(plan: FeaturePlan) -> list[str]:
    cols = [f"bureau_balance_MONTHS_BALANCE_{s}" for s in ("count", "mean", "max", "min", "sum")]
    for c, values in plan.vocab("bureau_balance").items():
        for v in values:
            cols += [f"bureau_balance_{c}_{v}_count", f"bureau_balance_{c}_{v}_count_norm"]
    return cols


def client_loan_rollups(loans: DataFrame, bureau: DataFrame, plan: FeaturePlan,
                        generic: bool = True, manual: bool = True) -> DataFrame:
    """J19 (``client_*``) and J20 (``client_bureau_balance_*``) per client.

    ``loans`` is :func:`loan_level` output.  J20 only uses loans that have a
    status (the original inner merge); a client needs at least one such
    loan when ``manual`` is requested.
    """
    ids = bureau.select(CLIENT, LOAN)
    rows = loan_columns(gathered(loans.join(ids, LOAN, "inner").where(F.col(CLIENT).isNotNull()), CLIENT), plan)
    aggs = []
    finals = {}
    if generic:
        aggs += agg_numeric_exprs(_generic_loan_columns(plan), "client")
    having = None
    if manual:
        keep = F.col("_has_status")
        n = F.col("_n_loans_with_status")
        constant = set(loan_rollup_constant_columns(plan.status_codes))
        for c in loan_rollup_numeric_columns(plan.status_codes):
            name = f"client_bureau_balance_{c}"
            if c in constant:
                # a column that is 0 on every loan: its five statistics follow
                # from the loan count alone, no aggregate needed
                finals.update({f"{name}_count": n, f"{name}_mean": F.when(n > 0, F.lit(0.0)),
                               f"{name}_max": F.when(n > 0, F.lit(0)), f"{name}_min": F.when(n > 0, F.lit(0)),
                               f"{name}_sum": F.lit(0).cast("long")})
                continue
            v = F.when(keep, F.col(c))
            aggs += [F.count(v).alias(f"{name}_count"), F.when(F.count(v) > 0, F.sum(v) / F.count(v)).alias(f"{name}_mean"),
                     F.max(v).alias(f"{name}_max"), F.min(v).alias(f"{name}_min"),
                     F.coalesce(F.sum(v), F.lit(0)).alias(f"{name}_sum")]
        aggs.append(F.count_if(keep).alias("_n_loans_with_status"))
        having = n > 0
    return run_block(rows, CLIENT, AggBlock(aggs, having=having, finals=finals,
                                            drop=["_n_loans_with_status"] if manual else []))


# --- bureau -> per client ------------------------------------------------------

def bureau_client(bureau: DataFrame, plan: FeaturePlan, generic: bool = True, manual: bool = True) -> DataFrame:
    """J18 (``bureau_*`` numeric + category roll-ups) fused with J9-J17."""
    blocks = []
    if generic:
        blocks.append(AggBlock(agg_numeric_exprs(numeric_feature_columns(bureau, CLIENT), "bureau")
                               + count_categorical_exprs(plan.vocab("bureau"), "bureau")))
    if manual:
        v = plan.vocab("bureau")
        blocks.append(bureau_manual_block(v.get(plan.roles.status, []), v.get(plan.roles.credit_type, []),
                                          plan.roles))
    return run_block(bureau, CLIENT, *blocks, gather=True)


def bureau_block(tables: dict[str, DataFrame], plan: FeaturePlan) -> DataFrame:
    """Bureau roll-ups joined with the monthly-history roll-ups.

    Inner by default, as in the original: a client without monthly history
    loses all bureau features (the completeness guard of the original is
    this inner join's own behaviour on an empty side)."""
    loans = loan_level(tables["bureau_balance"], plan)
    per_client_loans = client_loan_rollups(loans, tables["bureau"], plan)
    return bureau_client(tables["bureau"], plan).join(per_client_loans, CLIENT, plan.bureau_how)


# --- histories keyed by client or by previous loan -----------------------------

def client_history(df: DataFrame, name: str, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Numeric + category roll-up of a client-keyed history in one pass."""
    return run_block(df, CLIENT, AggBlock(agg_numeric_exprs(numeric_feature_columns(df, CLIENT), name)
                                          + count_categorical_exprs(vocabulary, name)), gather=True)


HISTORIES = ("previous_application", "POS_CASH_balance", "installments_payments", "credit_card_balance")


def history_block(tables: dict[str, DataFrame], plan: FeaturePlan) -> DataFrame:
    """Left fold of the four history roll-ups, driven by ``plan.driver_block``.

    A history that carries the client key is grouped by it; one that has only
    the previous loan is rolled up through the bridge."""
    names = {"installments_payments": plan.installments_name}

    def block(table: str) -> DataFrame:
        df, name = tables[table], names.get(table, table)
        if CLIENT in df.columns:
            return client_history(df, name, plan.vocab(table))
        return aggregate_through(df, PREV, tables["prev_to_client"], CLIENT, name, vocabulary=plan.vocab(table))

    order = sorted(HISTORIES, key=lambda table: table != plan.driver_block)
    return reduce(lambda left, right: left.join(right, CLIENT, "left"), map(block, order))


# --- the whole table -----------------------------------------------------------

def encode_application(app: DataFrame, plan: FeaturePlan) -> DataFrame:
    return CategoryEncoding.from_vocabulary(plan.vocab("current_app")).transform(app)


def client_features(tables: dict[str, DataFrame], plan: FeaturePlan) -> DataFrame:
    """Encoded client rows, left-enriched with the bureau block and the
    history block.  One row per client of ``current_app``."""
    app = encode_application(tables["current_app"], plan)
    return (app.join(bureau_block(tables, plan), CLIENT, "left")
               .join(history_block(tables, plan), CLIENT, "left"))


def prefixed_loan_rollup(bureau_balance: DataFrame, bureau: DataFrame, plan: FeaturePlan) -> DataFrame:
    """Per client, ``MEAN_*`` of the loan durations / delays and
    ``SUM_*`` of the status and loan-type counts, over loans with a status.
    (Computed but not used by the original's final table.)"""
    codes = plan.status_codes
    loans = loan_rollup_inputs(loan_features(bureau_balance, plan).join(bureau.select(CLIENT, LOAN), LOAN),
                               codes)
    buckets = [c for c in codes if c.isdigit() and c != "0"]
    means = ["MONTHS_LOAN_DURATION", "DPD_FLAG", *buckets, "MEAN_DAYS_PAST_DUE", "YEAR_LOAN_DURATION"]
    sums = [f"STATUS_{c}" for c in codes] + ["DPD_FLAG", *buckets, *LOAN_TYPE_COLUMNS]
    aggs = [F.avg(c).alias(f"MEAN_{c}") for c in means] + [F.coalesce(F.sum(c), F.lit(0)).alias(f"SUM_{c}")
                                                             for c in sums]
    return run_block(loans, CLIENT, AggBlock(aggs))
