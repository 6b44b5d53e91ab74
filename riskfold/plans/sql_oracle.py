"""ANSI-SQL formulations of the plans, for an independent engine (DuckDB).

Used only to cross-check the DataFrame plans: each function returns a SQL
string over the given tables (the credit binding comes first as CTEs).  The
SQL is written independently of the DataFrame code -- windows instead of
``max_by``, CASE instead of maps -- and shares only column lists.
"""

from __future__ import annotations

from riskfold.constants import DAYS_PAST_DUE, LONG_TERM_YEARS, NON_DPD_STATUSES, STATUS_CODES
from riskfold.operators.credit import LOAN_TYPE_COLUMNS, loan_block_columns, loan_rollup_numeric_columns
from riskfold.sources.binding import ACTIVE_LOAN_STATUS, binding_sql, binding_vocabulary

# Numeric columns of the bound tables and whether they are integral.
NUMERIC = {
    "bureau": {"DAYS_CREDIT": "int", "DAYS_CREDIT_ENDDATE": "int", "CREDIT_DAY_OVERDUE": "int",
               "AMT_CREDIT_MAX_OVERDUE": "double", "CNT_CREDIT_PROLONG": "int", "AMT_CREDIT_SUM": "double",
               "AMT_CREDIT_SUM_DEBT": "double", "AMT_CREDIT_SUM_OVERDUE": "double"},
    "bureau_balance": {"MONTHS_BALANCE": "int"},
    "previous_application": {"AMT_APPLICATION": "double", "DAYS_DECISION": "int"},
    "POS_CASH_balance": {"MONTHS_BALANCE": "int", "CNT_INSTALMENT": "int", "AMT_POS_VALUE": "double"},
    "installments_payments": {"NUM_INSTALMENT_NUMBER": "int", "DAYS_INSTALMENT": "int",
                              "AMT_INSTALMENT": "double", "AMT_PAYMENT": "double"},
    "credit_card_balance": {"MONTHS_BALANCE": "int", "AMT_DRAWINGS": "double", "RATE_TAX": "double"},
}

ALL_BOUND = ["current_app", "client_labels", "bureau", "bureau_balance", "previous_application",
             "POS_CASH_balance", "installments_payments", "credit_card_balance", "prev_to_client"]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(v: str) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def numeric_stats_sql(col: str, kind: str, name: str, filt: str | None = None) -> list[str]:
    c = q(col) if filt is None else f"CASE WHEN {filt} THEN {q(col)} END"
    total = f"sum({c})" + ("::BIGINT" if kind == "int" else "")
    zero = "0::BIGINT" if kind == "int" else "0.0::DOUBLE"
    return [f"count({c})::BIGINT AS {q(name + '_count')}",
            f"avg({c})::DOUBLE AS {q(name + '_mean')}",
            f"max({c}) AS {q(name + '_max')}",
            f"min({c}) AS {q(name + '_min')}",
            f"coalesce({total}, {zero}) AS {q(name + '_sum')}"]


def agg_numeric_select(table: str, df_name: str) -> list[str]:
    out = []
    for c, kind in NUMERIC[table].items():
        out += numeric_stats_sql(c, kind, f"{df_name}_{c}")
    return out


def count_categorical_select(vocab: dict[str, list[str]], df_name: str) -> list[str]:
    out = []
    for c, values in vocab.items():
        for v in values:
            hit = f"CASE WHEN {q(c)} = {lit(v)} THEN 1 ELSE 0 END"
            out += [f"sum({hit})::BIGINT AS {q(f'{df_name}_{c}_{v}_count')}",
                    f"avg({hit})::DOUBLE AS {q(f'{df_name}_{c}_{v}_count_norm')}"]
    return out


def group_sql(table: str, key: str, select: list[str], having: str | None = None) -> str:
    sql = f"SELECT {q(key)}, " + ", ".join(select) + f" FROM {table} WHERE {q(key)} IS NOT NULL GROUP BY {q(key)}"
    return sql + (f" HAVING {having}" if having else "")


# --- individual operators -------------------------------------------------------

def agg_numeric_sql(table: str, key: str, df_name: str) -> str:
    return binding_sql(ALL_BOUND) + "\n" + group_sql(table, key, agg_numeric_select(table, df_name))


def count_categorical_sql(table: str, key: str, df_name: str) -> str:
    vocab = binding_vocabulary()[table]
    return binding_sql(ALL_BOUND) + "\n" + group_sql(table, key, count_categorical_select(vocab, df_name))


def _dpd_days_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {lit(k)} THEN {v}" for k, v in DAYS_PAST_DUE.items()) + " END"


def loan_block_cte(codes=STATUS_CODES, with_generic: bool = False) -> str:
    """CTEs ``last_status`` and ``loans`` (one row per loan, all loans,
    with ``has_status``)."""
    non_dpd = ", ".join(lit(s) for s in NON_DPD_STATUSES)
    cols = ["count(MONTHS_BALANCE)::BIGINT AS MONTHS_LOAN_DURATION",
            f"sum(CASE WHEN STATUS IN ({non_dpd}) THEN 0 ELSE 1 END)::BIGINT AS DPD_FLAG"]
    cols += [f"count(*) FILTER (WHERE STATUS = {lit(c)})::BIGINT AS {q(c + '_y')}" for c in codes]
    cols += [f"avg({_dpd_days_case('STATUS')})::DOUBLE AS MEAN_DAYS_PAST_DUE",
             "round_even(min(MONTHS_BALANCE) / -12.0, 1) AS YEAR_LOAN_DURATION",
             "count(STATUS) > 0 AS has_status"]
    if with_generic:
        cols += agg_numeric_select("bureau_balance", "bureau_balance")
        cols += count_categorical_select(binding_vocabulary()["bureau_balance"], "bureau_balance")
    long_term = f"coalesce(h.YEAR_LOAN_DURATION >= {LONG_TERM_YEARS}, false)"
    return f"""
    last_status AS (
        SELECT SK_ID_BUREAU, max(STATUS) AS STATUS FROM (
            SELECT SK_ID_BUREAU, STATUS, MONTHS_BALANCE,
                   max(MONTHS_BALANCE) OVER (PARTITION BY SK_ID_BUREAU) AS last_month
            FROM bureau_balance WHERE STATUS IS NOT NULL AND SK_ID_BUREAU IS NOT NULL) t
        WHERE MONTHS_BALANCE = last_month OR last_month IS NULL
        GROUP BY SK_ID_BUREAU),
    loan_hist AS ({group_sql('bureau_balance', 'SK_ID_BUREAU', cols)}),
    loans AS (
        SELECT h.*, l.STATUS, {', '.join(f'0::INTEGER AS {q(c + "_x")}' for c in codes)},
               CASE WHEN {long_term} THEN 1 ELSE 0 END::INTEGER AS {q(LOAN_TYPE_COLUMNS[0])},
               CASE WHEN {long_term} THEN 0 ELSE 1 END::INTEGER AS {q(LOAN_TYPE_COLUMNS[1])}
        FROM loan_hist h LEFT JOIN last_status l USING (SK_ID_BUREAU))"""


def loan_features_sql(codes=STATUS_CODES) -> str:
    cols = ", ".join(q(c) for c in loan_block_columns(codes))
    return (binding_sql(ALL_BOUND) + "," + loan_block_cte(codes)
            + f"\nSELECT SK_ID_BUREAU, {cols} FROM loans WHERE has_status")


def _generic_loan_cols() -> list[tuple[str, str]]:
    out = [(f"bureau_balance_MONTHS_BALANCE_{s}", "int" if s in ("count", "max", "min", "sum") else "double")
           for s in ("count", "mean", "max", "min", "sum")]
    for c, values in binding_vocabulary()["bureau_balance"].items():
        for v in values:
            out += [(f"bureau_balance_{c}_{v}_count", "int"), (f"bureau_balance_{c}_{v}_count_norm", "double")]
    return out


def _manual_loan_cols(codes=STATUS_CODES) -> list[tuple[str, str]]:
    dbl = {"MEAN_DAYS_PAST_DUE", "YEAR_LOAN_DURATION"}
    return [(c, "double" if c in dbl else "int") for c in loan_rollup_numeric_columns(codes)]


def client_loan_rollups_cte(generic: bool = True, manual: bool = True, codes=STATUS_CODES) -> str:
    consts = ", ".join([f"0::INTEGER AS {q(c)}" for c in codes] + [f"0::INTEGER AS {q('STATUS_' + c)}" for c in codes])
    sel = []
    if generic:
        for c, kind in _generic_loan_cols():
            sel += numeric_stats_sql(c, kind, f"client_{c}")
    having = None
    if manual:
        for c, kind in _manual_loan_cols(codes):
            sel += numeric_stats_sql(c, kind, f"client_bureau_balance_{c}", filt="has_status")
        having = "count(*) FILTER (WHERE has_status) > 0"
    return f"""
    loan_rows AS (SELECT b.SK_ID_CURR, l.*, {consts}
                  FROM loans l JOIN (SELECT SK_ID_CURR, SK_ID_BUREAU FROM bureau) b USING (SK_ID_BUREAU)),
    client_loans AS ({group_sql('loan_rows', 'SK_ID_CURR', sel, having)})"""


def client_loan_rollups_sql(generic: bool = True, manual: bool = True) -> str:
    return (binding_sql(ALL_BOUND) + "," + loan_block_cte(with_generic=generic) + ","
            + client_loan_rollups_cte(generic, manual) + "\nSELECT * FROM client_loans")


def _proportion_repaid(debt: str, total: str) -> str:
    return (f"CASE WHEN {total} = 0 AND {debt} = 0 THEN 1.0 WHEN {debt} < 0 THEN 1.0 "
            f"WHEN {total} = 0 AND {debt} > 0 THEN 0.0 WHEN {total} > 0 THEN 1.0 - {debt} / {total} END")


def bureau_client_cte(generic: bool = True, manual: bool = True) -> str:
    vocab = binding_vocabulary()["bureau"]
    sel = []
    if generic:
        sel += agg_numeric_select("bureau", "bureau") + count_categorical_select(vocab, "bureau")
    having = None
    if manual:
        sel += [f"count(*) FILTER (WHERE CREDIT_ACTIVE = {lit(v)})::BIGINT AS {q(v)}" for v in vocab["CREDIT_ACTIVE"]]
        sel += [f"count(*) FILTER (WHERE CREDIT_TYPE = {lit(v)})::BIGINT AS {q('CREDIT_TYPE_' + v)}"
                for v in vocab["CREDIT_TYPE"]]
        sel += ["max(coalesce(AMT_CREDIT_MAX_OVERDUE, 0)) AS AMT_CREDIT_MAX_OVERDUE",
                "avg(AMT_CREDIT_SUM_OVERDUE)::DOUBLE AS AMT_CREDIT_SUM_OVERDUE",
                "coalesce(sum(CNT_CREDIT_PROLONG)::BIGINT, 0) AS CNT_CREDIT_PROLONG",
                "sum(CASE WHEN AMT_CREDIT_SUM IS NOT NULL THEN coalesce(AMT_CREDIT_SUM_DEBT, AMT_CREDIT_SUM) END)"
                " AS AMT_CREDIT_SUM_DEBT",
                "sum(AMT_CREDIT_SUM) AS AMT_CREDIT_SUM",
                f"count(*) FILTER (WHERE CREDIT_ACTIVE = {lit(ACTIVE_LOAN_STATUS)} AND DAYS_CREDIT_ENDDATE < 0)::BIGINT"
                " AS LOAN_ACTIVE_PAST_DEADLINE",
                "avg(CREDIT_DAY_OVERDUE)::DOUBLE AS CREDIT_DAY_OVERDUE"]
        having = "count(CREDIT_ACTIVE) > 0 AND count(AMT_CREDIT_SUM) > 0"
    inner = group_sql("bureau", "SK_ID_CURR", sel, having)
    if manual:
        inner = (f"SELECT *, {_proportion_repaid('AMT_CREDIT_SUM_DEBT', 'AMT_CREDIT_SUM')} AS PROPORTION_REPAID "
                 f"FROM ({inner}) m")
    return f"\n    bureau_client AS ({inner})"


def bureau_client_sql(generic: bool = True, manual: bool = True) -> str:
    return binding_sql(ALL_BOUND) + "," + bureau_client_cte(generic, manual) + "\nSELECT * FROM bureau_client"


def bureau_block_cte() -> str:
    return (loan_block_cte(with_generic=True) + "," + client_loan_rollups_cte() + "," + bureau_client_cte()
            + ",\n    bureau_block AS (SELECT * FROM bureau_client JOIN client_loans USING (SK_ID_CURR))")


def bureau_block_sql() -> str:
    return binding_sql(ALL_BOUND) + "," + bureau_block_cte() + "\nSELECT * FROM bureau_block"


def history_block_cte(installments_name: str = "credit_card_balance") -> str:
    v = binding_vocabulary()

    def direct(table: str) -> str:
        return group_sql(table, "SK_ID_CURR", agg_numeric_select(table, table)
                         + count_categorical_select(v[table], table))

    def through(table: str, name: str) -> str:
        sel = agg_numeric_select(table, name) + count_categorical_select(v[table], name)
        return group_sql(f"(SELECT t.*, b.SK_ID_CURR FROM {table} t JOIN prev_to_client b USING (SK_ID_PREV))",
                         "SK_ID_CURR", sel)

    return f"""
    h_prev AS ({direct('previous_application')}),
    h_pos AS ({direct('POS_CASH_balance')}),
    h_inst AS ({through('installments_payments', installments_name)}),
    h_card AS ({through('credit_card_balance', 'credit_card_balance')}),
    history_block AS (SELECT * FROM h_prev LEFT JOIN h_pos USING (SK_ID_CURR)
                      LEFT JOIN h_inst USING (SK_ID_CURR) LEFT JOIN h_card USING (SK_ID_CURR))"""


def history_block_sql() -> str:
    return binding_sql(ALL_BOUND) + "," + history_block_cte() + "\nSELECT * FROM history_block"


def encoded_app_cte() -> str:
    vocab = binding_vocabulary()["current_app"]
    sel = ["SK_ID_CURR", "REGION_CODE", "NATION_CODE"]
    for c, values in vocab.items():
        values = sorted(values)
        if len(values) <= 2:
            sel.append("CASE " + " ".join(f"WHEN {q(c)} = {lit(x)} THEN {i}" for i, x in enumerate(values))
                       + f" END::BIGINT AS {q(c)}")
        else:
            sel += [f"CASE WHEN {q(c)} = {lit(x)} THEN 1.0 ELSE 0.0 END::DOUBLE AS {q(c + '_' + x)}" for x in values]
    return f"\n    app AS (SELECT {', '.join(sel)} FROM current_app)"


def encoded_app_sql() -> str:
    return binding_sql(ALL_BOUND) + "," + encoded_app_cte() + "\nSELECT * FROM app"


def client_features_sql() -> str:
    return (binding_sql(ALL_BOUND) + "," + encoded_app_cte() + "," + bureau_block_cte() + ","
            + history_block_cte()
            + "\nSELECT * FROM app LEFT JOIN bureau_block USING (SK_ID_CURR) LEFT JOIN history_block USING (SK_ID_CURR)")


# --- profiles --------------------------------------------------------------------

def _client_features_body() -> str:
    return (binding_sql(ALL_BOUND) + "," + encoded_app_cte() + "," + bureau_block_cte() + ","
            + history_block_cte()
            + ",\n    cf AS (SELECT * FROM app LEFT JOIN bureau_block USING (SK_ID_CURR) "
              "LEFT JOIN history_block USING (SK_ID_CURR))")


def missing_values_sql() -> str:
    return (_client_features_body() + """,
    m AS (SELECT count(*) AS __rows, COLUMNS(*) FROM (SELECT 1))""").replace(
        "m AS (SELECT count(*) AS __rows, COLUMNS(*) FROM (SELECT 1))",
        "m AS (SELECT count(*) AS __rows, count(*) - count(COLUMNS(*)) FROM cf)") + """
    SELECT feature, missing_values, round_even(missing_values * 100.0::DOUBLE / __rows, 2) AS percentage
    FROM (UNPIVOT m ON COLUMNS(* EXCLUDE (__rows)) INTO NAME feature VALUE missing_values)
    WHERE missing_values > 0"""


def numeric_profile_sql(table: str) -> str:
    cols = list(NUMERIC[table])
    casts = ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in cols)
    return (binding_sql(ALL_BOUND) + f"""
    SELECT feature, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, min(v) AS min, max(v) AS max
    FROM (UNPIVOT (SELECT {casts} FROM {table}) ON {', '.join(q(c) for c in cols)} INTO NAME feature VALUE v)
    GROUP BY feature""")


def distinct_counts_sql(table: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {lit(c)} AS feature, count(DISTINCT {q(c)})::BIGINT AS n_unique FROM {table}" for c in columns)
    return binding_sql(ALL_BOUND) + "\n" + parts


def top_values_sql(table: str, column: str, n: int) -> str:
    return (binding_sql(ALL_BOUND) + f"\nSELECT {q(column)}, count(*)::BIGINT AS count FROM {table} "
            f"WHERE {q(column)} IS NOT NULL GROUP BY {q(column)} ORDER BY count DESC, {q(column)} LIMIT {n}")


def application_overview_sql(top: int = 5) -> str:
    return binding_sql(ALL_BOUND) + f""",
    n AS (SELECT count(*) AS rows FROM current_app),
    m AS (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM current_app) ON COLUMNS(*) INTO NAME feature VALUE missing),
    l AS (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM current_app) ON COLUMNS(*) INTO NAME feature VALUE x),
    kinds AS (UNPIVOT (SELECT typeof(COLUMNS(*)) FROM current_app LIMIT 1) ON COLUMNS(*) INTO NAME feature VALUE kind),
    c AS (SELECT feature, x, count(*) AS k FROM l GROUP BY feature, x),
    t AS (SELECT feature, x, k, row_number() OVER (PARTITION BY feature ORDER BY k DESC, x) AS place FROM c),
    s AS (SELECT feature, string_agg(x || ': ' || k, ', ' ORDER BY place) AS top_values FROM t WHERE place <= {top} GROUP BY feature)
    SELECT m.feature, kind = 'VARCHAR' AS is_text, rows, missing, (SELECT count(*) FROM c WHERE c.feature = m.feature) AS n_unique,
           CASE WHEN kind = 'VARCHAR' THEN top_values END AS top_values
    FROM m JOIN kinds USING (feature) LEFT JOIN s USING (feature), n"""


def label_balance_sql() -> str:
    return binding_sql(ALL_BOUND) + "\nSELECT TARGET, count(*)::BIGINT AS count FROM client_labels GROUP BY TARGET"


# --- sampling ----------------------------------------------------------------------

def sample_sql(table: str, fraction: float, seed: int = 42) -> str:
    from riskfold.operators.sample import hash_uniform_sql
    ctes = f""",
    s_clients AS (SELECT * FROM current_app WHERE {hash_uniform_sql(['SK_ID_CURR'], seed)} < {fraction!r}),
    s_bureau AS (SELECT * FROM bureau WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM s_clients)),
    s_prev AS (SELECT * FROM previous_application WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM s_clients))"""
    body = {
        "current_app": "SELECT * FROM s_clients",
        "bureau_balance": "SELECT * FROM bureau_balance WHERE SK_ID_BUREAU IN (SELECT SK_ID_BUREAU FROM s_bureau)",
        "installments_payments": """SELECT t.*, b.SK_ID_CURR FROM installments_payments t
            JOIN prev_to_client b USING (SK_ID_PREV)
            WHERE b.SK_ID_CURR IN (SELECT SK_ID_CURR FROM s_clients)
               OR t.SK_ID_PREV IN (SELECT SK_ID_PREV FROM s_prev)""",
        "POS_CASH_balance": """SELECT * FROM POS_CASH_balance
            WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM s_clients) OR SK_ID_PREV IN (SELECT SK_ID_PREV FROM s_prev)""",
    }[table]
    return binding_sql(ALL_BOUND) + ctes + "\n" + body


def split_ctes(seed: int = 42) -> str:
    """splits(SK_ID_CURR, TARGET, split): the first fifth of each class in draw order is test."""
    from riskfold.constants import TEST_FRACTION
    from riskfold.operators.sample import salted_sql
    return f""",
    drawn AS (SELECT SK_ID_CURR, TARGET, count(*) OVER (PARTITION BY TARGET) AS size,
                     row_number() OVER (PARTITION BY TARGET ORDER BY {salted_sql(["SK_ID_CURR"], "split", seed)}) AS nth
              FROM client_labels WHERE TARGET IS NOT NULL),
    splits AS (SELECT SK_ID_CURR, TARGET,
                      CASE WHEN nth <= floor(size * {TEST_FRACTION!r} + 0.5) THEN 'test' ELSE 'train' END AS split FROM drawn)"""


def fold_select(table: str, seed: int = 42) -> str:
    from riskfold.constants import CV_FOLDS
    from riskfold.operators.sample import salted_sql
    return (f"SELECT SK_ID_CURR, TARGET, CAST((row_number() OVER (PARTITION BY TARGET ORDER BY "
            f"{salted_sql(['SK_ID_CURR'], 'fold', seed)}) - 1) % {CV_FOLDS} AS INTEGER) AS fold FROM {table}")


def split_sql(kind: str, seed: int = 42) -> str:
    if kind == "split":
        return binding_sql(ALL_BOUND) + split_ctes(seed) + "\nSELECT SK_ID_CURR, TARGET, split FROM splits"
    return binding_sql(ALL_BOUND) + "\n" + fold_select("client_labels WHERE TARGET IS NOT NULL", seed)


def train_fold_sizes_sql() -> str:
    """The rule itself, without draws: a class of n clients has round(n / 5) test
    ones; fold f of the rest has one more than their third where f is below the
    remainder."""
    from riskfold.constants import CV_FOLDS, TEST_FRACTION
    return binding_sql(ALL_BOUND) + f""",
    sizes AS (SELECT TARGET, CAST(count(*) - floor(count(*) * {TEST_FRACTION!r} + 0.5) AS BIGINT) AS n
              FROM client_labels GROUP BY TARGET)
    SELECT TARGET, CAST(fold AS INTEGER) AS fold,
           CAST(n // {CV_FOLDS} + CASE WHEN fold < n % {CV_FOLDS} THEN 1 ELSE 0 END AS BIGINT) AS clients
    FROM sizes, range({CV_FOLDS}) AS r(fold)"""


# --- selection -----------------------------------------------------------------------

def bureau_client_feature_names() -> list[str]:
    from riskfold.operators.credit import bureau_manual_columns
    vocab = binding_vocabulary()["bureau"]
    names = [f"bureau_{c}_{s}" for c in NUMERIC["bureau"] for s in ("count", "mean", "max", "min", "sum")]
    for c, values in vocab.items():
        for v in values:
            names += [f"bureau_{c}_{v}_count", f"bureau_{c}_{v}_count_norm"]
    return names + bureau_manual_columns(vocab["CREDIT_ACTIVE"], vocab["CREDIT_TYPE"])


#: Decimals to which features are compared in rankings and drift.
COMPARED_DIGITS = 6


def _table_ctes() -> str:
    """CTEs ending in ``d``: key, label ``y``, split and every feature of the client
    feature table as a double; ``fi`` numbers the features by name."""
    return binding_sql(ALL_BOUND) + split_ctes() + "," + encoded_app_cte() + "," + bureau_block_cte() + "," + history_block_cte() + f""",
    cf AS (SELECT * FROM app LEFT JOIN bureau_block USING (SK_ID_CURR) LEFT JOIN history_block USING (SK_ID_CURR)),
    d AS MATERIALIZED (SELECT SK_ID_CURR, TARGET AS y, split, round(CAST(COLUMNS(* EXCLUDE (SK_ID_CURR, TARGET, split)) AS DOUBLE), {COMPARED_DIGITS})
                       FROM cf JOIN splits USING (SK_ID_CURR)),
    fi AS MATERIALIZED (SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS i
           FROM (UNPIVOT (SELECT count(COLUMNS(* EXCLUDE (SK_ID_CURR, y, split))) FROM d) ON COLUMNS(*) INTO NAME feature VALUE n)),
    cells AS MATERIALIZED (UNPIVOT d ON COLUMNS(* EXCLUDE (SK_ID_CURR, y, split)) INTO NAME feature VALUE x)"""


def spearman_target_sql() -> str:
    return _table_ctes() + """,
    ranked AS (SELECT feature,
        rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry
        FROM cells WHERE split = 'train')
    SELECT feature, rho, abs(rho) AS abs_rho FROM (
        SELECT feature, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho
        FROM ranked GROUP BY feature)"""


# --- evaluation ------------------------------------------------------------------------

def _scores_cte() -> str:
    return """,
    scores AS (SELECT l.SK_ID_CURR, l.TARGET, coalesce(b.bad_share, 0.0) AS score
               FROM client_labels l LEFT JOIN (
                   SELECT SK_ID_CURR, avg(CASE WHEN CREDIT_ACTIVE = 'P' THEN 1.0 ELSE 0.0 END)::DOUBLE AS bad_share
                   FROM bureau GROUP BY SK_ID_CURR) b USING (SK_ID_CURR))"""


def _sweep_cte() -> str:
    from riskfold.constants import COST_FN, COST_FP, COST_TN
    from riskfold.operators.evaluate import threshold_grid
    values = ", ".join(f"({i}, {t!r})" for i, t in enumerate(threshold_grid()))
    return _scores_cte() + f""",
    grid AS (SELECT CAST(i AS INTEGER) AS threshold_index, CAST(t AS DOUBLE) AS threshold FROM (VALUES {values}) g(i, t)),
    sweep_counts AS (
        SELECT threshold_index, threshold,
               count(*) FILTER (WHERE TARGET = 0 AND NOT coalesce(score >= threshold, false))::BIGINT AS tn,
               count(*) FILTER (WHERE TARGET = 0 AND coalesce(score >= threshold, false))::BIGINT AS fp,
               count(*) FILTER (WHERE TARGET = 1 AND NOT coalesce(score >= threshold, false))::BIGINT AS fn,
               count(*) FILTER (WHERE TARGET = 1 AND coalesce(score >= threshold, false))::BIGINT AS tp
        FROM grid, scores GROUP BY threshold_index, threshold),
    sweep AS (SELECT *, (fn * {COST_FN} + fp * {COST_FP} + tn * {COST_TN})::BIGINT AS business_cost FROM sweep_counts),
    best AS (SELECT * FROM sweep ORDER BY business_cost, threshold_index LIMIT 1)"""


def threshold_sweep_sql() -> str:
    return binding_sql(ALL_BOUND) + _sweep_cte() + "\nSELECT * FROM sweep"


def best_threshold_sql() -> str:
    return binding_sql(ALL_BOUND) + _sweep_cte() + "\nSELECT * FROM best"


def classification_report_sql() -> str:
    def div(a, b):
        return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"

    p1, r1, p0, r0 = div("tp", "tp + fp"), div("tp", "tp + fn"), div("tn", "tn + fn"), div("tn", "tn + fp")

    def f1(p, r):
        return f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"

    return binding_sql(ALL_BOUND) + _sweep_cte() + f"""
    SELECT {div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {f1(p1, r1)} AS f1_score,
           {p0} AS precision_0, {r0} AS recall_0, {f1(p0, r0)} AS f1_0,
           {p1} AS precision_1, {r1} AS recall_1, {f1(p1, r1)} AS f1_1
    FROM best"""


def roc_auc_sql() -> str:
    return binding_sql(ALL_BOUND) + _scores_cte() + """,
    r AS (SELECT TARGET, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk
          FROM scores WHERE score IS NOT NULL)
    SELECT CASE WHEN n1 > 0 AND n0 > 0 THEN (s1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) END::DOUBLE AS roc_auc
    FROM (SELECT sum(rk) FILTER (WHERE TARGET = 1) AS s1, count(*) FILTER (WHERE TARGET = 1)::DOUBLE AS n1,
                 count(*) FILTER (WHERE TARGET = 0)::DOUBLE AS n0 FROM r)"""


def business_cost_sql(threshold: float) -> str:
    from riskfold.constants import COST_FN, COST_FP, COST_TN
    pred = f"coalesce(score >= {threshold!r}, false)"
    return binding_sql(ALL_BOUND) + _scores_cte() + f"""
    SELECT tn, fp, fn, tp, (fn * {COST_FN} + fp * {COST_FP} + tn * {COST_TN})::BIGINT AS business_cost FROM (
        SELECT count(*) FILTER (WHERE TARGET = 0 AND NOT {pred})::BIGINT AS tn,
               count(*) FILTER (WHERE TARGET = 0 AND {pred})::BIGINT AS fp,
               count(*) FILTER (WHERE TARGET = 1 AND NOT {pred})::BIGINT AS fn,
               count(*) FILTER (WHERE TARGET = 1 AND {pred})::BIGINT AS tp FROM scores)"""


def prefixed_loan_rollup_sql(codes=STATUS_CODES) -> str:
    buckets = [c for c in codes if c.isdigit() and c != "0"]
    consts = ", ".join([f"0::INTEGER AS {q(c)}" for c in codes] + [f"0::INTEGER AS {q('STATUS_' + c)}" for c in codes])
    means = ["MONTHS_LOAN_DURATION", "DPD_FLAG", *buckets, "MEAN_DAYS_PAST_DUE", "YEAR_LOAN_DURATION"]
    sums = [f"STATUS_{c}" for c in codes] + ["DPD_FLAG", *buckets, *LOAN_TYPE_COLUMNS]
    sel = [f"avg({q(c)})::DOUBLE AS {q('MEAN_' + c)}" for c in means]
    sel += [f"coalesce(sum({q(c)})::BIGINT, 0) AS {q('SUM_' + c)}" for c in sums]
    return (binding_sql(ALL_BOUND) + "," + loan_block_cte(codes) + f""",
    lr AS (SELECT b.SK_ID_CURR, l.*, {consts}
           FROM loans l JOIN (SELECT SK_ID_CURR, SK_ID_BUREAU FROM bureau) b USING (SK_ID_BUREAU) WHERE has_status)
    """ + group_sql("lr", "SK_ID_CURR", sel))


def _spearman_body() -> str:
    return spearman_target_sql().replace("\n    SELECT feature, rho, abs(rho) AS abs_rho FROM (",
                                         ",\n    sp AS MATERIALIZED (SELECT feature, rho, abs(rho) AS abs_rho FROM (", 1) + ")"


def top_bottom_correlated_sql(n: int = 10) -> str:
    return _spearman_body() + f"""
    SELECT * FROM (SELECT feature, rho, abs_rho, 'top' AS side FROM sp WHERE rho IS NOT NULL
                   ORDER BY rho DESC, feature LIMIT {n})
    UNION ALL
    SELECT * FROM (SELECT feature, rho, abs_rho, 'bottom' AS side FROM sp WHERE rho IS NOT NULL
                   ORDER BY rho ASC, feature LIMIT {n})"""


def _correlated_pairs_ctes(threshold: float) -> str:
    """CTEs after ``_table_ctes`` ending in ``cp``: feature pairs (order of names) whose
    pairwise-complete Spearman correlation exceeds ``threshold`` in size.

    Features with the same null rows share a pattern; the common rows of two patterns are
    one ranking problem, and a correlation is the inner product of unit rank vectors."""
    return f"""
    train_cells AS MATERIALIZED (SELECT SK_ID_CURR AS k, fi.i, x FROM cells JOIN fi USING (feature) WHERE split = 'train'),
    patterns AS MATERIALIZED (SELECT i, min(i) OVER (PARTITION BY rows_of) AS g
                              FROM (SELECT i, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS rows_of FROM train_cells GROUP BY i)),
    there AS (SELECT i AS g, k FROM train_cells WHERE i IN (SELECT g FROM patterns)),
    common AS MATERIALIZED (SELECT a.g AS ga, b.g AS gb, a.k FROM there a JOIN there b ON a.k = b.k AND a.g <= b.g),
    ranks AS (SELECT ga, gb, c.i, g, c.k,
                     rank() OVER (PARTITION BY ga, gb, c.i ORDER BY x) + (count(*) OVER (PARTITION BY ga, gb, c.i, x) - 1) / 2.0 AS r
              FROM common JOIN train_cells c USING (k) JOIN patterns p ON p.i = c.i AND p.g IN (ga, gb)),
    centred AS (SELECT *, r - avg(r) OVER (PARTITION BY ga, gb, i) AS z FROM ranks),
    vectors AS MATERIALIZED (SELECT ga, gb, i, g, list(z ORDER BY k) AS v, sqrt(sum(z * z)) AS length
                             FROM centred GROUP BY ga, gb, i, g HAVING max(z) > min(z)),
    cp AS MATERIALIZED (SELECT * FROM (
        SELECT fa.feature AS feature_i, fb.feature AS feature_j, a.i AS i, b.i AS j,
               list_inner_product(a.v, b.v) / (a.length * b.length) AS rho
        FROM vectors a JOIN vectors b ON a.ga = b.ga AND a.gb = b.gb AND a.i < b.i AND (a.ga = a.gb OR a.g <> b.g)
        JOIN fi fa ON fa.i = a.i JOIN fi fb ON fb.i = b.i)
        WHERE abs(rho) > {threshold!r})"""


def correlated_pairs_sql(threshold: float) -> str:
    return _table_ctes() + "," + _correlated_pairs_ctes(threshold) + "\nSELECT * FROM cp"


def drift_sql(bins: int = 10, eps: float = 1e-4, seed: int = 42) -> str:
    qs = ", ".join(repr(i / bins) for i in range(1, bins))
    return (_table_ctes() + f""",
    long AS (SELECT split, feature, x FROM d UNPIVOT INCLUDE NULLS (x FOR feature IN (COLUMNS(* EXCLUDE (SK_ID_CURR, y, split))))),
    edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [{qs}]))) AS edges
              FROM long WHERE split = 'train' AND x IS NOT NULL GROUP BY feature),
    binned AS (SELECT l.split, l.feature, l.x,
                      CASE WHEN l.x IS NOT NULL THEN len(list_filter(e.edges, lambda v: l.x > v)) END AS bin
               FROM long l LEFT JOIN edges e USING (feature)),
    totals AS (SELECT split, feature, count(x) AS nn, count(*) AS rows FROM binned GROUP BY split, feature),
    shares AS (SELECT b.split, b.feature, b.bin, count(*) / max(t.nn) AS share, 1 - max(t.nn) / max(t.rows) AS null_rate
               FROM binned b JOIN totals t USING (split, feature) WHERE b.bin IS NOT NULL
               GROUP BY b.split, b.feature, b.bin),
    r AS (SELECT * FROM shares WHERE split = 'train'),
    c AS (SELECT * FROM shares WHERE split = 'test'),
    both_ AS (SELECT coalesce(r.feature, c.feature) AS feature,
                     greatest(coalesce(r.share, 0.0), {eps!r}) AS pr, greatest(coalesce(c.share, 0.0), {eps!r}) AS pc,
                     r.null_rate AS nr, c.null_rate AS nc
              FROM r FULL JOIN c ON r.feature = c.feature AND r.bin = c.bin)
    SELECT feature, sum((pc - pr) * ln(pc / pr))::DOUBLE AS psi, max(nr)::DOUBLE AS null_rate_reference,
           max(nc)::DOUBLE AS null_rate_current, (max(nc) - max(nr))::DOUBLE AS null_rate_diff
    FROM both_ GROUP BY feature""")


def baseline_cost_sql(seed: int = 42) -> str:
    from riskfold.constants import COST_FN, COST_FP, COST_TN
    from riskfold.operators.sample import hash_uniform_sql
    u = hash_uniform_sql(["SK_ID_CURR"], seed, "baseline")
    return binding_sql(ALL_BOUND) + f""",
    p AS (SELECT SK_ID_CURR, TARGET,
                 CASE WHEN {u} < (SELECT avg(TARGET) FROM client_labels) THEN 1 ELSE 0 END AS prediction
          FROM client_labels)
    SELECT tn, fp, fn, tp, (fn * {COST_FN} + fp * {COST_FP} + tn * {COST_TN})::BIGINT AS business_cost FROM (
        SELECT count(*) FILTER (WHERE TARGET = 0 AND prediction = 0)::BIGINT AS tn,
               count(*) FILTER (WHERE TARGET = 0 AND prediction = 1)::BIGINT AS fp,
               count(*) FILTER (WHERE TARGET = 1 AND prediction = 0)::BIGINT AS fn,
               count(*) FILTER (WHERE TARGET = 1 AND prediction = 1)::BIGINT AS tp FROM p)"""


def selected_features_sql(threshold: float) -> str:
    """Greedy pruning (K5) as a recursive walk over the features in order.

    For a feature i still kept when it is visited, every later linked
    feature that is still kept is dropped when i's target correlation is at
    least its own; i itself is dropped when any of them is stronger."""
    return (_spearman_body() + "," + _correlated_pairs_ctes(threshold) + f""",
    tc AS MATERIALIZED (SELECT fi.feature, fi.i, coalesce(round(sp.abs_rho, 12), 0.0) AS c FROM fi LEFT JOIN sp USING (feature)),
    later AS (SELECT cp.i, list({{'fj': cp.feature_j, 'weaker': a.c >= b.c}}) AS links
              FROM cp JOIN tc a ON a.i = cp.i JOIN tc b ON b.i = cp.j GROUP BY cp.i),
    steps AS MATERIALIZED (SELECT tc.i, tc.feature, coalesce(later.links, []) AS links FROM tc LEFT JOIN later USING (i)),
    walk AS (SELECT * FROM (WITH RECURSIVE w(k, dropped) AS (
        SELECT 0, []::VARCHAR[]
        UNION ALL
        SELECT w.k + 1,
               CASE WHEN list_contains(w.dropped, s.feature) THEN w.dropped
                    ELSE list_concat(w.dropped,
                         list_concat(list_transform(list_filter(s.links, lambda x: NOT list_contains(w.dropped, x.fj)
                                                                               AND x.weaker), lambda x: x.fj),
                                     CASE WHEN len(list_filter(s.links, lambda x: NOT list_contains(w.dropped, x.fj)
                                                                              AND NOT x.weaker)) > 0
                                          THEN [s.feature] ELSE []::VARCHAR[] END)) END
        FROM w JOIN steps s ON s.i = w.k)
      SELECT dropped FROM w ORDER BY k DESC LIMIT 1))
    SELECT fi.feature, NOT list_contains((SELECT dropped FROM walk), fi.feature) AS kept FROM fi""")


def selected_features_by_group_sql(threshold: float) -> str:
    """Group pruning (K4): each feature with earlier correlated features forms
    a group with them; the group's strongest target correlation (earliest
    feature on ties; the feature itself if none is known) is kept."""
    return (_spearman_body() + "," + _correlated_pairs_ctes(threshold) + f""",
    tc AS (SELECT fi.feature, fi.i, round(sp.abs_rho, 12) AS c FROM fi LEFT JOIN sp USING (feature)),
    grp AS (SELECT DISTINCT j AS g, j AS m FROM cp UNION SELECT j AS g, i AS m FROM cp),
    scored AS (SELECT grp.g, grp.m, tc.c FROM grp JOIN tc ON tc.i = grp.m),
    best AS (SELECT g, coalesce(first(m ORDER BY c DESC, m ASC) FILTER (WHERE c IS NOT NULL), g) AS b
             FROM scored GROUP BY g),
    dropped AS (SELECT DISTINCT m FROM grp JOIN best USING (g) WHERE m <> b)
    SELECT feature, i NOT IN (SELECT m FROM dropped) AS kept FROM fi""")


def encoded_nulls_sql() -> str:
    """The rule of I1 / I2 stated over the data: codes where a column has at most
    two values, null being one and the last; else one dummy per value."""
    segments = ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    return f"""
    WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'Y' END AS in_credit,
                      CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' END AS level,
                      CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment,
                      CASE WHEN c_acctbal > 0 THEN 'N' ELSE 'M' END AS sign FROM customer)
    SELECT c_custkey, CAST(in_credit IS NULL AS BIGINT) AS in_credit, CAST(sign = 'N' AS BIGINT) AS sign,
           {", ".join(f"CAST(coalesce(level = '{v}', false) AS DOUBLE) AS level_{v}" for v in ("high", "low"))},
           {", ".join(f"CAST(coalesce(segment = '{v}', false) AS DOUBLE) AS {q('segment_' + v)}" for v in segments)}
    FROM d"""


def history_direct_sql() -> str:
    """The history block from the side of the clients that have instalments."""
    body = history_block_cte()
    fold = body.index("history_block AS (")
    return (binding_sql(ALL_BOUND) + "," + body[:fold] + """history_block AS (
        SELECT * FROM h_inst LEFT JOIN h_prev USING (SK_ID_CURR) LEFT JOIN h_pos USING (SK_ID_CURR)
        LEFT JOIN h_card USING (SK_ID_CURR))
    SELECT * FROM history_block""")


def empty_bureau_features_sql() -> str:
    """The client table over loans and months of which there are none."""
    sql = client_features_sql()
    for table in ("bureau", "bureau_balance"):
        sql = sql.replace(f"{table} AS (", f"{table}_all AS (", 1)
    first = sql.index(",\n    app AS (")
    return (sql[:first] + ",\n    bureau AS (SELECT * FROM bureau_all LIMIT 0),"
            "\n    bureau_balance AS (SELECT * FROM bureau_balance_all LIMIT 0)" + sql[first:])


# --- scoring with given coefficients ----------------------------------------------------

GIVEN_INTERCEPT = -0.25


def given_coefficients() -> list[float]:
    """Distinct literal coefficients of alternating sign, one per bureau feature."""
    return [(-1) ** k * (k + 1) / 97 for k in range(len(bureau_client_feature_names()))]


def given_model_sql(kind: str) -> str:
    """Median imputation and population standardising learnt on the training
    split, a linear margin, its probability and route, and contributions."""
    from riskfold.constants import DECISION_THRESHOLD
    feats = bureau_client_feature_names()
    casts = ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in feats)
    weights = ", ".join(f"({lit(c)}, CAST({w!r} AS DOUBLE))" for c, w in zip(feats, given_coefficients()))
    base = binding_sql(ALL_BOUND) + split_ctes() + "," + bureau_client_cte() + f""",
    d AS (SELECT SK_ID_CURR, split, {casts} FROM bureau_client JOIN splits USING (SK_ID_CURR)),
    long AS (SELECT * FROM d UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(q(c) for c in feats)}))),
    med AS (SELECT feature, coalesce(median(x) FILTER (WHERE split = 'train'), 0.0) AS m FROM long GROUP BY feature),
    filled AS (SELECT SK_ID_CURR, split, feature, coalesce(x, m) AS x FROM long JOIN med USING (feature)),
    mom AS (SELECT feature, avg(x) AS mean, CASE WHEN max(x) > min(x) THEN stddev_pop(x) ELSE 1.0 END AS std
            FROM filled WHERE split = 'train' GROUP BY feature),
    w AS (SELECT * FROM (VALUES {weights}) t(feature, weight)),
    part AS (SELECT SK_ID_CURR, feature, weight * ((x - mean) / std) AS contribution
             FROM filled JOIN mom USING (feature) JOIN w USING (feature)),
    p AS (SELECT SK_ID_CURR, 1.0 / (1.0 + exp(-({GIVEN_INTERCEPT!r} + sum(contribution)))) AS probability
          FROM part GROUP BY SK_ID_CURR),
    s AS (SELECT SK_ID_CURR, probability, probability * 100 AS score,
                 CASE WHEN probability * 100 >= {DECISION_THRESHOLD!r} THEN 'not likely to repay' ELSE 'likely to repay' END AS decision
          FROM p)"""
    return base + {
        "scores": "SELECT * FROM s",
        "global": """SELECT feature, avg(abs(contribution)) AS mean_abs_contribution FROM part GROUP BY feature
                     ORDER BY mean_abs_contribution DESC, feature LIMIT 15""",
        "local": """, ends AS (
            SELECT SK_ID_CURR, score, 'highest' AS "group" FROM (SELECT * FROM s ORDER BY score DESC, SK_ID_CURR LIMIT 3)
            UNION ALL SELECT SK_ID_CURR, score, 'lowest' FROM (SELECT * FROM s ORDER BY score, SK_ID_CURR LIMIT 3)),
        ranked AS (SELECT part.*, CAST(row_number() OVER (PARTITION BY part.SK_ID_CURR
                          ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS position
                   FROM part WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM ends))
        SELECT SK_ID_CURR, feature, contribution, position, score, "group" FROM ranked JOIN ends USING (SK_ID_CURR)
        WHERE position <= 15""",
    }[kind]


# --- requests and the run ledger ---------------------------------------------------------

def request_verdicts_sql() -> str:
    return binding_sql(ALL_BOUND) + """,
    r AS (SELECT SK_ID_CURR AS request_id, SK_ID_CURR % 50 AS kind,
                 (SELECT count(*) FROM bureau b WHERE b.SK_ID_CURR = a.SK_ID_CURR) AS loans FROM current_app a)
    SELECT request_id, kind NOT IN (0, 1, 2) AS accepted,
           CASE kind WHEN 0 THEN 'missing tables: bureau' WHEN 1 THEN 'table current_app cannot be empty'
                     WHEN 2 THEN 'payload cannot be read' END AS reason,
           CAST(CASE kind WHEN 2 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS n_current_app,
           CAST(CASE WHEN kind NOT IN (0, 2) THEN loans END AS INTEGER) AS n_bureau
    FROM r"""


def request_loans_sql() -> str:
    return binding_sql(ALL_BOUND) + """
    SELECT SK_ID_CURR AS request_id, count(*) AS loans, round(sum(CAST(AMT_CREDIT_SUM AS DOUBLE)), 2) AS credit
    FROM bureau JOIN current_app USING (SK_ID_CURR) WHERE SK_ID_CURR % 50 NOT IN (0, 1, 2) GROUP BY 1"""


def _segments() -> str:
    return binding_sql(ALL_BOUND) + """,
    s AS (SELECT NAME_SEGMENT AS segment, 'run-' || lower(NAME_SEGMENT) AS run_id, count(*) AS n, avg(TARGET) AS rate, max(SK_ID_CURR) AS top
          FROM current_app JOIN client_labels USING (SK_ID_CURR) GROUP BY 1, 2)"""


def ledger_board_sql() -> str:
    return _segments() + """
    SELECT run_id, CAST(n AS DOUBLE) AS clients, rate AS default_rate, segment, 'clients up to ' || top AS description FROM s"""


def ledger_best_params_sql() -> str:
    return _segments() + """
    SELECT run_id, 'C' AS param, CAST(n % 7 AS VARCHAR) AS value FROM s"""
