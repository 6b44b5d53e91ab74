"""Fixed values that must equal the original project's for identical results.

Everything here is data, not logic.  Values are listed in their natural
order, as plain text.
"""

# --- fixed values -----------------------------------------------------------

# Monthly loan status codes: 0 = no days past due, 1..5 = DPD buckets,
# C = closed, X = unknown.
STATUS_CODES = ["0", "1", "2", "3", "4", "5", "C", "X"]

# Status codes that do NOT count as a past-due month.
NON_DPD_STATUSES = ["C", "X", "0"]

# Status code -> representative days past due.
DAYS_PAST_DUE = {"C": 0, "X": 0, "0": 0, "1": 15, "2": 45, "3": 75, "4": 105, "5": 120}

# A loan whose first month lies this many years back or more is long term.
LONG_TERM_YEARS = 5
LOAN_TYPE_LONG = "Long Term"
LOAN_TYPE_SHORT = "Short Term"

# Statistics of the numeric roll-up, in output order.
NUMERIC_STATS = ["count", "mean", "max", "min", "sum"]

# Business cost of one confusion-matrix cell (false negative, false
# positive, true negative); true positives cost nothing.
COST_FN = 10
COST_FP = 1
COST_TN = -1

# Threshold grid of the cost sweep: 100 evenly spaced points in [0.01, 0.99].
THRESHOLD_START = 0.01
THRESHOLD_STOP = 0.99
THRESHOLD_POINTS = 100

# Probability threshold of the decision and the score (0..100) at and above
# which a client is "not likely to repay" (computed exactly as the original).
DECISION_PROBABILITY = 0.6336
DECISION_THRESHOLD = DECISION_PROBABILITY * 100

# Absolute Spearman correlation above which two features are redundant.
CORRELATION_THRESHOLD = 0.95

# String tokens that mean "missing" in exchanged records.
NULL_TOKENS = ["inf", "-inf", "Infinity", "-Infinity", "NaN", "nan", "None", "null", "NA", "<NA>"]

# Characters replaced by "_" when a column name is made model-safe.
NAME_SPECIAL_CHARS = r"""[\[\]{}":',.<>\s/?!@#$%^&*()+=-]+"""

# Seeded sampling defaults.
SAMPLE_FRACTION = 0.001
SEED = 42
TEST_FRACTION = 0.2
CV_FOLDS = 3

# Name prefixes of the run ledger's tuned parameters.
BEST_PARAM_PREFIX = "best_gs_"

# Names of the seven input tables of the client feature plan.
TABLE_NAMES = [
    "current_app", "bureau", "bureau_balance", "previous_application",
    "POS_CASH_balance", "installments_payments", "credit_card_balance",
]
