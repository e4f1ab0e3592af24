"""Word lists, tokens, patterns and rule tables.

These are data, not logic. They have to equal the published behaviour exactly
because a missing word changes a column's role, type or parsed value.
"""

from __future__ import annotations

# --- fixed values: missing-value tokens -----------------------------------

# Tokens a reader maps to null, each also in upper, title and capitalised form.
READER_NULL_TOKENS = (
    "", "na", "n/a", "n.a.", "nan", "null", "none", "nil", "-", "--", "?",
    "missing", "unknown", "#n/a", "#value!", "#ref!", "#div/0!",
)
# Placeholders the cleaner maps to null, matched exactly.
CLEANER_PLACEHOLDERS = ("", "-", "--", "N/A", "n/a", "NULL", "null", "None")
UNKNOWN_LABEL = "Unknown"

# --- fixed values: booleans -----------------------------------------------

TRUE_TOKENS = ("true", "t", "yes", "y", "1", "on", "active", "enabled")
FALSE_TOKENS = ("false", "f", "no", "n", "0", "off", "inactive", "disabled")

# --- fixed values: numbers ------------------------------------------------

CURRENCY_SYMBOLS = "$€£¥₹₽₩₪"
UNIT_WORDS = "usd|eur|gbp|inr|units?|pcs|kg|hrs?|hours?"

# --- fixed values: dates --------------------------------------------------

DATE_HINT = r"(?i)[-/:]|\d{1,2}\s*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
YEAR_HINT = r"(?:19|20)\d{2}"
COMPACT_DATE = r"^(?:19|20)\d{6}$"
DATE_NAME_HINTS = ("date", "time", "day", "month", "year", "_at", "_on")

# (layout, Spark pattern, shape a value must have before parsing is tried).
# Order is preference order: the first listed layout wins a tie.
DATE_LAYOUTS = (
    ("%Y-%m-%d", "yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("%Y-%m-%dT%H:%M:%S", "yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("%Y/%m/%d", "yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("%d/%m/%Y", "d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("%m/%d/%Y", "M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("%d-%m-%Y", "d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("%m-%d-%Y", "M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("%d.%m.%Y", "d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("%b %d, %Y", "MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("%d %b %Y", "d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("%B %d, %Y", "MMMM d, yyyy", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"),
    ("%Y-%m", "yyyy-M", r"^\d{4}-\d{1,2}$"),
    ("%m/%d/%y", "M/d/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("%d/%m/%y", "d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("%Y%m%d", "yyyyMMdd", r"^\d{8}$"),
)

# --- fixed values: identifier patterns ------------------------------------

UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EMAIL_PATTERN = r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$"
ID_NAME_SUFFIX = r"(^|_)(id|ids|key|code|no|num|uuid|guid)$"

# --- fixed values: role lexicons ------------------------------------------

ROLE_WORDS = {
    "currency": frozenset({
        "revenue", "sales", "price", "cost", "amount", "profit", "salary", "budget", "spend", "spending", "income",
        "expense", "expenses", "fee", "fees", "payment", "payments", "value", "gmv", "arr", "mrr", "wage",
        "compensation", "pay", "billing", "invoice", "charge", "premium", "balance", "deposit", "withdrawal",
        "turnover", "margin_value", "subtotal", "cogs", "ltv", "cac", "cpc", "cpa", "cpl", "aov", "usd", "eur",
        "gbp", "revenues",
    }),
    "quantity": frozenset({
        "quantity", "qty", "units", "count", "orders", "items", "sold", "clicks", "impressions", "visits",
        "sessions", "leads", "headcount", "employees", "customers", "users", "subscribers", "views", "downloads",
        "shipments", "transactions", "returns", "tickets", "calls", "signups", "conversions", "stock", "inventory",
        "volume", "num",
    }),
    "percentage": frozenset({
        "pct", "percent", "percentage", "rate", "margin", "ratio", "share", "conversion", "ctr", "cvr", "churn",
        "attrition", "utilization", "occupancy", "growth", "discount", "completion", "satisfaction", "accuracy",
        "roi", "roas",
    }),
    "geo": frozenset({
        "country", "region", "state", "city", "province", "zip", "zipcode", "postal", "postcode", "location",
        "territory", "market", "continent", "district", "county", "area", "site", "branch", "store_location", "geo",
        "address",
    }),
    "identifier": frozenset({
        "id", "uuid", "guid", "key", "code", "sku", "reference", "ref", "number", "no", "identifier", "hash",
        "token", "account", "order_id", "invoice_no",
    }),
    "demographic": frozenset({
        "age", "gender", "sex", "tenure", "seniority", "experience", "education", "marital", "ethnicity",
        "nationality", "birth", "dob", "generation",
    }),
    "time": frozenset({
        "date", "time", "timestamp", "day", "month", "year", "week", "quarter",
    }),
    "text": frozenset({
        "description", "comment", "comments", "notes", "note", "feedback", "review", "message", "summary", "text",
        "body", "title", "subject", "url", "email", "address", "reason",
    }),
}

DOMAIN_WORDS = {
    "sales": [
        "revenue", "sales", "order", "orders", "profit", "discount", "quantity", "unit_price", "salesperson", "deal",
        "pipeline", "quota", "territory",
    ],
    "ecommerce": [
        "product", "sku", "cart", "checkout", "shipping", "order", "category", "basket", "customer", "return",
        "coupon", "payment_method", "delivery",
    ],
    "finance": [
        "transaction", "account", "balance", "debit", "credit", "ledger", "expense", "budget", "invoice", "payment",
        "interest", "asset", "liability", "portfolio", "merchant", "currency",
    ],
    "hr": [
        "employee", "department", "salary", "hire", "attrition", "tenure", "manager", "job_title", "performance",
        "headcount", "termination", "position", "leave", "recruitment", "resigned", "role",
    ],
    "marketing": [
        "campaign", "channel", "impressions", "clicks", "ctr", "cpc", "leads", "conversion", "spend", "roi", "roas",
        "audience", "ad", "creative", "utm", "email_open", "engagement",
    ],
    "operations": [
        "shipment", "warehouse", "inventory", "supplier", "logistics", "downtime", "throughput", "defect",
        "production", "machine", "batch", "delivery_time", "sla", "capacity", "utilization",
    ],
    "customer": [
        "customer", "churn", "satisfaction", "nps", "support", "ticket", "subscription", "retention", "segment",
        "loyalty", "lifetime_value",
    ],
    "healthcare": [
        "patient", "diagnosis", "treatment", "admission", "discharge", "doctor", "hospital", "medication", "clinic",
        "readmission",
    ],
    "education": [
        "student", "course", "grade", "enrollment", "teacher", "school", "attendance", "exam", "score", "semester",
    ],
}

# --- fixed values: name scores --------------------------------------------

DATE_NAME_SCORES = {
    "order_date": 3.0, "transaction_date": 3.0, "date": 2.0, "created": 1.5,
    "hire_date": 2.5, "timestamp": 1.5, "start": 1.0, "period": 1.5,
}
MEASURE_NAME_SCORES = {
    "revenue": 10.0, "sales": 9.5, "gmv": 9.0, "amount": 8.0, "salary": 8.5,
    "total": 7.5, "profit": 7.0, "spend": 6.5, "value": 6.0, "price": 5.0,
    "quantity": 4.5, "units": 4.5, "cost": 3.0, "bonus": 2.5, "tax": 1.0,
}
# Share of a measure's name score that counts, by the most percent of missing values.
MISSING_TRUST = ((25.0, 1.0), (50.0, 0.7), (float("inf"), 0.4))
MEASURE_ROLE_RANK = {"currency": 3, "measure": 2, "quantity": 2, "ratio": 1, "percentage": 0}
# Worth of a dimension by its number of values (least, most) and by its role.
DIMENSION_SHAPES = ((3, 12, 3.0), (0, 2, 2.0), (13, 20, 2.0), (21, float("inf"), 1.0))
DIMENSION_ROLE_WORTH = {"geo": 1.5, "dimension": 1.2, "demographic": 1.0, "flag": 0.6}
AVERAGED_NAME_PARTS = (
    "price", "rate", "score", "age", "tenure", "level", "ratio", "margin",
    "index", "per_", "avg", "average", "median", "temperature", "rating",
)
COST_NAME_PARTS = ("cost", "expense", "spend", "churn", "attrition", "defect", "loss")
ACRONYMS = ("id", "usd", "eur", "gbp", "roi", "kpi", "ctr", "cpc")

# --- fixed values: KPI rules ----------------------------------------------

# (id, name, numerator words, denominator words or None for the row count,
#  format, multiply, priority, higher is better, domains or () for any)
RATIO_KPIS = (
    ("profit_margin", "Profit Margin", ("profit", "net_profit", "gross_profit", "margin"),
     ("revenue", "sales", "net_sales", "gmv", "amount"), "percent", 100.0, 92, True, ()),
    ("average_order_value", "Average Order Value", ("revenue", "sales", "amount", "total"),
     None, "currency", 1.0, 78, True, ("sales", "ecommerce")),
    ("conversion_rate", "Conversion Rate", ("conversions", "leads", "signups", "orders"),
     ("clicks", "sessions", "visits", "impressions"), "percent", 100.0, 90, True, ()),
    ("click_through_rate", "Click-Through Rate", ("clicks",),
     ("impressions", "views"), "percent", 100.0, 76, True, ()),
    ("cost_per_click", "Cost per Click", ("spend", "cost", "budget"),
     ("clicks",), "currency", 1.0, 70, False, ()),
    ("cost_per_acquisition", "Cost per Acquisition", ("spend", "cost", "budget"),
     ("conversions", "leads", "signups"), "currency", 1.0, 86, False, ()),
    ("return_on_ad_spend", "Return on Ad Spend", ("revenue", "sales"),
     ("spend", "cost", "budget"), "decimal", 1.0, 88, True, ("marketing",)),
    ("units_per_order", "Units per Order", ("quantity", "units", "items"),
     None, "decimal", 1.0, 60, True, ("sales", "ecommerce")),
    ("effective_tax_rate", "Effective Tax Rate", ("tax", "tax_amount"),
     ("amount", "revenue", "gross"), "percent", 100.0, 55, False, ("finance",)),
)

# (id, name, flag column words, priority, higher is better)
FLAG_KPIS = (
    ("attrition_rate", "Attrition Rate",
     ("left", "left_company", "attrition", "terminated", "resigned", "churn"), 94, False),
    ("return_rate", "Return Rate",
     ("returned", "refund", "returns", "cancelled", "canceled"), 80, False),
    ("active_rate", "Active Rate",
     ("active", "is_active", "enabled", "subscribed"), 58, True),
)

RECORD_COUNT_NAMES = {
    "sales": "Total Orders", "ecommerce": "Total Orders",
    "finance": "Total Transactions", "hr": "Headcount",
    "marketing": "Total Campaigns", "operations": "Total Records",
    "customer": "Total Customers", "healthcare": "Total Encounters",
    "education": "Total Enrollments", "general": "Total Records",
}

# --- fixed values: semantic model labels ----------------------------------

DATA_CATEGORIES = {
    "currency": "Currency", "percentage": "Percentage", "geo": "Place",
    "time": "DateTime", "identifier": "Uncategorized",
}
FORMAT_STRINGS = {"currency": '"$"#,0.00', "percentage": "0.0%", "quantity": "#,0"}
TABULAR_TYPES = {
    "numeric": "double", "datetime": "dateTime", "boolean": "boolean",
    "categorical": "string", "text": "string", "empty": "string",
}
VISUAL_TYPES = {
    "line": "lineChart", "area": "areaChart", "bar": "columnChart",
    "horizontal_bar": "barChart", "pie": "pieChart", "donut": "donutChart",
    "scatter": "scatterChart", "histogram": "columnChart", "heatmap": "matrix",
    "table": "tableEx",
}
