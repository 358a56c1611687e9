"""Table schemas and the financial vocabulary every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

ANNUAL, QUARTERLY = "annual", "quarterly"
PK = ["ticker", "metric_type", "period_type", "period_end"]

# --------------------------------------------------------------------------
# Metric vocabulary. Flow metrics accumulate over a period,
# stock metrics are balances at a date.
# --------------------------------------------------------------------------
FLOW_METRICS = [
    "revenue", "net_income", "gross_profit", "operating_income",
    "cost_of_revenue", "operating_expenses", "income_tax_expense",
    "research_and_development", "interest_expense",
    "depreciation_and_amortization", "eps_diluted", "eps_basic",
    "ebitda", "free_cash_flow", "operating_cash_flow",
    "investing_cash_flow", "financing_cash_flow", "capex", "dividends_paid",
]
STOCK_METRICS = [
    "total_assets", "total_liabilities", "stockholders_equity", "cash",
    "long_term_debt", "short_term_debt", "inventory", "accounts_receivable",
    "accounts_payable", "goodwill", "intangible_assets",
    "total_current_assets", "total_current_liabilities", "retained_earnings",
    "common_shares_outstanding", "commercial_paper", "long_term_debt_current",
    "short_term_investments", "nontrade_receivables",
]
EPS_METRICS = ["eps_diluted", "eps_basic"]

# Canonical signs. Outflows are stored negative, tax is flipped,
# balances are stored positive, all other metrics keep their reported sign.
NEGATIVE_MAGNITUDE = [
    "capex", "cost_of_revenue", "depreciation_and_amortization",
    "dividends_paid", "interest_expense", "operating_expenses",
    "research_and_development",
]
SIGN_FLIP = ["income_tax_expense"]
POSITIVE_MAGNITUDE = [
    "accounts_payable", "accounts_receivable", "cash", "commercial_paper",
    "common_shares_outstanding", "goodwill", "intangible_assets", "inventory",
    "long_term_debt", "long_term_debt_current", "nontrade_receivables",
    "short_term_debt", "short_term_investments", "total_assets",
    "total_current_assets", "total_current_liabilities", "total_liabilities",
]

# XBRL tags (us-gaap) per metric, the first one preferred.
CONCEPT_ALIASES = {
    "revenue": [
        "Revenues",
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "SalesRevenueNet",
    ],
    "net_income": ["NetIncomeLoss"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "eps_diluted": ["EarningsPerShareDiluted"],
    "eps_basic": ["EarningsPerShareBasic"],
    "cost_of_revenue": ["CostOfGoodsAndServicesSold", "CostOfRevenue"],
    "operating_expenses": ["OperatingExpenses"],
    "income_tax_expense": ["IncomeTaxExpenseBenefit"],
    "research_and_development": ["ResearchAndDevelopmentExpense"],
    "interest_expense": ["InterestExpense"],
    "depreciation_and_amortization": [
        "DepreciationDepletionAndAmortization",
        "DepreciationAndAmortization",
        "DepreciationAmortizationAndAccretionNet",
    ],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "stockholders_equity": [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ],
    "cash": ["CashAndCashEquivalentsAtCarryingValue"],
    "long_term_debt": [
        "LongTermDebt",
        "LongTermDebtNoncurrent",
        "LongTermDebtAndCapitalLeaseObligations",
    ],
    "inventory": ["Inventory", "InventoryNet"],
    "accounts_receivable": ["AccountsReceivableNetCurrent"],
    "accounts_payable": ["AccountsPayableCurrent"],
    "goodwill": ["Goodwill"],
    "intangible_assets": ["IntangibleAssetsNetExcludingGoodwill"],
    "total_current_assets": ["AssetsCurrent"],
    "total_current_liabilities": ["LiabilitiesCurrent"],
    "short_term_debt": ["ShortTermBorrowings", "ShortTermDebt", "DebtCurrent"],
    "commercial_paper": ["CommercialPaper"],
    "long_term_debt_current": [
        "LongTermDebtCurrent",
        "LongTermDebtAndCapitalLeaseObligationsCurrent",
    ],
    "short_term_investments": [
        "ShortTermInvestments",
        "AvailableForSaleSecuritiesDebtSecuritiesCurrent",
        "MarketableSecuritiesCurrent",
    ],
    "nontrade_receivables": ["NontradeReceivablesCurrent"],
    "retained_earnings": ["RetainedEarningsAccumulatedDeficit"],
    "common_shares_outstanding": ["CommonStockSharesOutstanding"],
    "operating_cash_flow": [
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    ],
    "investing_cash_flow": [
        "NetCashProvidedByUsedInInvestingActivities",
        "NetCashProvidedByUsedInInvestingActivitiesContinuingOperations",
    ],
    "financing_cash_flow": [
        "NetCashProvidedByUsedInFinancingActivities",
        "NetCashProvidedByUsedInFinancingActivitiesContinuingOperations",
    ],
    "capex": [
        "PaymentsToAcquirePropertyPlantAndEquipment",
        "PaymentsToAcquireProductiveAssets",
    ],
    "dividends_paid": ["PaymentsOfDividends", "PaymentsOfDividendsCommonStock"],
}
TAG_PREFIX = "us-gaap:"

# Tag groups of the canonical long-term debt rule.
DEBT_TOTAL_TAGS = ["LongTermDebt", "LongTermDebtAndCapitalLeaseObligations"]
DEBT_NONCURRENT_TAGS = ["LongTermDebtNoncurrent"]
DEBT_CURRENT_TAGS = ["LongTermDebtCurrent", "LongTermDebtAndCapitalLeaseObligationsCurrent"]

# Standardised series names that differ from the metric name.
STANDARD_CONCEPTS = {
    "earnings_per_share_diluted": "eps_diluted",
    "earnings_per_share_basic": "eps_basic",
    "cash_and_equivalents": "cash",
}
# Metrics that only a raw tag supplies, never a standardised series.
RAW_ONLY_METRICS = [
    "commercial_paper", "long_term_debt_current", "short_term_investments",
    "nontrade_receivables",
]
EXPECTED_METRICS = FLOW_METRICS + STOCK_METRICS

# Duration buckets in days, both ends included.
DURATION_BUCKETS = [
    ("quarter", 70, 120),
    ("ytd_6m", 140, 229),
    ("ytd_9m", 230, 329),
    ("annual", 330, 420),
]

# Plausibility range of |cost / revenue| for a derived gross profit.
COST_RATIO_RANGE = (0.2, 0.95)

# Trailing-twelve-month rules.
TTM_MAX_FLOW_STALENESS_DAYS = 130
TTM_MAX_SHARE_STALENESS_DAYS = 400
TTM_ANNUAL_FALLBACK = [
    "common_shares_outstanding", "total_current_assets", "total_current_liabilities",
]

# Forms of the incremental ingest.
TARGET_FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A"]

# Statement views.
INCOME_METRICS = [
    "revenue", "cost_of_revenue", "gross_profit", "operating_expenses",
    "research_and_development", "depreciation_and_amortization",
    "operating_income", "interest_expense", "income_tax_expense", "net_income",
    "eps_basic", "eps_diluted",
]
BALANCE_METRICS = [
    "total_assets", "total_current_assets", "cash", "accounts_receivable",
    "inventory", "goodwill", "intangible_assets", "total_liabilities",
    "total_current_liabilities", "accounts_payable", "short_term_debt",
    "long_term_debt", "stockholders_equity", "retained_earnings",
]
CASHFLOW_METRICS = [
    "operating_cash_flow", "investing_cash_flow", "financing_cash_flow",
    "capex", "dividends_paid", "free_cash_flow",
]
KEY_METRICS = ["revenue", "net_income", "eps_diluted", "common_shares_outstanding"]
GROWTH_METRICS = ["revenue", "gross_profit", "operating_income", "net_income"]
CORE_METRICS = ["revenue", "net_income", "total_assets", "stockholders_equity", "operating_cash_flow"]

# Display formats of metrics that are not shown in millions.
METRIC_DISPLAY_FORMATS = {
    "common_shares_outstanding": "count",
    "eps_basic": "per_share",
    "eps_diluted": "per_share",
}
DEFAULT_DISPLAY_FORMAT = "millions"

# Form 4 transaction codes.
FORM4_CODES = {
    "P": "Open Market Purchase",
    "S": "Open Market Sale",
    "A": "Grant/Award",
    "M": "Option Exercise",
    "F": "Tax Withholding",
    "G": "Gift",
    "X": "Option Exercise",
    "D": "Disposition to Issuer",
    "C": "Conversion",
    "E": "Expiration of Short Position",
    "H": "Expiration of Long Position",
    "I": "Discretionary Transaction",
    "O": "Exercise of Out-of-Money Derivative",
    "U": "Disposition (Tender of Shares)",
    "Z": "Deposit/Withdrawal (Voting Trust)",
}
NOTABLE_TRADE, VERY_NOTABLE_TRADE = 100_000.0, 1_000_000.0

# Titles of the 8-K items, as the form itself words them.
EIGHTK_ITEM_TITLES = {
    "1.01": "Entry into a Material Definitive Agreement",
    "1.02": "Termination of a Material Definitive Agreement",
    "1.03": "Bankruptcy or Receivership",
    "1.04": "Mine Safety - Reporting of Shutdowns and Patterns of Violations",
    "2.01": "Completion of Acquisition or Disposition of Assets",
    "2.02": "Results of Operations and Financial Condition",
    "2.03": "Creation of a Direct Financial Obligation or an Obligation under an Off-Balance Sheet Arrangement of a Registrant",
    "2.04": "Triggering Events That Accelerate or Increase a Direct Financial Obligation or an Obligation under an Off-Balance Sheet Arrangement",
    "2.05": "Costs Associated with Exit or Disposal Activities",
    "2.06": "Material Impairments",
    "3.01": "Notice of Delisting or Failure to Satisfy a Continued Listing Rule or Standard; Transfer of Listing",
    "3.02": "Unregistered Sales of Equity Securities",
    "3.03": "Material Modification to Rights of Security Holders",
    "4.01": "Changes in Registrant's Certifying Accountant",
    "4.02": "Non-Reliance on Previously Issued Financial Statements or a Related Audit Report or Completed Interim Review",
    "5.01": "Changes in Control of Registrant",
    "5.02": "Departure of Directors or Certain Officers; Election of Directors; Appointment of Certain Officers; Compensatory Arrangements of Certain Officers",
    "5.03": "Amendments to Articles of Incorporation or Bylaws; Change in Fiscal Year",
    "5.04": "Temporary Suspension of Trading Under Registrant's Employee Benefit Plans",
    "5.05": "Amendments to the Registrant's Code of Ethics, or Waiver of a Provision of the Code of Ethics",
    "5.06": "Change in Shell Company Status",
    "5.07": "Submission of Matters to a Vote of Security Holders",
    "5.08": "Shareholder Director Nominations",
    "6.01": "ABS Informational and Computational Material",
    "6.02": "Change of Servicer or Trustee",
    "6.03": "Change in Credit Enhancement or Other External Support",
    "6.04": "Failure to Make a Required Distribution",
    "6.05": "Securities Act Updating Disclosure",
    "6.10": "Alternative Filings of Asset-Backed Issuers",
    "7.01": "Regulation FD Disclosure",
    "8.01": "Other Events",
    "9.01": "Financial Statements and Exhibits",
}

# Manager aliases.
MANAGER_ALIASES = {
    "berkshire hathaway": "BRK-B",
    "berkshire hathaway inc": "BRK-B",
    "berkshire hathaway inc.": "BRK-B",
}

# DERA tags (no prefix) per metric; "__" marks debt parts that
# only feed the debt rule.
DERA_TAGS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"],
    "net_income": ["NetIncomeLoss"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "eps_diluted": ["EarningsPerShareDiluted"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "stockholders_equity": ["StockholdersEquity"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue"],
    "total_current_assets": ["AssetsCurrent"],
    "__long_term_debt_total": ["LongTermDebt", "LongTermDebtAndCapitalLeaseObligations"],
    "__long_term_debt_noncurrent": ["LongTermDebtNoncurrent"],
    "__long_term_debt_current": ["LongTermDebtCurrent", "LongTermDebtAndCapitalLeaseObligationsCurrent"],
    "__commercial_paper": ["CommercialPaper"],
    "short_term_debt": ["ShortTermBorrowings", "ShortTermDebt"],
    "__debt_current": ["DebtCurrent"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment"],
}
GOLDEN_FLOW_METRICS = [
    "revenue", "net_income", "gross_profit", "operating_income",
    "operating_cash_flow", "eps_diluted", "capex",
]
GOLDEN_STOCK_METRICS = [
    "total_assets", "total_liabilities", "stockholders_equity", "cash",
    "total_current_assets", "long_term_debt", "short_term_debt",
]
DERA_DEBT_PARTS = [
    "__debt_current", "__commercial_paper", "__long_term_debt_current",
    "__long_term_debt_noncurrent", "__long_term_debt_total",
]

# Vendor statement fields per metric.
VENDOR_FIELDS = {
    "revenue": "revenue",
    "netIncome": "net_income",
    "grossProfit": "gross_profit",
    "operatingIncome": "operating_income",
    "epsdiluted": "eps_diluted",
    "epsDiluted": "eps_diluted",
    "totalAssets": "total_assets",
    "totalLiabilities": "total_liabilities",
    "totalStockholdersEquity": "stockholders_equity",
    "cashAndCashEquivalents": "cash",
    "totalCurrentAssets": "total_current_assets",
    "longTermDebt": "long_term_debt",
    "shortTermDebt": "short_term_debt",
    "operatingCashFlow": "operating_cash_flow",
    "capitalExpenditure": "capex",
}
# Fields that only the vendor's trailing-twelve-month statements add.
VENDOR_TTM_FIELDS = {
    "ebitda": "ebitda",
    "depreciationAndAmortization": "depreciation_and_amortization",
    "interestExpense": "interest_expense",
    "costOfRevenue": "cost_of_revenue",
    "operatingExpenses": "operating_expenses",
    "incomeTaxExpense": "income_tax_expense",
    "totalCurrentLiabilities": "total_current_liabilities",
    "inventory": "inventory",
    "accountPayables": "accounts_payable",
    "totalDebt": "total_debt",
    "freeCashFlow": "free_cash_flow",
    "commonDividendsPaid": "dividends_paid",
}

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------
METRICS_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("cik", T.StringType()),
    T.StructField("metric_type", T.StringType(), False),
    T.StructField("value", T.DoubleType(), False),
    T.StructField("currency", T.StringType()),
    T.StructField("period", T.StringType(), False),
    T.StructField("period_type", T.StringType(), False),
    T.StructField("period_end", T.DateType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("accession", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])
FACTS_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("cik", T.StringType()),
    T.StructField("concept", T.StringType()),
    T.StructField("numeric_value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("fiscal_period", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("period_start", T.DateType()),
    T.StructField("period_end", T.DateType()),
])
FILING_FACTS_SCHEMA = T.StructType([
    T.StructField("accession", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("filing_date", T.StringType()),
    T.StructField("cik", T.StringType()),
    T.StructField("concept", T.StringType()),
    T.StructField("numeric_value", T.DoubleType()),
    T.StructField("unit_ref", T.StringType()),
    T.StructField("is_dimensioned", T.BooleanType()),
    T.StructField("fiscal_period", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("period_start", T.DateType()),
    T.StructField("period_end", T.DateType()),
])
LEDGER_SCHEMA = T.StructType([
    T.StructField("accession_number", T.StringType(), False),
    T.StructField("ticker", T.StringType()),
    T.StructField("form_type", T.StringType()),
    T.StructField("filed_date", T.StringType()),
    T.StructField("processed_at", T.TimestampType()),
])
COMPANY_STATE_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("cik", T.StringType()),
    T.StructField("last_extracted", T.TimestampType()),
    T.StructField("extraction_type", T.StringType()),
])
MAINTENANCE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("ran_at", T.TimestampType()),
    T.StructField("details_json", T.StringType()),
])
MACRO_SCHEMA = T.StructType([
    T.StructField("indicator_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("value", T.DoubleType(), False),
    T.StructField("unit", T.StringType()),
    T.StructField("date", T.DateType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])
