"""Word lists and patterns that results depend on. Plain text, in their natural order."""

# Terms of a question that point to tables.
TABLE_WORDS = ["table", "row", "column"]
TABLE_NUMERIC = r"20[0-9][0-9]|\$|%|billion|million"
TABLE_FINANCIAL = ["net income", "net interest income", "noninterest revenue", "revenue", "segment", "total", "assets", "liabilities", "highest", "lowest", "compare"]

# Terms of a question that point to figures; the first nine settle it.
VISUAL_EXPLICIT = ["figure", "fig.", "chart", "diagram", "exhibit", "image", "graph", "plot", "visual"]
VISUAL_TERMS = [*VISUAL_EXPLICIT, "shown", "illustrates", "line", "bar", "legend", "axis", "trend"]
VISUAL_SHOWN_WITH = ["chart", "figure", "graph"]

# Phrases of an answer that declines, in queries and in evaluation.
QUERY_ABSTENTIONS = [
    "do not have enough evidence", "don't have enough evidence", "insufficient evidence", "cannot answer", "cannot determine",
    "not enough evidence", "i do not have", "i don't have",
]
QUERY_CONTRACTIONS = [("don't", "do not"), ("can't", "cannot"), ("doesn't", "does not")]
EVAL_ABSTENTIONS = [
    "i do not have enough evidence", "i don't have enough evidence", "i do not have sufficient evidence", "i don't have sufficient evidence",
    "i cannot answer", "i can't answer", "i cannot determine", "i can't determine", "i cannot provide", "i can't provide",
    "i cannot help", "i can't help", "i do not have", "i don't have",
    "the retrieved evidence does not", "the retrieved evidence is insufficient", "the evidence does not contain", "no evidence was retrieved",
    "not provided in the evidence", "insufficient evidence to answer", "not enough evidence to answer",
    "unable to determine", "unable to answer",
]
EVAL_CONTRACTIONS = [("don't", "do not"), ("can't", "cannot"), ("isn't", "is not"), ("doesn't", "does not"), ("won't", "will not"), ("couldn't", "could not")]

# Words that raise a table's rank where question and table share them.
BOOST_TERMS = ["net income", "net interest income", "noninterest revenue", "revenue", "segment", "assets", "liabilities", "highest", "lowest", "compare", "total"]
BOOST_SEGMENTS = ["commercial & investment bank", "consumer & community banking", "asset & wealth management", "productivity and business processes", "intelligent cloud", "more personal computing"]

# Words that mark a line as financial.
FINANCIAL_TERMS = ["assets", "banking", "capital", "corporate", "equity", "expense", "income", "liabilities", "loss", "managed", "margin", "net income", "net interest", "noninterest", "provision", "ratio", "revenue", "segment", "wealth"]

# Metrics and entities that table questions ask for.
METRICS = ["net interest income", "noninterest revenue", "total net revenue", "net income", "revenue", "assets", "liabilities", "return on equity", "overhead ratio"]
ENTITIES = ["Consumer & Community Banking", "Commercial & Investment Bank", "Asset & Wealth Management", "Corporate", "Reconciling Items", "Total", "Productivity and Business Processes", "Intelligent Cloud", "More Personal Computing"]
NOT_SEGMENTS = ["Total", "Reconciling Items"]
OPERATION_WORDS = {"max": ["highest", "largest", "maximum", "most"], "min": ["lowest", "smallest", "minimum", "least"], "compare": ["compare"]}

# Patterns of lines and pages.
PAGE_MARKER = r"(?i)^\s*(?:<!--\s*page\s+([0-9]+)\s*-->|#\s*Page\s+([0-9]+))\s*$"
SEPARATOR_LINE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
LINE_NUMBER = r"(?:\$?\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?%?)|(?:20[0-9][0-9])"
CELL_NUMBER = r"\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?\s*%?"
YEAR = r"\b20[0-9][0-9]\b"
FIGURE_LABEL = r"(?i)(Figure|Fig\.?|Chart|Diagram|Exhibit)\s*([0-9]+)"
