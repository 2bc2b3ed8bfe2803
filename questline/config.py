"""Parameters shared by the jobs."""

# The limits the engine must agree on with existing deployments.
RERUN_THRESHOLD = 0.93        # a statement this close to the user's next one is a rerun
LONG_STATEMENT_CHARS = 20000  # statements of at least this length go to the long model
PAGE_ROWS = 1000              # rows of one landed history page
PAGE_ROW_CAP = 10000          # pages are read until this many rows are there
NEIGHBOURS = 3                # similar statements per training prompt
EMBEDDING_DIM = 1024          # width of the embedding vectors
SUMMARY_WORDS = 100
QUESTION_WORDS = 50
PARSING_ERROR = "PARSING ERROR"

# Retrieval depth when the caller gives none.
RETRIEVAL_K = 4

# Rows of one lookup key above which they are split over several tasks.
HOT_ROWS = 500_000

SHORT_MODEL = "short-context"
LONG_MODEL = "long-context"
