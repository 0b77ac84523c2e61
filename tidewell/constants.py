"""Numbers, word lists and labels the results depend on."""

# retrieval
RRF_K = 60
CANDIDATE_LIMIT = 20
DEFAULT_TOP_K = 5
MAX_TOP_K = 20
STRONG_HIT = 0.7
MIN_STRONG_HITS = 3
FILENAME_HIT_SCORE = 0.5
MAX_EXPANSIONS = 4
MAX_SEARCH_STEPS = 2

# chunking
TARGET_WORDS = 512
OVERLAP_WORDS = 64
CHILD_WORDS = 128
ROWS_PER_TABLE = 10
TRANSCRIPT_WORDS = 120
TRANSCRIPT_SECONDS = 60.0

# embeddings
EMBEDDING_BATCH = 100
NATIVE_DIM = 3072

# Score weights and gates
WEIGHT_RETRIEVAL = 0.25
WEIGHT_QUALITY = 0.35
WEIGHT_FAITHFULNESS = 0.25
WEIGHT_LATENCY = 0.10
WEIGHT_COST = 0.05
FAITHFULNESS_GATE = 0.50
ADVERSARIAL_GATE = 1.0
DEPLOY_SCORE = 0.72
IMPROVE_SCORE = 0.60
LATENCY_GOOD_MS = 8000
LATENCY_OK_MS = 15000
DRIFT_DROP = 0.05
DRIFT_WINDOW = 6
DRIFT_WINDOW_IN_LOOP = 10
RECENT_RUNS = 25
GOLDEN_SAMPLE = 5

# Unanswerable questions every golden set ends with
ANCHOR_QUESTIONS = [
    "What did the CEO say on March 3rd, 2019?",
    "List all employees who joined before 1990.",
    "What is the revenue forecast for 2035?",
    "Who won the Nobel Prize mentioned in section 12?",
    "What were the quarterly earnings for Q3 1999?",
]

# Phrases that mark a refusal
REFUSAL_PHRASES = [
    "don't know",
    "do not know",
    "cannot answer",
    "can't answer",
    "not present",
    "not found",
    "no information",
    "unable to",
]

# Openings of queries that need no rewrite
CLEAR_STARTERS = [
    "what is",
    "what are",
    "how do",
    "how does",
    "how to",
    "why does",
    "when did",
    "where is",
    "who is",
    "explain",
    "describe",
    "list",
]

# Answer openings that are cut off
BOILERPLATE_PREFIXES = [
    "Based on the provided context, ",
    "Based on the provided context ",
    "According to the provided context, ",
    "According to the context, ",
    "From the provided context, ",
]

# Personal-data patterns in masking order
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+?\d{1,3}[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]?)?\d{3,4}[\s\-]?\d{4}",
    "ssn_aadhaar": r"\b(?:\d{3}-\d{2}-\d{4}|\d{4}\s?\d{4}\s?\d{4})\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

# Audit trail
AUDIT_EVENTS = [
    "PIPELINE_CREATED",
    "PIPELINE_UPDATED",
    "INGESTION_STARTED",
    "INGESTION_COMPLETED",
    "DOCUMENT_STATUS_CHANGED",
    "EVALUATION_STARTED",
    "EVALUATION_COMPLETED",
    "IMPROVEMENT_TRIGGERED",
    "APPROVAL_GRANTED",
    "APPROVAL_DENIED",
    "PIPELINE_DEPLOYED",
    "PIPELINE_ROLLED_BACK",
]
AUDIT_PII_KEYS = ["email", "phone", "ssn", "aadhaar", "credit_card", "ip", "query", "content"]

# Document states
RETRYABLE_STATUS = ["queued", "failed", "completed"]

# Approval policy
HIGH_RISK_KEYS = ["llm_judge", "embedding_model", "prompt_template", "chunking_strategy"]
MEDIUM_RISK_KEYS = ["retrieval_method", "context_window", "reranker_model"]
LOW_RISK_KEYS = ["top_k", "temperature"]

# Diagnosis hints in order
HINT_RECALL = "increase_top_k_or_chunk_overlap"
HINT_PRECISION = "enable_rerank_or_tighten_chunks"
HINT_FAITHFULNESS = "strengthen_grounding_prompt"
HINT_REFUSAL = "add_refusal_instruction"

# File format by extension or MIME type
FORMAT_BY_KEY = {
    ".pdf": "pdf",
    "application/pdf": "pdf",
    ".docx": "docx",
    ".doc": "docx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/msword": "docx",
    ".png": "image",
    ".jpg": "image",
    ".jpeg": "image",
    "image/png": "image",
    "image/jpeg": "image",
    ".pptx": "pptx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    ".csv": "csv",
    "text/csv": "csv",
    ".xlsx": "excel",
    ".xls": "excel",
    "application/vnd.ms-excel": "excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel",
    ".html": "html",
    ".htm": "html",
    "text/html": "html",
    ".youtube": "youtube",
    "application/x-youtube": "youtube",
}

# MIME type guessed from a (case-sensitive) file ending
MIME_BY_ENDING = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".csv": "text/csv",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
DEFAULT_MIME = "application/octet-stream"

# Video link shapes, tried in order
VIDEO_ID_PATTERNS = [
    r"(?:https?://)?(?:www\.)?youtube\.com/watch\?v=([^&\s]+)",
    r"(?:https?://)?youtu\.be/([^?\s]+)",
    r"(?:https?://)?(?:www\.)?youtube\.com/embed/([^?\s]+)",
    r"(?:https?://)?(?:www\.)?youtube\.com/shorts/([^?\s]+)",
    r"(?:https?://)?m\.youtube\.com/watch\?v=([^&\s]+)",
]

# English stop words of the PostgreSQL text-search configuration
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now
""".split()

# Characters Python counts as white space
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
