"""Values that other parts of a deployment already depend on."""

# Stored texts, message texts and limits that readers of the tables
# and of the status log compare against literally (spelling included).
PENDING = "pending"
NEWS_READY = "news ready"
SUMMARIES_READY = "sumaries ready"
INSIGHTS_READY = "news crops ready"
JOB_FAILED = "Job failed: "
NO_EVENTS = "nothing"
NO_RELATION = "no relation"
NOT_SPECIFIED = "Not specified"
NOT_AVAILABLE = "N/A"
STORY_BREAK = "Story continues"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
FILE_TIME_FORMAT = "yyyy-MM-dd'_T_'HH-mm-ss"
SNAPSHOT_TTL_HOURS = 24
LINKS_PER_PAGE = 5
INSIGHT_INPUT_CHARS = 8000
FRAGMENTS_SHOWN = 10
SHORT_LINE = 10
STUCK_AFTER_SECONDS = 100
NEWS_DOMAIN = "sg.finance.yahoo.com/news"
LINK_CLASS = "subtle-link fin-size-small titles noUnderline yf-1btaiiq"
ORG_CLASS = "name yf-1c9i0iv"

# Keys of the model's insight object, each with the value stored
# when the model leaves the key out.
INSIGHT_DEFAULTS = {
    "related_reason_simple": "",
    "related_reason_short": "",
    "polarity": "neutral",
    "actual_trend": "unknown",
    "quote_frag": "",
}

# The stages of a job, in order, each with the status text that ends it.
STAGE_DONE = {
    "crawl": NEWS_READY,
    "summary": SUMMARIES_READY,
    "crop": INSIGHTS_READY,
}

# What the trimming of text fields removes (every Unicode blank,
# including the four ASCII separators and the no-break spaces).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
