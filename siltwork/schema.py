"""Row types and the constants that behaviour depends on."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L = T.StringType(), T.ArrayType(T.StringType())

#: A chunk of a document or of a mail, in one table; what a kind lacks is null.
CHUNK = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("index_name", _S), ("pos", T.LongType()), ("id", _S), ("text", _S), ("source", _S), ("path", _S), ("page", T.IntegerType()), ("date", _S), ("date_source", _S), ("ocr", T.BooleanType()),
        ("message_id", _S), ("thread_id", _S), ("subject", _S), ("mail_date", _S), ("sender", _S), ("sender_email", _S), ("sender_name", _S), ("to_emails", _L), ("cc_emails", _L), ("to_domains", _L), ("domains", _L),
        ("thread_domains", _L), ("lang", _S), ("labels", _L), ("has_attachments", T.BooleanType()), ("attachment_names", _L), ("part_no", T.IntegerType()), ("snippet", _S), ("text_key", _S), ("vector", T.ArrayType(T.FloatType())),
    )]
)

ADDRESS = T.StructType([T.StructField("email", _S), T.StructField("name", _S)])
ATTACHMENT = T.StructType([T.StructField("filename", _S), T.StructField("mime_type", _S), T.StructField("size_bytes", T.LongType()), T.StructField("saved_path", _S)])
MESSAGE = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("message_id", _S), ("thread_id", _S), ("rfc_message_id", _S), ("in_reply_to", _S), ("references", _L), ("subject", _S), ("sender", ADDRESS), ("to", T.ArrayType(ADDRESS)), ("cc", T.ArrayType(ADDRESS)),
        ("date", T.TimestampNTZType()), ("body_text", _S), ("body_html", _S), ("attachments", T.ArrayType(ATTACHMENT)), ("labels", _L), ("is_bulk", T.BooleanType()), ("list_id", _S),
    )]
)
PLAN = T.StructType([T.StructField("goal", _S), T.StructField("search_queries", _L), T.StructField("sources_to_check", _L), T.StructField("output_format", _S)])
CRITIQUE = T.StructType(
    [T.StructField("verdict", _S), *[T.StructField(n, T.BooleanType()) for n in ("is_fresh", "is_complete", "is_well_structured")], *[T.StructField(n, _L) for n in ("strengths", "gaps", "revision_requests")]]
)

# Sizes, thresholds and limits that results must share.
CHUNK_SIZE, CHUNK_OVERLAP = 500, 100
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
TOP_K, TOP_N, RRF_K = 10, 3, 60
BM25_K1, BM25_B = 1.5, 0.75
RERANK_MIN, NOISE_MARGIN = 0.02, 0.15
BATCH_COUNT, BATCH_CHARS = 64, 12000
MAIL_CHUNK, MAIL_OVERLAP, MIN_BODY, EMPTY_BODY = 4000, 300, 60, 3
LANG_SHARE = 0.6
OCR_MIN_CHARS, OCR_MAX_PAGES, OCR_DPI = 50, 40, 200
BLANK_RUN = 2000
PER_COUNTERPARTY, RANK_SCAN = 2, 10_000
WEIGHT_SCALE, DEFAULT_WEIGHT, SIGNATURE_CHARS = 100, 20, 400
SNIPPET, PAGE_CHARS, SHORT_PAGE = 400, 8000, 1200
TIGHT = 0.7
MESSAGES_A_SECOND, PIPELINE_SECONDS, CHUNKS_A_MESSAGE, CHUNKS_A_SECOND = 2.7, 5, 0.95, 0.29
EXCLUDE_DIRS = (".git", ".venv", "node_modules", "__pycache__", "site-packages", "dist", "build")
EXCLUDE_FILES = ("~$*", ".env", "*.key", "*.pem", "id_rsa*", "*recovery*code*")
EXCLUDE_SENDERS = ("*@accounts.google.com",)
MAX_REVISIONS = 2
