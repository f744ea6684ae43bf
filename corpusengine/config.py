"""Configuration objects and the fixed values the engine must reproduce."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced; do not edit).
# ---------------------------------------------------------------------------
HISTORICAL_FORMS = ("10-K", "10-K/A")
DAILY_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")
DEFAULT_FORM = "10-K"
MASTER_INDEX_HEADER = "CIK|Company Name|Form Type|Date Filed|Filename"
SECTION_NAME = "Item 1A"
ARTIFACT_MARKER = "=== ITEM 1A. RISK FACTORS ==="
ARCHIVE_BASE = "https://www.sec.gov/Archives/edgar/data/"
DAILY_INDEX_BASE = "https://www.sec.gov/Archives/edgar/daily-index/"
MAIN_SOURCE_LABEL = "SEC Database"
UPLOAD_SOURCE_LABEL = "Your PDF"
BLANK_QUESTION_REPLY = "Please enter a question."
NOTHING_FOUND_REPLY = (
    "I couldn't find relevant information. Please try rephrasing your question."
)
ANSWER_MARKER = "Answer:"
PROMPT_TEMPLATE = """You are a helpful assistant that answers questions about SEC 10-K filings. 

Use the following context from SEC filings to answer the question accurately and concisely. If you cannot find the answer in the context, say so.

Context:
{context}

Question: {question}

Answer:"""
EMBEDDING_MODEL_NAME = "sentence-transformers/all-MiniLM-L6-v2"
# Skip reasons.
REASON_ALREADY_INGESTED = "already_ingested:{acc}"
REASON_NO_SECTION = "{acc}:no_item_1a"
REASON_NO_FILINGS = "no_10k_recent"
REASON_ALREADY_SEEN = "already_seen"
REASON_NOT_IN_SUBMISSIONS = "not_found_in_submissions_recent"
# ---------------------------------------------------------------------------


# The numeric defaults below must match too.
@dataclass(frozen=True)
class IngestConfig:
    top_n_per_cik: int = 3
    chunk_size: int = 1500
    chunk_overlap: int = 200
    min_item1a_chars: int = 800
    batch_size: int = 10_000
    embedding_model: str | None = EMBEDDING_MODEL_NAME


@dataclass(frozen=True)
class RagConfig:
    retrieval_k: int = 5
    main_k: int = 3
    upload_k: int = 4
    merged_cap: int = 6
    item_chars: int = 500
    upload_chunk_size: int = 1000
    upload_chunk_overlap: int = 200
    metric: str = "cosine"
    prompt_template: str = PROMPT_TEMPLATE
    main_label: str = MAIN_SOURCE_LABEL
    upload_label: str = UPLOAD_SOURCE_LABEL
    label_format: str = "[{label}]\n"


@dataclass(frozen=True)
class RetrievalLimits:
    """Size bounds for data shipped to every task.

    ``max_broadcast_questions`` bounds one block of query vectors sent to all
    scoring tasks; larger question sets are processed block by block.
    """

    max_broadcast_questions: int = 4096
    max_broadcast_bytes: int = 64 * 1024 * 1024
