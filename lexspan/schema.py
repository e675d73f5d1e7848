"""Table schemas and the constants that results depend on."""

from __future__ import annotations

# Categories (in report order), patterns, limits and grids that results depend on.
CATEGORIES = (
    "Cap On Liability",
    "Uncapped Liability",
    "Governing Law",
    "Anti-Assignment",
    "Change Of Control",
    "Termination For Convenience",
    "Exclusivity",
    "Non-Compete",
    "Renewal Term",
    "Audit Rights",
)
WEAK_CATEGORIES = ("Uncapped Liability", "Change Of Control", "Exclusivity", "Termination For Convenience")
REDACTION = r"\[\s*\*+\s*\]"
SHORT_SPAN = 15
LEAKAGE_PREFIX = 3000
MAX_TOKENS, OVERLAP, TOKEN_LIMIT = 510, 128, 512
THRESHOLD = 0.5
TUNING_GRID = tuple(i / 100 for i in range(5, 96))
FINE_GRID = tuple(i / 100 for i in range(1, 100))
UNSTABLE_STD, LOW_SUPPORT = 0.10, 200
# End of fixed values.

RAW_JSON = (
    "version string, data array<struct<title: string, paragraphs: array<struct<context: string, "
    "qas: array<struct<id: string, question: string, is_impossible: boolean, answers: array<struct<text: string, answer_start: bigint>>>>>>>>"
)
CONTRACTS = "contract string, text string, n_chars bigint"
CHUNKS = "contract string, split string, chunk_id string, start bigint, end bigint, text string, n_tokens bigint"
CATEGORY_DESCRIPTIONS = "category_raw string, description string, answer_format string, `group` string"
