"""The two parameter profiles: every number, name list and label the rules use.

CANONICAL is the default. NOTEBOOK keeps the values of the notebook variant, which differs in
keys, bands and labels. Rules in ``operators`` read these and contain no thresholds themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Mapping

from prosa.functions.words import EDGE, NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE, WORD
from prosa.schemas import SOURCE_COLUMNS

# A band list is read top-down: the first bound that holds gives the value.
Bands = tuple[tuple[float, Any], ...]

# --- Fixed values: words and labels of the message data ------------------------------------

SALE = "venda_fechada"
GHOSTING = "ghosting"
LOST_PRICE = "perdido_preco"
LOST_COMPETITOR = "perdido_concorrente"
PROPOSAL = "proposta_enviada"
NEGOTIATING = "em_negociacao"
GAVE_UP = "desistencia_lead"
LOST = (LOST_PRICE, LOST_COMPETITOR)

OUTCOMES = (SALE, GHOSTING, LOST_PRICE, LOST_COMPETITOR, PROPOSAL, NEGOTIATING, GAVE_UP)

DIRECTIONS = ("outbound", "inbound")
MESSAGE_TYPES = ("text", "image", "audio", "document", "sticker")
STATUSES = ("sent", "delivered", "read", "failed")

OUTCOME_SCORE = {
    SALE: 0.9, NEGOTIATING: 0.5, PROPOSAL: 0.4, LOST_PRICE: -0.3, LOST_COMPETITOR: -0.4,
    GAVE_UP: -0.6, GHOSTING: -0.7,
}

REGIONS = {
    "sudeste": ("SP", "RJ", "MG", "ES"),
    "sul": ("PR", "SC", "RS"),
    "nordeste": ("BA", "PE", "CE", "MA", "PB", "RN", "AL", "SE", "PI"),
    "centro_oeste": ("DF", "GO", "MT", "MS"),
    "norte": ("AM", "PA", "AC", "RO", "RR", "AP", "TO"),
}

COMPETITORS = (
    "porto seguro", "bradesco seguros", "bradesco seguro", "itaú seguros", "itau seguros",
    "allianz", "hdi seguros", "hdi seguro", "mapfre", "tokio marine", "suhai", "azul seguros",
    "azul seguro",
)

NOTEBOOK_COMPETITORS = (
    "porto seguro", "bradesco seguros", "bradesco", "allianz", "azul seguros", "hdi", "liberty",
    "mapfre", "suhai", "tokio marine", "sompo", "zurich",
)

# --- Fixed values: patterns, in Java syntax with Unicode word edges ------------------------

# The digit patterns take their digits first and look back afterwards: most text has no digit, and
# a position without one is then left at once.

D = r"\p{Nd}"
CPF = rf"{D}{{3}}(?<!{WORD}{D}{{3}})\.?{D}{{3}}\.?{D}{{3}}-?{D}{{2}}{NOT_BEFORE_WORD}"
CEP = rf"{D}{{5}}(?<!{WORD}{D}{{5}})-?{D}{{3}}{NOT_BEFORE_WORD}"
EMAIL = rf"(?iu){EDGE}[\p{{L}}\p{{N}}_.+-]++@[\p{{L}}\p{{N}}_-]++\.[a-z]{{2,}}{NOT_BEFORE_WORD}"
PLATE = rf"(?iu){NOT_AFTER_WORD}[A-Z]{{3}}{D}[A-Z0-9]{D}{{2}}{NOT_BEFORE_WORD}"
PHONE = rf"\(?{D}{{2}}\)?{SPACE}?{D}{{4,5}}-?{D}{{4}}{NOT_BEFORE_WORD}"
COMPETITOR = rf"(?iu){NOT_AFTER_WORD}(?:{'|'.join(COMPETITORS)}){NOT_BEFORE_WORD}"

# Every CPF, CEP, plate and phone contains the first, every competitor name the second, the
# first four letters of one. Rows without them skip the patterns above.
SOME_DIGITS = rf"{D}{{2}}"
SOME_NAME = rf"(?iu){'|'.join(sorted({name[:4] for name in COMPETITORS}))}"

ANY_EMAIL = rf"{EDGE}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}{EDGE}"
ANY_PHONE = rf"{EDGE}(?:\+55{SPACE}?)?\(?{D}{{2}}\)?{SPACE}?{D}{{4,5}}-?{D}{{4}}{NOT_BEFORE_WORD}"
ANY_PLATE = rf"{NOT_AFTER_WORD}[A-Z]{{3}}{D}[A-Z0-9]{D}{{2}}{NOT_BEFORE_WORD}"

AUDIO_PREFIX = "[audio transcrito]"
NOTEBOOK_AUDIO = r"(?i)\[transcrição de áudio\]|\[audio transcription\]"

# --- Fixed values: usage prices per 1000 tokens (input, output) ----------------------------

PRICES = {
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o": (0.0025, 0.01),
    "anthropic/claude-3-haiku-20240307": (0.00025, 0.00125),
    "anthropic/claude-sonnet-4-20250514": (0.003, 0.015),
    "gemini/gemini-1.5-flash": (0.000075, 0.0003),
    "ollama/llama3": (0.0, 0.0),
    "ollama/mistral": (0.0, 0.0),
    "anthropic/claude-haiku-4-5": (0.0008, 0.004),
    "anthropic/claude-opus-4-6": (0.015, 0.075),
    "anthropic/claude-sonnet-4-6": (0.003, 0.015),
}
BUDGET_LIMIT = 5.0
TOKENS_PER_MINUTE = 10_000
RATE_WINDOW_SEC = 60

# --- Fixed values: chart settings -----------------------------------------------------------

WATERFALL_ORDER = (PROPOSAL, SALE, GHOSTING, LOST_PRICE, LOST_COMPETITOR, "sem_interesse")
SCORE_BINS = (0.0, 100.0, 20)
SENTIMENT_BINS = (-1.0, 1.0, 30)
TOP_BARS = 15

# Table-name patterns and the chart names drawn for them, first match wins.
KPI_KINDS = (
    ("funil_conversao", r"funil.*(convers|conversion)", ("waterfall", "bar", "gauge")),
    ("lead_scoring", r"lead.?scor", ("histogram", "box", "bar")),
    ("performance_campanha", r"performance.*(campanha|campaign)", ("bar", "bar")),
    ("performance_vendedor", r"performance.*(vendedor|seller|agent)", ("bar", "scatter")),
    ("personas", r"(classifica|persona)", ("pie", "box")),
    ("sentimento", r"sentimento|sentiment", ("pie", "histogram")),
    ("segmentacao", r"segmenta", ("bar", "heatmap")),
    ("temporal", r"temporal|time|tempo", ("area", "bar", "bar")),
    ("concorrencia", r"concorr|competitor|competit", ("bar", "bar", "bar")),
)


@dataclass(frozen=True)
class Profile:
    """All rule parameters of one variant."""

    name: str = "canonical"

    # messages
    required_columns: tuple[str, ...] = SOURCE_COLUMNS
    status_column: str = "status"
    status_rank: Mapping[str, int] = field(
        default_factory=lambda: {"failed": 0, "sent": 1, "delivered": 2, "read": 3})
    dedup_keys: tuple[str, ...] = (
        "conversation_id", "sender_phone", "message_body", "direction", "timestamp")
    metadata_keys: tuple[str, ...] = ()
    silver_version: Any = "silver_v1"

    # sentiment: weights for outcome, engagement, response, depth
    sentiment_weights: tuple[float, float, float, float] = (0.50, 0.20, 0.15, 0.15)
    sentiment_response: Bands = ((60, 0.8), (180, 0.4), (600, 0.0), (1800, -0.3))
    sentiment_response_last: float = -0.6
    sentiment_response_null: float = 0.0
    sentiment_depth: Bands = ((15, 0.6), (8, 0.3), (4, 0.0))
    sentiment_depth_last: float = -0.4
    sentiment_cut: float = 0.2

    # lead score
    score_response: Bands = ((60, 25.0), (180, 20.0), (600, 12.0), (1800, 5.0))
    score_response_last: float = 0.0
    score_response_null: float = 5.0
    score_depth: Bands = ((15, 15.0), (10, 12.0), (6, 8.0), (3, 3.0))
    score_cap: float | None = None

    # segments
    depth_segments: Bands = ((15, "alto"), (6, "medio"))
    depth_segment_last: str = "baixo"
    speed_segments: Bands = ((120, "rapido"), (600, "moderado"))
    speed_segment_last: str = "lento"
    speed_segment_null: str = "sem_dados"
    duration_segments: Bands = ((5, "flash"), (60, "curta"), (1440, "media"))
    duration_segment_last: str = "longa"
    duration_segment_null: str = "instantanea"
    quality_segments: tuple[str, str, str] = (
        "alta_qualificacao", "media_qualificacao", "baixa_qualificacao")
    origin_segments: tuple[tuple[str, str], ...] = (
        ("google", "(?i)google"),
        ("facebook", "(?i)facebook|meta"),
        ("instagram", "(?i)instagram"),
        ("indicacao", "(?i)indicacao|referral"),
    )
    origin_null: str = "desconhecido"
    upper_state: bool = False

    # sellers
    seller_speed: Bands = ((120, 30.0), (300, 20.0))
    seller_speed_last: float = 10.0
    seller_speed_null: float = 10.0


CANONICAL = Profile()

NOTEBOOK = replace(
    CANONICAL,
    name="notebook",
    required_columns=(
        "conversation_id", "message_id", "timestamp", "direction", "sender_name", "sender_phone",
        "message_type", "message_body", "message_status", "channel", "campaign_id", "agent_id",
        "lead_source", "metadata"),
    status_column="message_status",
    status_rank={"failed": 1, "sent": 2, "delivered": 3, "read": 4},
    dedup_keys=("message_id",),
    metadata_keys=("device_type", "os", "browser", "city", "state", "country"),
    silver_version=1,
    score_response=((60, 25.0), (180, 18.0), (600, 10.0)),
    score_response_last=5.0,
    score_depth=((15, 15.0), (8, 10.0), (4, 5.0)),
    score_cap=100.0,
    speed_segment_null="desconhecido",
    duration_segments=((1, "instantanea"), (5, "flash"), (60, "curta"), (1440, "media")),
    duration_segment_null="desconhecido",
    quality_segments=("alta", "media", "baixa"),
    origin_segments=(
        ("google", "(?i)google"),
        ("facebook", "(?i)facebook"),
        ("instagram", "(?i)instagram"),
        ("indicacao", "(?i)indica"),
    ),
    origin_null="outros",
    upper_state=True,
    seller_speed=((120, 100.0), (300, 75.0), (600, 50.0)),
    seller_speed_last=25.0,
    seller_speed_null=50.0,
)
