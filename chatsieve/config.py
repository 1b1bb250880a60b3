"""Tunable settings, script profiles and fixed values shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
# Character classes are written in the \x{h} notation that Java understands.

# White space as text splitting sees it (Unicode spaces and separators).
WS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

PHONE_PATTERN = rf"(\+?\p{{Nd}}{{1,3}}[.\-{WS}]?)?\p{{Nd}}{{3}}[.\-{WS}]?\p{{Nd}}{{3}}[.\-{WS}]?\p{{Nd}}{{4}}"
URL_HEADS = (
    "https?://", r"www\.", r"t\.me/", r"telegram\.me/", r"wa\.me/",
    r"bit\.ly/", r"tinyurl\.com/", r"goo\.gl/", r"linktr\.ee/",
)
URL_PATTERN = "|".join(rf"{head}[^{WS}]+" for head in URL_HEADS)
EMAIL_PATTERN = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
REPEAT_PATTERN = r"(.)\1{4,}"
HTML_TAG_PATTERN = r"(?i)<\s*(script|iframe|object|embed|form|input)"

# Emoji blocks; the last range is wide on purpose (it also takes in CJK and others).
EMOJI_BLOCKS = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}"
    r"\x{2702}-\x{27B0}"
)
EMOJI_WIDE_BLOCK = r"\x{24C2}-\x{1F251}"
EMOJI_ENCLOSED_BLOCK = r"\x{24C2}-\x{24FF}\x{1F100}-\x{1F251}"

# Punctuation that, with white space and the text ends, delimits a dialect variant.
TERM_BOUNDARY = rf"{WS}.,!?\x{{61F}}\x{{60C}}"

# Top-level lexicon keys that are read; anything else in the document is dropped.
LEXICON_CATEGORIES = (
    "request", "advertisement", "ignore", "emoji_advertisement",
    "education_providers", "ad_blockers", "request_context",
    "indirect_request", "urgency", "spam_patterns",
    "intent_verbs", "academic_objects", "request_phrases",
    "urgency_markers", "negation", "advertisement_signals",
    "spam_categories", "emoji_signals", "ignore_signals",
    "dialect_mapping", "university_context", "distance_scoring_config",
    "length_modifier", "scoring_weights", "explainability",
    "conversation_history_config", "test_cases", "learning_feedback",
    "high_confidence_boost_patterns", "action_verbs", "subject_markers",
    "implicit_request_patterns", "solve_actions", "help_expressions",
    "templates", "template_patterns",
)

# The slot sequences a phrase template may have.
TEMPLATE_PATTERNS = (
    "<need> <person>", "<need> <expert>",
    "<availability> <person>", "<availability> <action>", "<availability> <expert>",
    "<need> <person> <action>", "<availability> <person> <action>",
)

DEFAULT_TERM_WEIGHT = 0.7
LOG_LEVELS = ("DEBUG", "INFO", "SUCCESS", "WARNING", "ERROR", "CRITICAL")
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class ScriptProfile:
    """What counts as the message language's script and how its letters fold."""

    name: str
    letters: str      # class body: letters counted by script detection
    block: str        # class body: characters counted by the prefilter
    fold_from: str    # letters folded during normalization ...
    fold_to: str      # ... and what they fold to
    strip: str        # class body: marks removed during normalization ("" for none)


ARABIC = ScriptProfile(
    name="ar",
    letters="ابتثجحخدذرزسشصضطظعغفقكلمنهويأإؤئآة",
    block=r"\x{0600}-\x{06FF}",
    fold_from="أإآةىئؤ",
    fold_to="اااهييو",
    strip=r"\x{064B}-\x{0652}\x{0640}",
)
LATIN = ScriptProfile(
    name="latin",
    letters=r"a-z\x{DF}-\x{F6}\x{F8}-\x{FF}",
    block=r"a-z\x{DF}-\x{F6}\x{F8}-\x{FF}",
    fold_from="",
    fold_to="",
    strip="",
)


@dataclass(frozen=True)
class TriageConfig:
    min_len: int = 10
    max_len: int = 5000
    prefilter_enabled: bool = True
    min_words: int = 2
    max_emojis: int = 5
    min_block_ratio: float = 0.1
    strict_emoji: bool = False
    language_filter: bool = True
    spam_threshold: float = 0.7
    fuzzy_enabled: bool = True
    fuzzy_cutoff: float = 85.0
    fuzzy_discount: float = 0.85
    negation_enabled: bool = True
    clause_boundaries_enabled: bool = True
    negation_scope_tokens: int = 6
    ad_detection_enabled: bool = True
    weak_provider_threshold: int = 2
    ad_emoji_threshold: int = 3
    distance_scoring_enabled: bool = True
    score_direct: int = 60
    score_context_max: int = 20
    score_indirect: int = 25
    score_urgency: int = 15
    score_min_valid: int = 50
    weight_intent: float = 0.30
    weight_object: float = 0.25
    weight_grammar: float = 0.15
    weight_distance: float = 0.15
    weight_urgency: float = 0.05
    weight_context: float = 0.10
    accept_threshold: float = 0.65
    review_threshold: float = 0.40

    @property
    def emoji_class(self) -> str:
        tail = EMOJI_ENCLOSED_BLOCK if self.strict_emoji else EMOJI_WIDE_BLOCK
        return f"[{EMOJI_BLOCKS}{tail}]"
