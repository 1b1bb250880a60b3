"""Match sets: which lexicon lists feed which step of the triage."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from fnmatch import fnmatchcase
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.config import DEFAULT_TERM_WEIGHT, LEXICON_CATEGORIES, TEMPLATE_PATTERNS
from chatsieve.operators.bounds import collect_bounded
from chatsieve.operators.templates import expand_templates
from chatsieve.sources.lexicon import dialect_from_documents, lexicon_from_documents, numbers_from_documents

# List paths (`*` is one path part) of each match set.
MATCH_SETS: dict[str, tuple[str, ...]] = {
    "intent": ("intent_verbs.*.terms",),
    "object": ("academic_objects.*.terms",),
    "request": ("intent_verbs.*.terms", "request_phrases.*", "request"),
    "context": ("academic_objects.*.terms", "university_context.*", "request_context"),
    "implicit": ("implicit_request_patterns.availability_question", "implicit_request_patterns.problem_state"),
    "indirect": ("indirect_request", "implicit_request_patterns.availability_question",
                 "implicit_request_patterns.problem_state"),
    "urgency": ("urgency_markers.*", "urgency"),
    "ignore": ("ignore_signals.*", "ignore"),
    "spam": ("spam_categories.*", "spam_patterns"),
    "ad_blocker": ("ad_blockers",),
    "advertisement": ("advertisement_signals.hard_signals", "advertisement_signals.medium_signals",
                      "advertisement"),
    "education": ("advertisement_signals.institution_terms", "education_providers"),
    "ad_emoji": ("emoji_signals.ad_style_emoji", "emoji_advertisement"),
    "hard_signal": ("advertisement_signals.hard_signals",),
    "medium_signal": ("advertisement_signals.medium_signals",),
    "cta_signal": ("advertisement_signals.cta_signals",),
    "institution": ("advertisement_signals.institution_terms",),
    "strong_provider": ("advertisement_signals.provider_profile.strong_provider",),
    "weak_provider": ("advertisement_signals.provider_profile.weak_provider",),
    "individual_provider": ("advertisement_signals.provider_profile.individual_provider",),
    "payment": ("advertisement_signals.price_signals.payment_methods.terms",),
    "resolution": ("negation.resolution_phrases",),
    "post_negator": ("negation.post_clause_negators",),
    "pre_negator": ("negation.pre_verb_negators.terms",),
    "negation_exception": ("negation.negation_exceptions",),
    "clause_boundary": ("negation.clause_boundaries",),
    "boost_base": ("high_confidence_boost_patterns.patterns",),
    "subject": ("subject_markers.student_pronouns", "subject_markers.student_question_subject"),
    "action": ("action_verbs.core", "action_verbs.suffixed_forms", "action_verbs.imperative_forms"),
}


@dataclass(frozen=True)
class Band:
    low: int
    high: int | None
    value: float


@dataclass(frozen=True)
class TriageLexicon:
    """Driver-side match sets of one lexicon version, each in lexicon order."""

    sets: dict[str, list[str]]
    intent_weights: dict[str, float] = field(default_factory=dict)
    object_weights: dict[str, float] = field(default_factory=dict)
    distance_bands: tuple[Band, ...] = ()
    length_bands: tuple[Band, ...] = ()
    dialect: dict[str, str] = field(default_factory=dict)

    def terms(self, name: str) -> list[str]:
        return self.sets.get(name, [])


def parse_bands(rows: Iterable[tuple[str, float | None]], open_key: str | None = None) -> tuple[Band, ...]:
    """`a_to_b` keys (and one open-ended key) to bands, order kept, other keys skipped."""
    bands = []
    for key, value in rows:
        low, sep, high = key.partition("_to_")
        if value is None:
            continue
        if key == open_key:
            bands.append(Band(int(key.split("_")[0]), None, value))
        elif sep and low.strip().isdigit() and high.strip().isdigit():
            bands.append(Band(int(low), int(high), value))
    return tuple(bands)


def compile_json(text: str, weights: DataFrame | None = None) -> TriageLexicon:
    """Match sets, bands and dialect map of one lexicon document held on the driver.

    The table form of the same document comes from `sources.lexicon`.
    """
    doc = {k: v for k, v in json.loads(text).items() if k in LEXICON_CATEGORIES}
    rows: list[tuple[str, str, float]] = []

    def visit(node, path: str, hint) -> None:
        if isinstance(node, list):
            if all(isinstance(x, str) for x in node):
                rows.extend((path, x, hint) for x in node)
        elif isinstance(node, dict):
            own = node.get("_weight_hint", DEFAULT_TERM_WEIGHT)
            for key, child in node.items():
                if not key.startswith("_"):
                    visit(child, f"{path}.{key}" if path else key, own)

    visit(doc, "", DEFAULT_TERM_WEIGHT)
    slots = {tag: [t for p, t, _ in rows if p == f"templates.{tag}"] for tag in
             ("need", "person", "action", "expert", "availability")}
    wanted = [" ".join(t.split()) for p, t, _ in rows if p == "template_patterns"]
    phrases = sorted({
        " ".join(words) for pattern in wanted if pattern in TEMPLATE_PATTERNS
        for words in product(*(slots[tag.strip("<>")] for tag in pattern.split(" ")))})
    thresholds = doc.get("distance_scoring_config", {}).get("thresholds", {})
    distance = [(k, float(v.get("score_multiplier", 0.15 if k == "16_plus" else 1.0)))
                for k, v in thresholds.items() if isinstance(v, dict)]
    lengths = [(k, float(v)) for k, v in doc.get("length_modifier", {}).items()]
    dialect = {k: v for region in doc.get("dialect_mapping", {}).values() if isinstance(region, dict)
               for k, v in region.items()}
    return _build(rows, phrases, weights, distance_bands=parse_bands(distance, "16_plus"),
                  length_bands=parse_bands(lengths), dialect=dialect)


def compile_lexicon(
    lexicon: DataFrame, boost_phrases: DataFrame | None = None, weights: DataFrame | None = None, **parts
) -> TriageLexicon:
    """Match sets of a lexicon table (and a table of boost phrases), sizes checked."""
    rows = collect_bounded(lexicon.select("path", "term", "weight", "pos", "ord"), "lexicon")
    rows.sort(key=lambda r: (r["ord"], r["pos"]))
    phrases = [] if boost_phrases is None else sorted(
        r["phrase"] for r in collect_bounded(boost_phrases, "boost phrases"))
    return _build([(r["path"], r["term"], r["weight"]) for r in rows], phrases, weights, **parts)


def compile_documents(docs: DataFrame, doc: str = "doc", weights: DataFrame | None = None) -> TriageLexicon:
    """The same of lexicon documents held in a table: lists, templates, bands and dialect map are read in Spark, then brought together."""
    lexicon = lexicon_from_documents(docs, doc)
    slots = lexicon.filter(F.col("category") == "templates").select(F.col("grp").alias("tag"), "term")
    patterns = lexicon.filter(F.col("path") == "template_patterns").select(F.col("term").alias("pattern"))

    def numbers(root: str, leaf: str | None) -> list[tuple[str, float | None]]:
        rows = collect_bounded(numbers_from_documents(docs, root, leaf, doc), root)
        return [(r["key"], r["value"]) for r in sorted(rows, key=lambda r: r["pos"])]

    distance = [(k, (0.15 if k == "16_plus" else 1.0) if v is None else v)
                for k, v in numbers("distance_scoring_config.thresholds", "score_multiplier")]
    dialect = {r["variant"]: r["canonical"] for r in collect_bounded(dialect_from_documents(docs, doc), "dialect map")}
    return compile_lexicon(
        lexicon, expand_templates(slots, patterns), weights, distance_bands=parse_bands(distance, "16_plus"),
        length_bands=parse_bands(numbers("length_modifier", None)), dialect=dialect)


def _build(
    rows: list[tuple[str, str, float]], boost: list[str], weights: DataFrame | None, **parts
) -> TriageLexicon:
    def listed(path: str, patterns: tuple[str, ...]) -> bool:
        return any(fnmatchcase(path, p) and path.count(".") == p.count(".") for p in patterns)

    sets = {name: [t for t in dict.fromkeys(term for path, term, _ in rows if listed(path, paths)) if t]
            for name, paths in MATCH_SETS.items()}
    sets["boost"] = list(dict.fromkeys(sets["boost_base"] + boost))
    learned = {kind: {term: weight for path, term, weight in rows if listed(path, MATCH_SETS[name])}
               for kind, name in (("intent", "intent"), ("academic", "object"))}
    if weights is not None:
        for r in collect_bounded(weights.select("kind", "term", "weight"), "term weights"):
            learned[r["kind"]][r["term"]] = r["weight"]
    return TriageLexicon(sets, learned["intent"], learned["academic"], **parts)
