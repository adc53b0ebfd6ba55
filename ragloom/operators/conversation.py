"""Conversation analytics: query intents, context, history windows, recorded model outputs, prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.scale import BLOCK_ROWS, blocked_row_number, blocked_scan, halo_blocks
from ragloom.functions.text import blank, strip

# Intents in the order in which a verdict is searched for them.
INTENTS = [
    "process_related", "followup", "feedback", "greeting", "chitchat", "off_topic", "unclear",
]

# Phrases of the rule cascade.
GREETINGS = [
    "hi", "hallo", "hey", "guten tag", "guten morgen", "guten abend", "moin", "servus", "grüß gott", "hello", "grüezi",
]
CHITCHAT = [
    "wie geht es", "wie gehts", "wie gehts dir", "wie steht es", "wie stehts",
    "was machst du", "wer bist du", "wie heißt du", "was kannst du", "was bist du",
]
PROCESS_KEYWORDS = [
    "elternzeit", "mutterschutz", "dienstreise", "urlaub", "krankmeldung",
    "arbeitszeit", "teilzeit", "homeoffice", "gehalt", "lohn", "ALPAKA",
    "Mentoring", "Projekt", "Professor", "Tandemprogramm", "Onboarding",
    "Evaluation", "Feedback", "Akkreditierung", "Studiengang", "Qualitätsmanagement",
    "Qualifikation", "Qualifizierung", "HAWKarriere", "HAW", "Mentees", "Mentor",
    "Benefits",
    "antrag", "formular", "genehmigung", "unterschrift", "freigabe",
    "prozess", "ablauf", "workflow", "schritt", "zuständigkeit",
    "hochschule", "hka", "studium", "prüfung", "immatrikulation",
    "exmatrikulation", "anrechnung", "semester", "vorlesung",
    "notenumrechnung", "studienleistung", "creditpoints",
    "richtlinie", "vorschrift", "regelung", "gesetz", "verordnung",
]
QUESTION_WORDS = ["was ", "wie ", "wer ", "wann ", "wo ", "warum ", "welche", "können ", "muss ", "darf "]
FOLLOW_UPS = [
    "nochmal", "noch mal", "nochmals", "erneut",
    "kannst du", "könntest du", "können sie", "könnten sie",
    "bitte prüfen", "bitte nochmal", "bitte noch mal",
    "mehr dazu", "mehr informationen", "mehr details",
    "genauer", "präziser", "ausführlicher",
    "was meinst du", "wie meinst du",
    "und was ist mit", "was ist mit",
    "das verstehe ich nicht", "erkläre", "erklär",
]
CONJUNCTIONS = ["und", "oder", "aber", "also"]
CONTEXT_WORDS = [
    "sie", "er", "es", "das", "diese", "dieser", "dieses",
    "welche", "welcher", "ihn", "ihm", "ihr", "dafür", "davon",
    "dabei", "dazu", "damit", "darauf", "darüber",
]
PATTERNS = {
    "keywords": PROCESS_KEYWORDS,
    "greetings": GREETINGS,
    "chitchat": CHITCHAT,
    "questions": QUESTION_WORDS,
    "followups": FOLLOW_UPS,
}

# Lengths and confidences of the cascade.
VERIFY_BELOW = 0.90
BOOST_BELOW = 0.85
FOLLOW_UP_CHARS = 60
SUBSTANTIAL_CHARS = 200
SHORT_WORDS = 5

# Labels in prompts.
USER_LABEL = "Nutzer"
ASSISTANT_LABEL = "Assistent"
HISTORY_HEAD = "### Vorherige Konversation\n"
NO_DOCUMENTS = "Keine relevanten Dokumente gefunden."
REFORMULATION_PREFIX = "eigenständige frage:"
ANSWER_PREFIX = "antwort:"

# This library's own templates; a caller passes a table of others.
TEMPLATES = {
    "baseline": "{history}{context}\n{hint}\nQuestion: {query}\nAnswer:",
    "no_gating": "{history}{context}\nQuestion: {query}\nAnswer:",
    "fewshot": "Follow the style of the examples.\n{history}{context}\n{hint}\nQuestion: {query}\nAnswer:",
    "cot": "{history}{context}\n{hint}\nQuestion: {query}\nReason step by step, then answer:",
    "structured": "{history}{context}\n{hint}\nQuestion: {query}\nAnswer in sections:",
    "citation_first": "{history}{context}\n{hint}\nQuestion: {query}\nQuote first, then answer:",
}


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return _any([F.contains(text, F.lit(p)) for p in phrases])


def _starts_any(text: Column, phrases: Sequence[str]) -> Column:
    return _any([F.startswith(text, F.lit(p)) for p in phrases])


def _verdict(intent: str, confidence: float) -> Column:
    return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"))


def rule_verdict(text: Column, patterns: Mapping[str, Sequence[str]] = PATTERNS) -> Column:
    """(intent, confidence) of the rule cascade; intent null where the rules do not decide.

    Keywords are compared with the lower-cased query as they are, so one with capitals never matches.
    """
    q = strip(F.lower(text))
    n = F.length(q)
    greetings = patterns["greetings"]
    exact = q.isin(*greetings, *[g + "!" for g in greetings])
    opens = _starts_any(q, greetings)
    asks = _any([F.startswith(q, F.lit(w)) | F.contains(q, F.lit(" " + w)) for w in patterns["questions"]])
    # A greeting tried earlier may match as a prefix before a later one matches exactly.
    first = F.lit(None)
    for greeting in reversed(greetings):
        first = (
            F.when(q.isin(greeting, greeting + "!"), F.lit(0.95))
            .when(F.startswith(q, F.lit(greeting)) & ~F.contains(q, F.lit("?")) & (n < 15), F.lit(0.9))
            .otherwise(first)
        )
    return (
        F.when(_contains_any(q, patterns["keywords"]), _verdict("process_related", 0.95))
        .when((n < 5) & opens, _verdict("greeting", 0.95))
        .when(n < 5, _verdict("unclear", 0.8))
        .when((n < 30) & (exact | (opens & (n < 15) & ~F.contains(q, F.lit("?")))),
              F.struct(F.lit("greeting").alias("intent"), first.cast("double").alias("confidence")))
        .when(_contains_any(q, patterns["chitchat"]), _verdict("chitchat", 0.9))
        .when(asks & (n > 15), _verdict("process_related", 0.7))
    )


def classify_queries(requests: DataFrame, patterns: Mapping[str, Sequence[str]] = PATTERNS) -> DataFrame:
    """Add intent and confidence of the rules; 'ambiguous' with no confidence where a model has to decide."""
    return (
        requests.withColumn("_verdict", rule_verdict(F.col("text"), patterns))
        .withColumn("intent", F.coalesce("_verdict.intent", F.lit("ambiguous")))
        .withColumn("confidence", F.col("_verdict.confidence"))
        .drop("_verdict")
    )


def with_history_facts(conversations: DataFrame) -> DataFrame:
    """Add `history`, the number of earlier messages, and `last_assistant_chars` (null without one).

    Every message is looked at as a request whose history is the messages before it.
    """
    keys, block, order = ["conv_id"], F.floor(F.col("turn") / BLOCK_ROWS), [F.col("turn")]
    numbered = blocked_row_number(conversations, keys, block, order, "_n")
    answer = F.when(F.col("role") == "assistant", F.struct("turn", F.length("text").alias("chars")))
    upto = blocked_scan(numbered, keys, block, order, answer, "_answer", "max")
    # The row itself only counts as history of later rows.
    previous = F.lag("_answer").over(Window.partitionBy("conv_id", "_block").orderBy("_n"))
    shifted = halo_blocks(upto, "_n", 1, 0).withColumn("_before", previous).filter("_core")
    return shifted.withColumn("history", F.col("_n") - 1).withColumn(
        "last_assistant_chars", F.col("_before.chars")
    ).drop("_n", "_answer", "_before", "_block", "_core")


def classify_in_context(requests: DataFrame, patterns: Mapping[str, Sequence[str]] = PATTERNS) -> DataFrame:
    """Rules plus context; requests carry `history` and `last_assistant_chars` (see `with_history_facts`).

    Adds intent, confidence and needs_verification. Ambiguous requests keep waiting for a recorded model verdict.
    """
    q = strip(F.lower(F.col("text")))
    continued = F.col("history") >= 2
    follow_up = continued & (F.length(q) < FOLLOW_UP_CHARS) & _contains_any(q, patterns["followups"])
    ruled = classify_queries(requests, patterns)
    open_case = (F.col("intent") != "process_related") & (F.col("intent") != "ambiguous")
    unsure = open_case & (F.col("confidence") < BOOST_BELOW)
    boosted = continued & unsure & (F.coalesce("last_assistant_chars", F.lit(0)) > SUBSTANTIAL_CHARS)
    decided = ruled.withColumn(
        "_context",
        F.when(follow_up, _verdict("process_related", 0.8)).when(boosted, _verdict("process_related", 0.7)),
    )
    return (
        decided.withColumn("intent", F.coalesce("_context.intent", "intent"))
        .withColumn("confidence", F.coalesce("_context.confidence", "confidence"))
        .withColumn(
            "needs_verification",
            (F.col("intent") != "process_related")
            & (F.col("intent") != "ambiguous")
            & (F.col("confidence") < VERIFY_BELOW),
        )
        .drop("_context")
    )


def _named_intent(output: Column) -> Column:
    """First intent, in fixed order, whose name occurs in a recorded model output."""
    spoken = F.replace(F.upper(strip(output)), F.lit(" "), F.lit("_"))
    found = F.when(F.lit(False), F.lit(""))
    for intent in INTENTS:
        found = found.when(F.contains(spoken, F.lit(intent.upper())), intent)
    return found


def apply_verdicts(classified: DataFrame, verdicts: DataFrame, mode: Column | str = "hybrid") -> DataFrame:
    """Fold recorded model outputs (request_id, classification, verification) into the intents.

    mode: a literal or column of 'hybrid', 'llm_only', 'disabled'. An ambiguous request takes the named intent at 0.85
    or process at 0.5. A request that needs verification, among them those with a named intent other than process, keeps
    its intent on CONFIRM (0.1 more, at most 0.95), becomes process at 0.8 on OVERRIDE, at 0.6 if the verdict is unclear,
    at 0.5 if there is none. Model-only mode uses the named intent, else process at 0.6; disabled mode is process at 1.0.
    """
    chosen = F.lit(mode) if isinstance(mode, str) else mode
    rows = classified.join(verdicts, "request_id", "left")
    named = _named_intent(F.col("classification"))
    spoken = F.upper(strip(F.col("verification")))
    needs = F.col("needs_verification") if "needs_verification" in classified.columns else (
        ~F.col("intent").isin("process_related", "ambiguous") & (F.col("confidence") < VERIFY_BELOW)
    )

    def named_or(fallback: float) -> Column:
        return F.when(
            named.isNotNull(), F.struct(named.alias("intent"), F.lit(0.85).alias("confidence"))
        ).otherwise(_verdict("process_related", fallback))

    guessed = F.col("intent") == "ambiguous"
    given = F.struct(F.col("intent").alias("intent"), F.col("confidence").alias("confidence"))
    rows = rows.withColumn("_base", F.when(guessed, named_or(0.5)).otherwise(given))
    base = F.col("_base")
    doubtful = (base["intent"] != "process_related") & (base["confidence"] < VERIFY_BELOW)
    confirmed = F.struct(
        base["intent"].alias("intent"),
        F.least(base["confidence"] + 0.1, F.lit(0.95)).alias("confidence"),
    )
    verified = (
        F.when(spoken.isNull(), _verdict("process_related", 0.5))
        .when(F.contains(spoken, F.lit("OVERRIDE")), _verdict("process_related", 0.8))
        .when(F.contains(spoken, F.lit("CONFIRM")), confirmed)
        .otherwise(_verdict("process_related", 0.6))
    )
    final = (
        F.when(chosen == "disabled", _verdict("process_related", 1.0))
        .when(chosen == "llm_only", named_or(0.6))
        .when(F.when(guessed, doubtful).otherwise(needs), verified)
        .otherwise(base)
    )
    return (
        rows.withColumn("_final", final)
        .withColumn("intent", F.col("_final.intent"))
        .withColumn("confidence", F.col("_final.confidence"))
        .drop("_final", "_base", "classification", "verification")
    )


def route_queries(classified: DataFrame, fallbacks: DataFrame, mode: Column | str = "hybrid") -> DataFrame:
    """Add `use_rag` and the fallback text of the others; an intent without text uses the one for 'unclear'.

    fallbacks: intent, response. In disabled mode every request goes to retrieval as process at 1.0.
    """
    chosen = F.lit(mode) if isinstance(mode, str) else mode
    routed = (
        classified.withColumn("intent", F.when(chosen == "disabled", "process_related").otherwise(F.col("intent")))
        .withColumn("confidence", F.when(chosen == "disabled", 1.0).otherwise(F.col("confidence")))
        .withColumn("use_rag", F.col("intent").isin("process_related", "followup"))
    )
    default = fallbacks.filter(F.col("intent") == "unclear").select(F.first("response")).scalar()
    return (
        routed.join(fallbacks, "intent", "left")
        .withColumn("response", F.when(~F.col("use_rag"), F.coalesce("response", default)))
    )


def needs_reformulation(text: Column, history: Column) -> Column:
    """With a history: at most five words, a leading conjunction, or a word that points back."""
    words = F.filter(F.split(strip(F.lower(text)), r"(?U)\s+"), lambda w: F.length(w) > 0)
    return (history > 0) & (
        (F.size(words) <= SHORT_WORDS)
        | words[0].isin(*CONJUNCTIONS)
        | F.arrays_overlap(words, F.array(*[F.lit(w) for w in CONTEXT_WORDS]))
    )


def history_window(
    conversations: DataFrame, turns: int, chars: int, ellipsis: bool, markdown: bool | None = None
) -> DataFrame:
    """Add `history_text`: the last 2 * `turns` messages before each message, cut to `chars`.

    Plain lines 'role: text' for reformulation; with `ellipsis` (or `markdown`) the headed block of a prompt. Empty
    without history.
    """
    markdown = ellipsis if markdown is None else markdown
    label = F.when(F.col("role") == "user", USER_LABEL).otherwise(ASSISTANT_LABEL)
    cut = F.substring("text", 1, chars)
    if ellipsis:
        cut = F.when(F.length("text") > chars, F.concat(cut, F.lit("..."))).otherwise(cut)
    if markdown:
        line = F.concat(F.lit("**"), label, F.lit(":** "), cut, F.lit("\n"))
    else:
        line = F.concat(label, F.lit(": "), cut)
    block, order = F.floor(F.col("turn") / BLOCK_ROWS), [F.col("turn")]
    numbered = blocked_row_number(conversations, ["conv_id"], block, order, "_n").withColumn("_line", line)
    frame = Window.partitionBy("conv_id", "_block").orderBy("_n").rowsBetween(-2 * turns, -1)
    recent = F.array_sort(F.collect_list(F.struct("_n", "_line")).over(frame))
    text = F.array_join(F.transform(recent, lambda r: r["_line"]), "" if markdown else "\n")
    if markdown:
        text = F.when(F.size(recent) > 0, F.concat(F.lit(HISTORY_HEAD), text, F.lit("\n"))).otherwise("")
    rows = halo_blocks(numbered, "_n", 2 * turns, 0).withColumn("history_text", text).filter("_core")
    return rows.drop("_n", "_line", "_block", "_core")


def accept_reformulation(query: Column, output: Column) -> Column:
    """The recorded reformulation without quotes and prefix, if it says something new; else the query."""
    bare = F.regexp_replace(F.regexp_replace(strip(output), r'^"+|"+$', ""), r"^'+|'+$", "")
    size = len(REFORMULATION_PREFIX)
    bare = F.when(
        F.startswith(F.lower(bare), F.lit(REFORMULATION_PREFIX)), strip(F.substr(bare, F.lit(size + 1)))
    ).otherwise(bare)
    fresh = (F.length(bare) > 3) & (F.lower(bare) != F.lower(query))
    return F.when(fresh, bare).otherwise(query)


def clean_answer(output: Column) -> Column:
    """A recorded answer without reasoning blocks and answer prefix."""
    bare = strip(F.regexp_replace(output, r"(?s)<think>.*?</think>", ""))
    size = len(ANSWER_PREFIX)
    return F.when(
        F.startswith(F.lower(bare), F.lit(ANSWER_PREFIX)), strip(F.substr(bare, F.lit(size + 1)))
    ).otherwise(bare)


def build_prompts(requests: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Add `prompt` to (style, text, history_text, context, hint).

    An unknown style uses 'baseline', 'no_gating' drops the hint, and missing context is said in words.
    """
    known = F.col("style").isin(*templates)
    style = F.when(known, F.col("style")).otherwise("baseline")
    table = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    hint = F.when(style == "no_gating", "").otherwise(F.coalesce("hint", F.lit("")))
    context = F.when(blank(F.col("context")), NO_DOCUMENTS).otherwise(F.col("context"))
    # Split at the slots first, so that braces inside a filled-in text are never taken for a slot.
    values = F.create_map(
        F.lit("{history}"), F.coalesce("history_text", F.lit("")), F.lit("{context}"), context,
        F.lit("{hint}"), hint, F.lit("{query}"), F.coalesce("text", F.lit("")),
    )
    pieces = F.split(F.element_at(table, style), r"(?<=\})|(?=\{)")
    filled = F.transform(pieces, lambda p: F.coalesce(F.try_element_at(values, p), p))
    return requests.withColumn("prompt", F.array_join(filled, ""))
