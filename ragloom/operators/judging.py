"""Scores from recorded judge outputs. The judges themselves are models and not part of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import blank, strip

# Scale of the judges and accepted response types.
DEFAULT_SCORE = 3.0
ALLOWED_TYPES = ["qualified_answer", "clarification", "escalation"]
STEERING_TYPES = ["clarification", "escalation"]
STEADY_SCORE = 4


def parse_judge(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `parsed`, the first brace block without inner braces as JSON text, and `error` where there is none."""
    block = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{[^{}]*\}", 0)
    valid = F.try_parse_json(block).isNotNull() & (F.length(block) > 0)
    return outputs.withColumn("parsed", F.when(valid, block)).withColumn(
        "error", F.when(~valid, F.lit("Could not parse response"))
    )


def score(parsed: Column, field: str = "score") -> Column:
    """A score clamped to 1..5: a number as it is, a string if it holds an integer, else 3."""
    text = F.get_json_object(parsed, f"$.{field}")
    quoted = F.rlike(parsed, F.lit(rf'"{field}"\s*:\s*"'))
    whole = F.when(F.rlike(strip(text), F.lit(r"^[+-]?\d+$")), strip(text).try_cast("double"))
    number = F.when(quoted, whole).otherwise(text.try_cast("double"))
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.coalesce(number, F.lit(DEFAULT_SCORE))))


def normalised(value: Column) -> Column:
    return (value - 1) / 4.0


def _items(parsed: Column, field: str) -> Column:
    """Number of entries of a list field; 0 without it."""
    listed = F.from_json(F.get_json_object(parsed, f"$.{field}"), "array<string>")
    return F.coalesce(F.size(listed), F.lit(0))


def _count(parsed: Column, field: str) -> Column:
    return F.greatest(_items(parsed, field), F.lit(0))


def reasoning(parsed: Column) -> Column:
    return F.coalesce(F.get_json_object(parsed, "$.reasoning"), F.lit(""))


def judge_scores(parsed: DataFrame) -> DataFrame:
    """Add score and normalised score of the relevance, faithfulness and consistency judges."""
    return parsed.withColumn("score", score(F.col("parsed"))).withColumn("normalized", normalised(F.col("score")))


def judge_gating(parsed: DataFrame, hint: str = "hint") -> DataFrame:
    """Add h2_* columns; without a hint nothing is applied and the error rate is 0."""
    none = blank(F.col(hint))
    value = score(F.col("parsed"))

    def applied(column: Column) -> Column:
        return F.when(~none, column)

    return (
        parsed.withColumn("h2_error_rate", F.when(none, 0.0).otherwise((5 - value) / 4.0))
        .withColumn("h2_gating_applied", F.when(none, 0.0).otherwise(1.0))
        .withColumn("h2_score", applied(value))
        .withColumn("h2_mentions_outside_context", applied(_count(F.col("parsed"), "mentions_outside_context")))
        .withColumn("h2_hallucinated_steps", applied(_count(F.col("parsed"), "hallucinated_steps")))
    )


def _share(part: Column, total: Column) -> Column:
    return part / F.greatest(total, F.lit(1))


def judge_by_query_type(parsed: DataFrame, query_type: str = "query_type") -> DataFrame:
    """Add the scores of structure, knowledge and mixed questions; columns of other types are null."""
    p = F.col("parsed")
    kind = F.col(query_type)
    from_hint, outside = _count(p, "mentioned_from_hint"), _count(p, "mentioned_outside_hint")
    invented = _count(p, "hallucinated")
    mentioned = from_hint + outside + invented
    inside, out_of_scope = _count(p, "mentioned_tasks_in_scope"), _count(p, "mentioned_tasks_out_of_scope")
    made_up = _count(p, "hallucinated_tasks")
    tasks = inside + out_of_scope + made_up
    parts = [score(p, f"{name}_score") for name in ("structure", "knowledge", "integration")]
    structure, knowledge, mixed = kind == "structure", kind == "knowledge", kind == "mixed"
    return (
        parsed.withColumn("structure_violation_rate", F.when(structure, _share(outside + invented, mentioned)))
        .withColumn("hint_adherence", F.when(structure, _share(from_hint, mentioned)))
        .withColumn(
            "hallucination_rate",
            F.when(structure, _share(invented, mentioned)).when(mixed, _share(made_up, tasks)),
        )
        .withColumn("knowledge_score", F.when(knowledge, (5 - score(p)) / 4.0))
        .withColumn("context_violation_count", F.when(knowledge, _count(p, "out_of_context_mentions")))
        .withColumn("combined_score", F.when(mixed, (parts[0] + parts[1] + parts[2]) / 3.0))
        .withColumn("scope_violation_rate", F.when(mixed, _share(out_of_scope + made_up, tasks)))
    )


def _flag(parsed: Column, field: str) -> Column:
    """A boolean or the word 'true'."""
    text = F.get_json_object(parsed, f"$.{field}")
    return F.coalesce(F.lower(strip(text)) == "true", F.lit(False))


def judge_grey_zone(parsed: DataFrame, context_empty: Column) -> DataFrame:
    """Add h3_* columns: whether an unclear case was handled appropriately."""
    p = F.col("parsed")
    value = F.floor(score(p)).cast("double")
    speculation, uncertain = _flag(p, "speculation_detected"), _flag(p, "uncertainty_expressed")
    kind = F.lower(strip(F.coalesce(F.get_json_object(p, "$.response_type"), F.lit("unknown"))))
    steering = kind.isin(*STEERING_TYPES)
    grounded = ~context_empty & (uncertain | steering | (value >= STEADY_SCORE))
    cautious = context_empty & (steering | uncertain)
    appropriate = ~speculation & kind.isin(*ALLOWED_TYPES) & (grounded | cautious)
    return (
        parsed.withColumn("h3_appropriate_handling", appropriate.cast("int").cast("double"))
        .withColumn("h3_speculation_detected", speculation.cast("int").cast("double"))
        .withColumn("h3_uncertainty_expressed", uncertain.cast("int").cast("double"))
        .withColumn("h3_score", value)
        .withColumn("h3_response_type", kind)
    )
