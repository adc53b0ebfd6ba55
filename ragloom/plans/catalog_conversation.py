"""Queries over conversations: intents, context, history, recorded outputs, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators import conversation as conv
from ragloom.plans import datasets as data
from ragloom.plans.registry import query

# Openings put before every second message, so that the phrases of the cascade occur in the text.
OPENINGS = [
    "", "Hi", "Hallo!", "hey du", "Wie geht es dir?", "Was ist das hier genau?", "Antrag auf Urlaub", "mehr dazu bitte",
    "ok", "und das andere", "Projekt Professor", "Kannst du helfen", "Grüß Gott", "xyz abc def",
]
_OPENINGS_SQL = "[" + ", ".join(f"'{o}'" for o in OPENINGS) + "]"

_REQ = f"""req AS (SELECT conv_id, turn, conv_id || '/' || turn AS request_id, role,
  CASE WHEN (conv_id + turn) % 2 = 0 THEN text ELSE {_OPENINGS_SQL}[1 + (conv_id * 3 + turn) % {len(OPENINGS)}]
  END AS text FROM conversations)"""


def _requests(spark, d) -> DataFrame:
    openings = F.array(*[F.lit(o) for o in OPENINGS])
    pick = ((F.col("conv_id") * 3 + F.col("turn")) % len(OPENINGS)).cast("int")
    return data.turns(spark, d).select(
        "conv_id", "turn",
        F.concat_ws("/", "conv_id", "turn").alias("request_id"),
        "role",
        F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, F.col("text")).otherwise(openings[pick]).alias("text"),
    )


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_RULES = f"""norm AS (SELECT *, trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) AS q FROM req),
flags AS (SELECT *, length(q) AS n,
  len(list_filter({_list(conv.PROCESS_KEYWORDS)}, lambda w: contains(q, w))) > 0 AS kw,
  list_filter({_list(conv.GREETINGS)}, lambda w: starts_with(q, w)) AS gs,
  len(list_filter({_list(conv.CHITCHAT)}, lambda w: contains(q, w))) > 0 AS chat,
  len(list_filter({_list(conv.QUESTION_WORDS)}, lambda w: starts_with(q, w) OR contains(q, ' ' || w))) > 0 AS asks,
  len(list_filter({_list(conv.FOLLOW_UPS)}, lambda w: contains(q, w))) > 0 AS fup FROM norm),
ruled AS (SELECT *, CASE
  WHEN kw THEN 'process_related|0.95' WHEN n < 5 AND len(gs) > 0 THEN 'greeting|0.95' WHEN n < 5 THEN 'unclear|0.8'
  WHEN n < 30 AND len(gs) > 0 AND (q = gs[1] OR q = gs[1] || '!') THEN 'greeting|0.95'
  WHEN n < 15 AND len(gs) > 0 AND NOT contains(q, '?') THEN 'greeting|0.9'
  WHEN n < 30 AND len(list_filter(gs, lambda w: q = w OR q = w || '!')) > 0 THEN 'greeting|0.95'
  WHEN chat THEN 'chitchat|0.9' WHEN asks AND n > 15 THEN 'process_related|0.7' ELSE 'ambiguous|' END AS v FROM flags)"""


@query(
    "classify_queries",
    f"""WITH {_REQ}, {_RULES} SELECT request_id, split_part(v, '|', 1) AS intent,
  try_cast(split_part(v, '|', 2) AS DOUBLE) AS confidence FROM ruled""",
)
def classify_queries(spark, d) -> DataFrame:
    return conv.classify_queries(_requests(spark, d)).select("request_id", "intent", "confidence")


_CONTEXT = f"""{_REQ}, {_RULES}, hist AS (SELECT request_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS history,
  coalesce(last_value(CASE WHEN role = 'assistant' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id
    ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars FROM req),
based AS (SELECT request_id, conv_id, turn, role, text, history, CASE
  WHEN history >= 2 AND n < 60 AND fup THEN 'process_related|0.8'
  WHEN history >= 2 AND split_part(v, '|', 1) NOT IN ('process_related', 'ambiguous')
    AND try_cast(split_part(v, '|', 2) AS DOUBLE) < 0.85 AND chars > 200 THEN 'process_related|0.7' ELSE v END AS v
  FROM ruled JOIN hist USING (request_id)),
ctx AS (SELECT request_id, conv_id, turn, role, text, history, split_part(v, '|', 1) AS intent,
  try_cast(split_part(v, '|', 2) AS DOUBLE) AS confidence FROM based)"""


def _classified(spark, d) -> DataFrame:
    return conv.classify_in_context(conv.with_history_facts(_requests(spark, d)))


@query(
    "classify_in_context",
    f"""WITH {_CONTEXT} SELECT request_id, history, intent, confidence,
  intent NOT IN ('process_related', 'ambiguous') AND confidence < 0.9 AS needs_verification FROM ctx""",
)
def classify_in_context(spark, d) -> DataFrame:
    rows = _classified(spark, d).select("request_id", "history", "intent", "confidence", "needs_verification")
    return rows.withColumn("needs_verification", F.coalesce("needs_verification", F.lit(False)))


_FALLBACKS = {"greeting": "Hello there", "chitchat": "Nice talk", "unclear": "Please say more"}


@query(
    "route_queries",
    f"""WITH {_CONTEXT} SELECT request_id, intent, intent IN ('process_related', 'followup') AS use_rag,
  CASE WHEN intent IN ('process_related', 'followup') THEN NULL WHEN intent = 'greeting' THEN 'Hello there'
  WHEN intent = 'chitchat' THEN 'Nice talk' ELSE 'Please say more' END AS response FROM ctx""",
)
def route_queries(spark, d) -> DataFrame:
    fallbacks = spark.createDataFrame(list(_FALLBACKS.items()), "intent string, response string")
    return conv.route_queries(_classified(spark, d), fallbacks).select("request_id", "intent", "use_rag", "response")


# Recorded outputs come from the turn number; every seventh request has none.
_OUTPUTS = ["off topic", "It is PROCESS RELATED.", "followup", "no idea", "GREETING or CHITCHAT"]
_VERDICTS = ["CONFIRM", "override it", "perhaps"]


@query(
    "apply_verdicts",
    f"""WITH {_CONTEXT}, said AS (SELECT *, CASE (conv_id + turn * 5) % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'llm_only'
  ELSE CASE WHEN turn = 3 THEN 'disabled' ELSE 'hybrid' END END AS mode,
  CASE WHEN (conv_id + turn) % 7 <> 0 THEN {_list(_OUTPUTS)}[1 + (conv_id + turn) % 5] END AS c,
  CASE WHEN (conv_id + turn) % 7 <> 0 THEN {_list(_VERDICTS)}[1 + (conv_id + turn) % 3] END AS v FROM ctx),
named AS (SELECT *, CASE c WHEN 'off topic' THEN 'off_topic' WHEN 'It is PROCESS RELATED.' THEN 'process_related'
  WHEN 'followup' THEN 'followup' WHEN 'GREETING or CHITCHAT' THEN 'greeting' END AS nm FROM said),
basis AS (SELECT *, CASE WHEN intent = 'ambiguous' THEN coalesce(nm, 'process_related') ELSE intent END AS bi,
  CASE WHEN intent = 'ambiguous' THEN CASE WHEN nm IS NULL THEN 0.5 ELSE 0.85 END ELSE confidence END AS bc FROM named),
folded AS (SELECT request_id, CASE WHEN mode = 'disabled' THEN 'process_related|1.0'
  WHEN mode = 'llm_only' THEN coalesce(nm || '|0.85', 'process_related|0.6')
  WHEN bi <> 'process_related' AND bc < 0.9 THEN CASE WHEN v IS NULL THEN 'process_related|0.5'
    WHEN v = 'override it' THEN 'process_related|0.8' WHEN v = 'CONFIRM' THEN bi || '|' || least(bc + 0.1, 0.95)
    ELSE 'process_related|0.6' END
  ELSE bi || '|' || bc END AS f FROM basis)
SELECT request_id, split_part(f, '|', 1) AS intent, round(split_part(f, '|', 2)::DOUBLE, 6) AS confidence FROM folded""",
)
def apply_verdicts(spark, d) -> DataFrame:
    total = F.col("conv_id") + F.col("turn")
    spoken = total % 7 != 0
    outputs = F.array(*[F.lit(o) for o in _OUTPUTS])[(total % 5).cast("int")]
    answers = F.array(*[F.lit(v) for v in _VERDICTS])[(total % 3).cast("int")]
    verdicts = _requests(spark, d).select(
        "request_id", F.when(spoken, outputs).alias("classification"), F.when(spoken, answers).alias("verification")
    )
    third = (F.col("conv_id") + F.col("turn") * 5) % 3
    mode = F.when(third == 1, "llm_only").when((third == 2) & (F.col("turn") == 3), "disabled").otherwise("hybrid")
    return conv.apply_verdicts(_classified(spark, d), verdicts, mode).select(
        "request_id", "intent", F.round("confidence", 6).alias("confidence")
    )


@query(
    "needs_reformulation",
    f"""WITH {_REQ}, w AS (SELECT request_id, turn,
  list_filter(regexp_split_to_array(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '\\s+'), lambda x: x <> '') AS words
  FROM req)
SELECT request_id, turn > 0 AND (len(words) <= 5 OR words[1] IN ('und', 'oder', 'aber', 'also')
  OR list_has_any(words, {_list(conv.CONTEXT_WORDS)})) AS needed FROM w""",
)
def needs_reformulation(spark, d) -> DataFrame:
    return _requests(spark, d).select(
        "request_id", conv.needs_reformulation(F.col("text"), F.col("turn")).alias("needed")
    )


def _history_sql(turns: int, line: str, head: str, tail: str, separator: str) -> str:
    return f"""WITH h AS (SELECT conv_id, turn, list(line) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN {2 * turns} PRECEDING AND 1 PRECEDING) AS lines FROM (SELECT conv_id, turn, {line} AS line
  FROM conversations))
SELECT conv_id, turn, CASE WHEN lines IS NULL OR len(lines) = 0 THEN md5('') ELSE
  md5({head} || array_to_string(lines, {separator}) || {tail}) END AS history_text FROM h"""


_LABEL = "CASE WHEN role = 'user' THEN 'Nutzer' ELSE 'Assistent' END"


@query(
    "history_window_plain",
    _history_sql(2, f"{_LABEL} || ': ' || substr(text, 1, 150)", "''", "''", "chr(10)"),
)
def history_window_plain(spark, d) -> DataFrame:
    rows = conv.history_window(data.turns(spark, d), 2, 150, ellipsis=False)
    return rows.select("conv_id", "turn", F.md5("history_text").alias("history_text"))


_MARKED = (
    f"'**' || {_LABEL} || ':** ' || substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END || chr(10)"
)


@query(
    "history_window_prompt",
    _history_sql(3, _MARKED, "'### Vorherige Konversation' || chr(10)", "chr(10)", "''"),
)
def history_window_prompt(spark, d) -> DataFrame:
    rows = conv.history_window(data.turns(spark, d), 3, 200, ellipsis=True)
    return rows.select("conv_id", "turn", F.md5("history_text").alias("history_text"))


@query(
    "accept_reformulation",
    """SELECT conv_id, turn, md5(CASE turn % 4 WHEN 0 THEN substr(text, 1, 40) WHEN 1 THEN 'Neu ' || conv_id
  WHEN 2 THEN substr(text, 1, 40) ELSE 'Was ist ' || turn END) AS accepted FROM conversations""",
)
def accept_reformulation(spark, d) -> DataFrame:
    kind, asked = F.col("turn") % 4, F.substring("text", 1, 40)
    output = (
        F.when(kind == 0, F.concat(F.lit('"'), F.lower(asked), F.lit('"')))
        .when(kind == 1, F.concat(F.lit(' "Neu '), F.col("conv_id").cast("string"), F.lit('"\n')))
        .when(kind == 2, F.lit("abc"))
        .otherwise(F.concat(F.lit("Eigenständige Frage:  Was ist "), F.col("turn").cast("string")))
    )
    return data.turns(spark, d).select(
        "conv_id", "turn", F.md5(conv.accept_reformulation(asked, output)).alias("accepted")
    )


@query(
    "clean_answers",
    """SELECT conv_id, turn, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS answer FROM conversations
WHERE role = 'assistant'""",
)
def clean_answers(spark, d) -> DataFrame:
    raw = F.concat(F.lit("<think>why\nso</think>\n Antwort: "), F.col("text"), F.lit(" <think>x</think>"))
    return data.turns(spark, d).filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.md5(conv.clean_answer(raw)).alias("answer")
    )


@query(
    "build_prompts",
    """WITH p AS (SELECT conv_id, turn, text, ['baseline', 'no_gating', 'fewshot', 'cot', 'structured', 'citation_first',
  'other'][1 + turn % 7] AS style, CASE WHEN turn % 2 = 0 THEN 'Keine relevanten Dokumente gefunden.'
  ELSE 'doc {query} ' || conv_id END AS context, 'hint ' || turn AS hint FROM conversations)
SELECT conv_id, turn, md5(CASE style WHEN 'fewshot' THEN 'Follow the style of the examples.' || chr(10) ELSE '' END
  || 'H' || context || chr(10) || CASE style WHEN 'no_gating' THEN '' ELSE hint || chr(10) END || 'Question: ' || text
  || chr(10) || CASE style WHEN 'cot' THEN 'Reason step by step, then answer:' WHEN 'structured' THEN 'Answer in sections:'
  WHEN 'citation_first' THEN 'Quote first, then answer:' ELSE 'Answer:' END) AS prompt FROM p""",
)
def build_prompts(spark, d) -> DataFrame:
    styles = ["baseline", "no_gating", "fewshot", "cot", "structured", "citation_first", "other"]
    rows = data.turns(spark, d).select(
        "conv_id", "turn", "text",
        F.array(*[F.lit(s) for s in styles])[(F.col("turn") % 7).cast("int")].alias("style"),
        F.lit("H").alias("history_text"),
        F.when(F.col("turn") % 2 == 0, " ").otherwise(F.concat(F.lit("doc {query} "), F.col("conv_id").cast("string")))
        .alias("context"),
        F.concat(F.lit("hint "), F.col("turn").cast("string")).alias("hint"),
    )
    return conv.build_prompts(rows).select("conv_id", "turn", F.md5("prompt").alias("prompt"))
