"""Query plans from text by rules: mentions, cues, constraints, target type, intent and probes.

All of it is column expressions over a batch of queries (query_id, text); null text gives empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of questions and the type they ask for, words of intents, and stop words.
QUESTIONS = {"who": "person", "whom": "person", "where": "location", "when": "temporal", "what time": "temporal"}
ASSOCIATION = ("between", "connect", "link", "related", "association", "via")
BRIDGE = ("bridge", "path", "through", "from", "to")
STOP = "a an and are as at be been but by can did do does for from had has have he her his how if in into is it its no not of on one or she so some than that the their them then there they this to two was we were what when where which who will with would you".split()
#: Verbs that count as relation cues.
VERBS = "argued assembled balanced borrowed catalogued cleaned closed connected cooled counted dismantled drained emptied extended filled guarded inspected kept leased left loaded lowered mapped marked measured moved noted opened praised raised reached rejected repaired replaced restored said sealed sold sorted stored tested used warmed weighed widened".split()

SPAN, WORDS, NUMBERS, SENTENCE = "[A-Z][a-z]+(?: [A-Z][a-z]+)*", "[a-z]+", "[0-9]+", "[^.!?]+[.!?]*"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def target_type(lower: Column) -> Column:
    out = F.lit(None).cast("string")
    for cue, kind in reversed(QUESTIONS.items()):
        out = F.when(lower.startswith(cue + " ") | lower.contains(f" {cue} "), kind).otherwise(out)
    return out


def intent(lower: Column) -> Column:
    has = lambda words: F.lit(False) if not words else _any([lower.contains(w) for w in words])
    return F.when(has(ASSOCIATION), "association").when(has(BRIDGE), "bridge").otherwise("lookup")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out |= t
    return out


def plans(queries: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    lower = F.lower(text)
    words = F.array_distinct(_all(lower, WORDS))
    mentions = F.array_distinct(_all(text, SPAN))
    out = queries.select(
        "query_id",
        text.alias("text"),
        mentions.alias("mentions"),
        F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP)).alias("aliases"),
        F.filter(words, lambda w: w.isin(*VERBS)).alias("relation_cues"),
        _all(text, NUMBERS).alias("constraints"),
        target_type(lower).alias("target_type"),
        intent(lower).alias("intent"),
        F.filter(F.transform(_all(text, SENTENCE), lambda s: F.trim(s)), lambda s: s != "").alias("probes"),
    )
    return out.withColumn("aliases", F.array_except("aliases", F.transform("mentions", lambda m: F.lower(m))))


def probes(p: DataFrame) -> DataFrame:
    """(query_id, probe_no, text, weight): every sentence with weight 1, every mention with weight 0.5."""
    s = p.select("query_id", F.posexplode("probes").alias("probe_no", "text"), F.lit(1.0).alias("weight"))
    m = p.select("query_id", F.posexplode("mentions").alias("probe_no", "text"), F.lit(0.5).alias("weight"))
    return s.unionByName(m)
