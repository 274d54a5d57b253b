"""From text to graph: candidate spans, triples by rules, co-occurrence, reinforcement."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from mnemic.operators.planner import SENTENCE, SPAN, STOP, VERBS, _all
from mnemic.schemas import MAX_WEIGHT
from mnemic.session import spread

# Coarse types of labels of named spans.
COARSE = {"PERSON": "person", "ORG": "org", "GPE": "place", "LOC": "place", "FAC": "place", "DATE": "temporal", "TIME": "temporal", "EVENT": "event", "PRODUCT": "thing", "WORK_OF_ART": "thing"}
GAIN, LOSS = 0.5, 0.25

_SPAN, _SENTENCE = re.compile(SPAN), re.compile(SENTENCE)
_SVO = re.compile(rf"({SPAN})\s(?:had\s|has\s|was\s|were\s)?({'|'.join(VERBS)})\s(?:the\s|a\s|an\s|in\s|by\s|near\s|at\s|to\s)*({SPAN})")
_APPOSITIVE = re.compile(rf"({SPAN}), (?:a|an|the) ([a-z]+(?: [a-z]+)?),")


def coarse_type(label: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COARSE.items() for x in kv]), label), F.lit("concept"))


def candidates(text: Column) -> Column:
    """Distinct capitalised spans of more than two letters that are no stop words, in order of appearance."""
    return F.filter(F.array_distinct(_all(F.coalesce(text, F.lit("")), SPAN)), lambda c: (F.length(c) > 2) & ~F.lower(c).isin(*STOP))


def cooccurrences(documents: DataFrame) -> DataFrame:
    """(head, tail, n_sentences, n_docs): the first two candidates, in document order, that a sentence
    contains, summed over all sentences of all documents."""
    s = spread(documents.select("doc_id", "text")).select("doc_id", candidates(F.col("text")).alias("c"), F.explode(_all(F.coalesce("text", F.lit("")), SENTENCE)).alias("s"))
    two = s.select("doc_id", F.slice(F.filter("c", lambda c: F.col("s").contains(c)), 1, 2).alias("t")).filter("size(t) = 2")
    pair = two.select("doc_id", F.col("t")[0].alias("head"), F.col("t")[1].alias("tail"))
    per = pair.groupBy("head", "tail", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("head", "tail").agg(F.sum("n").alias("n_sentences"), F.count(F.lit(1)).alias("n_docs"))


def triples_of(text: str | None) -> list[tuple[str, str, str]]:
    """(head, relation, tail) of one text by rules: subject-verb-object, 'X, a Y,' and co-occurrence of the
    first two candidates of a sentence that are not linked yet."""
    text = text or ""
    found: dict[tuple[str, str, str], None] = {}
    spans = [s for s in dict.fromkeys(_SPAN.findall(text)) if len(s) > 2 and s.lower() not in STOP]
    linked: set[frozenset] = set()
    for sentence in _SENTENCE.findall(text):
        for h, v, t in _SVO.findall(sentence):
            if h != t and h.lower() not in STOP:
                found[h, v, t] = None
                linked.add(frozenset((h, t)))
        for h, t in _APPOSITIVE.findall(sentence):
            found[h, "is_a", t] = None
            linked.add(frozenset((h, t)))
        here = [s for s in spans if s in sentence][:2]
        if len(here) == 2 and frozenset(here) not in linked:
            found[here[0], "co_occurs", here[1]] = None
            linked.add(frozenset(here))
    return list(found)


@udtf(returnType="head string, relation string, tail string")
class ExtractTriples:
    """SQL table function: select * from documents, lateral extract_triples(text)."""

    def eval(self, text: str):
        yield from triples_of(text)


def triples(documents: DataFrame, extract=triples_of) -> DataFrame:
    """(doc_id, head, relation, tail) of all documents, by any function from a text to triples."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in rows:
            out = [(d, *t) for d, text in zip(df["doc_id"], df["text"], strict=True) for t in extract(text)]
            yield pd.DataFrame(out, columns=["doc_id", "head", "relation", "tail"])

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, head string, relation string, tail string")


def ingested(documents: DataFrame) -> DataFrame:
    """(head, relation, tail, weight, n_docs): triples of all documents as weighted edges."""
    t = triples(documents).groupBy("head", "relation", "tail").agg(F.count_distinct("doc_id").alias("n_docs"))
    return t.select("head", "relation", "tail", F.least(F.col("n_docs").cast("double"), F.lit(MAX_WEIGHT)).alias("weight"), "n_docs")


def reinforced(edges: DataFrame, rewards: DataFrame, now: float) -> DataFrame:
    """(id, weight, last_used) after rewards (id, reward), one per edge: weight + reward * (0.5 if it is not
    negative, else 0.25), clamped to [0, MAX_WEIGHT]; a reward of 0 or more resets the decay clock."""
    j = edges.select("id", "weight", "last_used").join(rewards.select("id", "reward"), "id", "left")
    r = F.col("reward")
    delta = F.when(r >= 0, r * GAIN).otherwise(r * LOSS)
    w = F.when(r.isNull(), F.col("weight")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(MAX_WEIGHT), F.col("weight") + delta)))
    return j.select("id", F.round(w, 6).alias("weight"), F.when(r >= 0, F.lit(now)).otherwise(F.col("last_used")).alias("last_used"))
