"""Variant spellings of names typed by people: the entities that are one person or organisation.

Suffix blocking. Every token of every surface (canonical names and aliases) is indexed by its suffixes of
MIN_SUFFIX letters and more, refined with the initial of another token of the name, so that a pair is
compared if some token of both ends alike. A block of more than COMMON names is refined with the beginning of the token,
and, if it is as common still, with the beginning of the other token; whole tokens are refined no further than
the first step. However common a block is after that, it is kept: it is dealt into cells that are paired in
separate tasks, and a pair is compared where it is formed, so that pairs are never written. Pairs are compared token by token by the ratio of their longest common subsequence, with
initials, abbreviations and short forms of given names understood. Given names, their short forms and the nouns
of organisations are learned from the tables (see ``names.learn``), beside a prior list of everyday ones.

Names are compared once per distinct normal form, whatever the number of rows that carry it. A match on
initials only counts if all full names it fits belong to one entity.

Two surnames that differ are one only if one looks like a typo: it has a letter sequence (of three) that is
rare among all surnames, or it is spelt so once only, or in a small share of the names that have the other
spelling, and the two are nearly equal.

Defined results. Null and empty names, names of one token, and names of places, things, events, concepts
and summaries are never cases; ``type`` decides only where a name's form does not. Ties cannot arise;
repeated rows and several surfaces with one normal form are one name. Very long names are indexed by
suffixes of up to MAX_SUFFIX letters and by their whole tokens. Empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from mnemic.llm import names
from mnemic.llm.names import Lexicon
from mnemic.operators.components import components
from mnemic.session import materialize

#: Letters of a suffix at least and at most, names of a block that is not refined further, names of a cell, letters
#: of the other token that refine a block.
MIN_SUFFIX, MAX_SUFFIX, COMMON, CELL, BEGIN = 3, 16, 60, 128, 3
#: Least LCS ratio of surnames and of an organisation's words.
SURNAME, WORD, SHORT_WORD = 0.8, 0.8, 0.75
#: Least LCS ratio of two surnames of which one is spelt so once only.
TYPO = 0.85
#: A sequence of three letters is rare where fewer than this share of surnames have it; a spelling is where it has
#: at most this share of the names that the other spelling has.
RARE, SELDOM = 0.0008, 0.02
_NEVER = ("place", "event", "summary", "thing")


def _surfaces(shared):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon: Lexicon = shared.value
        for df in batches:
            out = []
            for eid, surface, kind in zip(df["entity_id"], df["surface"], df["type"], strict=True):
                typed = names.TYPED.get((kind or "").strip().lower())
                parsed = names.parse(surface, lexicon)
                if parsed is None or (typed is None and not _telling(surface, parsed, lexicon)):
                    continue
                out.append((eid, parsed[0], " ".join(parsed[1])))
            yield pd.DataFrame(out, columns=["entity_id", "kind", "norm"])

    return rows


def _telling(surface: str, parsed: tuple[str, tuple[str, ...]], lexicon: Lexicon) -> bool:
    """Whether a name without a telling type has the form of a person's or organisation's name."""
    kind, tokens = parsed
    if kind == "o":
        first = surface.split()[0]
        return len(tokens) >= 3 and (first[0].isupper() or surface.islower() and tokens[-1] in lexicon.nouns)
    return any(t in lexicon.forms for t in tokens[:2]) and not (surface.split()[0][0].islower() and not surface.islower())


def surfaces(entities: DataFrame, aliases: DataFrame, shared) -> DataFrame:
    """(entity_id, kind, norm): distinct normal forms of the names of persons and organisations."""
    live = entities.filter((F.coalesce("layer", F.lit(0)) == 0) & F.col("id").isNotNull() & ~F.coalesce(F.lower(F.trim("type")), F.lit("")).isin(*_NEVER))
    own = live.select(F.col("id").alias("entity_id"), F.col("canonical").alias("surface"), "type")
    # an alias counts for the entity it names; one that names none is dropped by the join
    other = aliases.select("entity_id", "surface").join(live.select(F.col("id").alias("entity_id"), "type"), "entity_id")
    typed = own.unionByName(other).filter("surface is not null").distinct()
    return typed.mapInPandas(_surfaces(shared), "entity_id long, kind string, norm string").distinct()


def _keys(shared):
    """Suffix keys of normal forms: (norm_id, kind, suffix, initial and beginning of the other token, whole)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon: Lexicon = shared.value
        for df in batches:
            out = []
            for nid, kind, norm in zip(df["norm_id"], df["kind"], df["norm"], strict=True):
                tokens = [t for t in norm.split(" ") if t[0] != "="]
                full = [t for t in tokens if len(t) >= MIN_SUFFIX]
                if kind == "p":
                    full += [a + b for a, b in zip(tokens, tokens[1:], strict=False) if len(a) > 2 and len(b) > 2 and len(tokens) > 2]
                seen = set()
                for t in full:
                    others = {""}
                    for o in tokens:
                        if o != t and not t.startswith(o) and not t.endswith(o):
                            others |= {f[:BEGIN] for f in lexicon.forms.get(o, (o,))} | {o[:BEGIN]} if kind == "p" else {o[:BEGIN]}
                    others = others - {""} or {""}
                    for n in {*range(MIN_SUFFIX, min(len(t), MAX_SUFFIX) + 1), len(t)}:
                        for o in others:
                            key = (kind, t[-n:], o[:1], t[:2], o, n == len(t))
                            if key not in seen:
                                seen.add(key)
                                out.append((nid, *key))
            yield pd.DataFrame(out, columns=["norm_id", "kind", "suffix", "initial", "start", "other", "whole"])

    return rows


def _sized(keyed: DataFrame, *at: str) -> DataFrame:
    """Keyed names with the number ``n`` of different names of their block, the block's key and ``at``, and ``up``, that
    of the block of the suffix that is a letter shorter, which holds all names of this one (null where there is none).
    Blocks of one are left out."""
    on = ["kind", "suffix", "initial", *at]
    size = keyed.groupBy(*on).agg(F.count_distinct("norm_id").alias("n")).filter("n > 1")
    shorter = size.withColumnRenamed("suffix", "less").withColumnRenamed("n", "up")
    size = size.withColumn("less", F.expr("substr(suffix, 2)")).join(shorter, [c if c != "suffix" else "less" for c in on], "left").drop("less")
    return keyed.join(size, on)


def blocks(forms: DataFrame, shared) -> DataFrame:
    """(norm_id, key, cells): names of the blocks that are paired. A block is left out if the one of the suffix that is
    a letter shorter is paired: it has all its pairs."""
    keyed = materialize(forms.mapInPandas(_keys(shared), "norm_id long, kind string, suffix string, initial string, start string, other string, whole boolean"), "suffixes")
    small, first = F.col("n") <= COMMON, F.col("up").isNull() | (F.col("up") > COMMON)
    one = _sized(keyed)
    two = materialize(_sized(one.filter(~small).drop("n", "up"), "start"), "refined")
    # blocks of this kind are all paired, so those of the shortest suffix have all pairs
    three = _sized(two.filter(~small & ~F.col("whole") & (F.length("suffix") == MIN_SUFFIX)).drop("n", "up"), "start", "other")
    key = ["kind", "suffix", "initial"]
    parts = [(one.filter(small & first), key), (two.filter(small & first | ~small & F.col("whole")), [*key, "start"]), (three, [*key, "start", "other"])]
    named = [t.select("norm_id", F.concat_ws("|", *on).alias("key"), F.greatest(F.lit(1), F.ceil(F.col("n") / CELL)).cast("int").alias("cells")) for t, on in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


def matches(by: DataFrame, shared, same) -> DataFrame:
    """(a, b, m), a < b: ids of normal forms that share a block and match. ``by``: (norm_id, kind, norm, spelt).

    Pairs are compared where they are formed, within the cell, so that only those that match are shuffled; what
    is written to disk follows the names, not their pairs. A pair of several blocks is compared in one of them only:
    a name carries the hashes of its blocks."""
    dealt = blocks(by.select("norm_id", "kind", "norm"), shared).join(by, "norm_id").dropDuplicates(["norm_id", "key"]).withColumn("block", F.xxhash64("key"))
    dealt = dealt.withColumn("of", F.collect_set("block").over(Window.partitionBy("norm_id")))
    i = F.pmod(F.xxhash64("norm_id"), F.col("cells")).cast("int")
    dealt = dealt.withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    on = ["key", "lo", "hi"]
    # as many partitions as are set, since a cell's work is far more than its bytes
    cell = dealt.select("norm_id", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "block", "of", "kind", "norm", "spelt").repartition(int(by.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    left, right = (cell.select(*on, "block", "kind", F.col("norm_id").alias(x), F.col("of").alias(f"of{x}"), F.col("norm").alias(f"n{x}"), F.col("spelt").alias(f"s{x}")) for x in "ab")
    few, many = F.least("sa", "sb"), F.greatest("sa", "sb")
    once = left.join(right.drop("kind", "block"), on).filter((F.col("a") < F.col("b")) & (F.array_min(F.array_intersect("ofa", "ofb")) == F.col("block")))
    told = once.select("a", "b", same("kind", "na", "nb", (few == 1) | (few <= SELDOM * many)).alias("m"))
    return told.filter("m > 0").distinct()


def _plausible(a: str, b: str, common: frozenset[str] | None, single: bool) -> bool:
    """Whether two different spellings can be one surname."""
    if a == b or common is None:
        return True
    return single and names.ratio(a, b) >= TYPO or not (_regular(a, common) and _regular(b, common))


def _regular(word: str, common: frozenset[str]) -> bool:
    marked = f"^{word}$"
    return all(marked[i : i + 3] in common for i in range(len(marked) - 2))


def _persons(a: str, b: str, common: frozenset[str] | None, single: bool, lexicon: Lexicon) -> int:
    best = 0
    for xs, xg, xn, xl in _readings(a, lexicon):
        for ys, yg, yn, yl in _readings(b, lexicon):
            # letters that the other does not have bound what is common, which spares most pairs the rest
            if 2 * min(xn - (xl & ~yl).bit_count(), yn - (yl & ~xl).bit_count()) / (xn + yn) < SURNAME:
                continue
            if min(xn, yn) < 4 or names.ratio(xs, ys) < SURNAME or not xg or not yg or not _plausible(xs, ys, common, single):
                continue
            first = _given(xg[0], yg[0], lexicon)
            if not first:
                continue
            xm, ym = xg[1:2], yg[1:2]
            if xm and ym:
                if xm[0][0] != ym[0][0]:
                    continue
                first = 2  # two initials and the surname agree
            best = max(best, first)
    return best


@functools.lru_cache(1 << 16)
def _given(a: str, b: str, lexicon: Lexicon) -> int:
    return lexicon.given_match(a, b)


@functools.lru_cache(1 << 16)
def _readings(norm: str, lexicon: Lexicon) -> list[tuple[str, list[str], int, int]]:
    """The ways to read a name, with the surname's length and, as bits, its letters (some share a bit)."""
    return [(s, given, len(s), functools.reduce(lambda bits, c: bits | 1 << (ord(c) & 63), s, 0)) for s, given in _splits(norm.split(" "), lexicon)]


def _splits(tokens: list[str], lexicon: Lexicon) -> list[tuple[str, list[str]]]:
    """Ways to read a name as surname and given names: last, first, or two neighbours as one surname."""
    out = [(tokens[-1], tokens[:-1])]
    if tokens[0] not in lexicon.full:
        out.append((tokens[0], tokens[1:]))
    if len(tokens) > 2:
        if min(len(tokens[-1]), len(tokens[-2])) > 2:
            out.append((tokens[-2] + tokens[-1], tokens[:-2]))
        if min(len(tokens[0]), len(tokens[1])) > 2:
            out.append((tokens[0] + tokens[1], tokens[2:]))
    return out


def _noun(a: str) -> str:
    return names.SHORT_NOUNS.get(a, a)


@functools.lru_cache(1 << 16)
def _likeness(t: str, o: str) -> tuple[bool, bool, float]:
    return t == o, names.shortens(t, o) or names.shortens(o, t), names.ratio(t, o)


def _organisations(x: list[str], y: list[str], lexicon: Lexicon) -> int:
    fx, fy = ({t for t in z if t[0] == "="} for z in (x, y))
    if fx and fy and fx != fy:
        return 0
    x, y = ([_noun(t) for t in z if t[0] != "="] for z in (x, y))
    if abs(len(x) - len(y)) > 1:
        return 0
    if len(x) != len(y):  # a town typed in two parts
        x, y = (x, y) if len(x) > len(y) else (y, x)
        return max((_organisations(x[:i] + [x[i] + x[i + 1]] + x[i + 2 :], y, lexicon) for i in range(len(x) - 1)), default=0)
    left = list(y)
    for t in sorted(x, key=len, reverse=True):
        hit = max(left, key=lambda o: _likeness(t, o))
        same, short, ratio = _likeness(t, hit)
        if not same and not short:
            two_nouns = t in lexicon.nouns and hit in lexicon.nouns
            if two_nouns or ratio < (WORD if max(len(t), len(hit)) > 5 else SHORT_WORD):
                return 0
        left.remove(hit)
    return 2


def match(kind: str, a: str, b: str, common: frozenset[str] | None = None, single: bool = False, lexicon: Lexicon = names.PRIOR) -> int:
    """0 different, 1 may be the same (given name as initial only), 2 the same. ``common``: usual letter
    sequences of surnames; ``single``: one of the two surnames is spelt so seldom."""
    x, y = a.split(" "), b.split(" ")
    if kind == "o":
        return _organisations(x, y, lexicon)
    if x == y:
        return 2 if sum(len(t) > 1 for t in x) > 1 else 1
    return _persons(a, b, common, single, lexicon)


def common_sequences(forms: DataFrame) -> frozenset[str]:
    """Sequences of three letters that a usual share of the longest tokens of persons' names have, counted
    over all distinct forms. There are at most 28^3 sequences of letters, so the result is bounded."""

    def tokens(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in rows:
            yield pd.DataFrame({"t": [max(n.split(" "), key=len) for n in df["norm"]]})

    longest = forms.filter("kind = 'p'").mapInPandas(tokens, "t string").filter("t rlike '^[a-z]{4,40}$'").distinct()
    grams = longest.select(F.concat(F.lit("^"), "t", F.lit("$")).alias("w")).select(F.explode(F.array_distinct(F.expr("transform(sequence(1, length(w) - 2), i -> substr(w, i, 3))"))).alias("g"))
    least = max(2.0, RARE * longest.count())
    return frozenset(r["g"] for r in grams.groupBy("g").count().filter(F.col("count") >= least).collect())


def links(entities: DataFrame, aliases: DataFrame, prior: Lexicon | None = None) -> DataFrame:
    """(a, b) of entities that are the same, as many as connect each group; not closed. ``prior``: what is known of
    names beforehand (everyday ones by default)."""
    shared = entities.sparkSession.sparkContext.broadcast(names.learn(entities, aliases, prior))  # bounded by names.SHARE
    named = materialize(surfaces(entities, aliases, shared), "surfaces")
    forms = named.select("kind", "norm").distinct().withColumn("norm_id", F.xxhash64("kind", "norm"))
    common = common_sequences(forms)
    longest = F.aggregate(F.split("norm", " "), F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    by = materialize(forms.withColumn("surname", longest), "forms")
    spelt = by.groupBy("kind", "surname").agg(F.count(F.lit(1)).alias("spelt"))
    by = materialize(by.join(spelt, ["kind", "surname"]).select("norm_id", "kind", "norm", "spelt"), "spelt")

    @F.pandas_udf(IntegerType())
    def same(kind: pd.Series, x: pd.Series, y: pd.Series, single: pd.Series) -> pd.Series:
        lexicon = shared.value
        return pd.Series([match(k, p, q, common, s, lexicon) for k, p, q, s in zip(kind, x, y, single, strict=True)], dtype="int32")

    matched = materialize(matches(by, shared, same), "matches")
    ids = named.withColumn("norm_id", F.xxhash64("kind", "norm")).withColumn("full", F.expr("kind = 'o' or size(filter(split(norm, ' '), t -> length(t) > 1)) > 1"))
    ids = ids.withColumn("telling", F.expr("full or size(split(norm, ' ')) > 2"))  # two initials tell as much as a given name
    head = ids.groupBy("norm_id").agg(F.min("entity_id").alias("h"), F.max("full").alias("full"))
    # entities that share a telling normal form, then forms that match
    shared = ids.filter("telling").join(head.select("norm_id", "h"), "norm_id").select(F.col("entity_id").alias("a"), F.col("h").alias("b"))
    strong = matched.filter("m = 2").join(head.select(F.col("norm_id").alias("a"), F.col("h").alias("ha")), "a").join(head.select(F.col("norm_id").alias("b"), F.col("h").alias("hb")), "b")
    sure = materialize(shared.union(strong.select("ha", "hb")).union(_through(ids)), "sure")
    groups = materialize(components(sure.filter("a is not null and b is not null")), "groups")
    # a form with an initial only joins a group if all full forms it fits are in that one group
    of = ids.join(groups.select(F.col("id").alias("entity_id"), "component"), "entity_id").select("norm_id", "component", "full").distinct()
    weak = matched.filter("m = 1")
    both = weak.select(F.col("a").alias("x"), F.col("b").alias("y")).union(weak.select("b", "a"))
    fits = both.join(of.filter("full").select(F.col("norm_id").alias("y"), "component"), "y").join(ids.filter("not full").select("norm_id").distinct(), F.col("x") == F.col("norm_id"), "left_semi")
    only = fits.groupBy("x").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo = hi")
    weak_links = ids.join(only, F.col("norm_id") == F.col("x")).select(F.col("entity_id").alias("a"), F.col("lo").alias("b"))
    # an entity is not joined through an initial if one of its own full forms puts it elsewhere
    placed = ids.filter("full").select(F.col("entity_id").alias("a")).distinct()
    return sure.union(weak_links.join(placed, "a", "left_anti"))


def _through(ids: DataFrame) -> DataFrame:
    """Every entity linked to itself, so that single ones have a group too."""
    return ids.select(F.col("entity_id").alias("a"), F.col("entity_id").alias("b")).distinct()


def resolved(entities: DataFrame, aliases: DataFrame, prior: Lexicon | None = None) -> DataFrame:
    """(entity_id, group_id) of every entity that is named as a person or organisation."""
    return components(links(entities, aliases, prior)).select(F.col("id").alias("entity_id"), F.col("component").alias("group_id"))


def pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of each group."""
    return groups.select("group_id", F.col("entity_id").alias("id_a")).join(groups.select("group_id", F.col("entity_id").alias("id_b")), "group_id").filter("id_a < id_b").select("id_a", "id_b")
