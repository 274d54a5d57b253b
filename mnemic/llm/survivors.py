"""Best representative of each duplicate group of beliefs.

Currency reasoning. Rows with a valid ``revised_at`` show in which order the values of a field follow each
other ('model' before 'inference' before 'document', say). For every group the last time each value was
seen is taken; over all groups the pairs of values are counted, and their net direction gives a precedence
graph whose topological order ranks the values. A group's own order comes first: of the values seen on rows
with a time the one of the latest row is the last. Values that stand on rows without a time only are placed
by the learned arcs (and what follows from them), strongest first, as far as they agree with the order so
far. A value that no other one follows survives; of several, the one with a time, else the topologically
latest. In a group without any time the topologically latest value survives.

The row that survives whole (``keep_id``) is the maximum of the group's rows under the order of trust,
completeness and recency that the problem statement fixes; that order is total, so learned precedence
cannot change it and acts on the field values only.

Everything is computed from one aggregation per group with map-side combining: no group is collected,
whatever its size. Only counts over the fixed value domains reach the driver.

Defined results. Rows with a null head, tail or relation belong to no group. Null and unknown values of
``source_type`` count as 'other', with precedence 1; where 'other' survives, the value as it was written stands
beside it, of the latest such row (of rows without a time, the last that arrived). A confidence that is null, NaN or outside [0, 1] and a
``revised_at`` that is null or outside [946684800, 4102444800) are behind all others. Ties end at the
smallest id. Groups of one row are not reported. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemic.operators.hotkeys import canonical_relation

# Precedence of source types; null and unknown ones have UNKNOWN.
PRECEDENCE = {"operator": 3, "document": 2, "inference": 1, "model": 0}
UNKNOWN = 1
#: Bounds of a possible ``revised_at``.
EARLIEST, LATEST = 946684800.0, 4102444800.0
#: Value domains of the fields whose transitions are learned; anything else is 'other'.
DOMAINS = {
    "source_type": ("operator", "document", "inference", "model", "other"),
    "provenance_class": ("real", "origin", "quarantined-noise", "other"),
    "quarantined": ("true", "false"),
}
#: Fields whose domain has 'other', for which the value as written is kept.
WRITTEN = tuple(f for f, values in DOMAINS.items() if "other" in values)
KEY = ["head_id", "tail_id", "rel"]


def _domain(field: str) -> Column:
    value = F.lower(F.trim(F.col(field).cast("string")))
    if field == "quarantined":
        return F.coalesce(value, F.lit("false"))
    return F.when(value.isin(*DOMAINS[field]), value).otherwise("other")


def prepare(edges: DataFrame) -> DataFrame:
    """Rows with their group key, domain values and order keys; only the columns that are needed."""
    conf, rev = F.col("confidence"), F.col("revised_at")
    precedence = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv]), F.lower(F.trim("source_type"))), F.lit(UNKNOWN))
    good_conf = F.when((conf >= 0) & (conf <= 1), conf + F.lit(0.0))
    good_rev = F.when((rev >= EARLIEST) & (rev < LATEST), rev)
    return edges.select(
        "id",
        "head_id",
        "tail_id",
        canonical_relation(F.col("relation")).alias("rel"),
        *[_domain(f).alias(f) for f in DOMAINS],
        *[F.trim(f).alias(f"raw_{f}") for f in WRITTEN],
        good_conf.alias("confidence"),
        good_rev.alias("revised_at"),
        F.when(~F.isnan("created_at"), F.col("created_at")).alias("created_at"),
        F.when(~F.isnan("weight"), F.col("weight")).alias("weight"),
        F.when(F.trim("source") != "", F.trim("source")).alias("source"),
        precedence.alias("prec"),
    ).dropna(subset=KEY)


def _last(field: str, value: str) -> Column:
    return F.max(F.when(F.col(field) == value, F.col("revised_at"))).alias(f"last_{field}_{value}")


def groups(rows: DataFrame) -> DataFrame:
    """One row per group of two or more: the surviving row, field values by recency, and for every domain
    value its number of rows and the last time it was seen."""
    trust = F.struct("prec", "confidence", "revised_at", "created_at", (-F.col("id")).alias("i"))
    arrived = F.struct("revised_at", "created_at", (-F.col("id")).alias("i"))  # rows without a time are behind those with one
    recent = F.when(F.col("revised_at").isNotNull(), arrived)
    aggs = [
        F.min("id").alias("group_id"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max_by("id", trust).alias("keep_id"),
        F.max_by("confidence", F.when(F.col("confidence").isNotNull(), trust)).alias("confidence"),
        F.max("revised_at").alias("revised_at"),
        F.max_by("weight", F.when(F.col("weight").isNotNull(), arrived)).alias("weight"),
        F.max_by("source", F.when(F.col("source").isNotNull(), trust)).alias("source"),
    ]
    for f, values in DOMAINS.items():
        for v in values:
            aggs += [F.count(F.when(F.col(f) == v, 1)).alias(f"n_{f}_{v}"), _last(f, v)]
    for f in WRITTEN:
        aggs.append(F.max_by(f"raw_{f}", F.when(F.col(f) == "other", arrived)).alias(f"raw_{f}"))
    aggs.append(F.max_by(F.struct(*DOMAINS), recent).alias("recent"))
    return rows.groupBy(*KEY).agg(*aggs).filter("n_rows >= 2").select("*", *[F.col(f"recent.{f}").alias(f"recent_{f}") for f in DOMAINS])


def transitions(grouped: DataFrame) -> DataFrame:
    """(field, earlier, later, n_groups): in how many groups ``later`` was last seen after ``earlier``."""
    pairs = [(f, a, b) for f, values in DOMAINS.items() for a in values for b in values if a != b]
    counts = grouped.agg(*[F.count(F.when(F.col(f"last_{f}_{a}") < F.col(f"last_{f}_{b}"), 1)).alias(f"p{i}") for i, (f, a, b) in enumerate(pairs)])
    stacked = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("earlier"), F.lit(b).alias("later"), F.col(f"p{i}").alias("n_groups")) for i, (f, a, b) in enumerate(pairs)])
    return counts.select(F.inline(stacked))


Arcs = dict[tuple[str, str], int]


def _reaches(arcs: set[tuple[str, str]], a: str, b: str) -> bool:
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        if x == b:
            return True
        if x not in seen:
            seen.add(x)
            todo += [q for p, q in arcs if p == x]
    return False


def precedence(counts: list[tuple[str, str, int]], values: tuple[str, ...]) -> Arcs:
    """Net support of the arcs of the precedence graph. An arc leads from a to b where more groups saw b last
    than a; of cycles the arc with the least net support is dropped."""
    n = {(a, b): c for a, b, c in counts}
    net = {(a, b): n.get((a, b), 0) - n.get((b, a), 0) for a in values for b in values if a != b}
    arcs: Arcs = {}
    for (a, b), c in sorted(net.items(), key=lambda x: (-x[1], x[0])):
        if c > 0 and not _reaches(set(arcs), b, a):
            arcs[a, b] = c
    return arcs


def _sorted(arcs: Arcs, values: tuple[str, ...]) -> list[str]:
    order: list[str] = []
    while len(order) < len(values):
        order.append(next(v for v in values if v not in order and all(p in order for p, q in arcs if q == v)))
    return order


def topological(counts: list[tuple[str, str, int]], values: tuple[str, ...]) -> list[str]:
    """Values from earliest to latest by ``precedence``. Free values keep the order of the domain."""
    return _sorted(precedence(counts, values), values)


def _closed(arcs: Arcs, values: tuple[str, ...]) -> Arcs:
    """Arcs between all values of which one follows from the other; a path is as strong as its weakest arc."""
    out = dict(arcs)
    for k in values:
        for a in values:
            for b in values:
                if (c := min(out.get((a, k), 0), out.get((k, b), 0))) > out.get((a, b), 0):
                    out[a, b] = c
    return out


def latest(timed: tuple[str, ...], untimed: tuple[str, ...], closed: Arcs, order: list[str]) -> str:
    """The surviving value of a group: ``timed`` values in the order of their last times, ``untimed`` ones seen
    without a time only."""
    arcs = set(zip(timed, timed[1:], strict=False))
    here = {(a, b): c for (a, b), c in closed.items() if {a, b} <= {*timed, *untimed} and not {a, b} <= set(timed)}
    for a, b in sorted(here, key=lambda x: (-here[x], x)):
        if not _reaches(arcs, b, a):
            arcs.add((a, b))
    last = {v for v in (*timed, *untimed) if not any(p == v for p, _ in arcs)}
    return timed[-1] if timed and timed[-1] in last else max(last, key=order.index)


def _overtaken(arcs: Arcs, values: tuple[str, ...]) -> dict[str, str]:
    """By state of a group with timed and untimed values (see ``_state``), the untimed value that survives; states
    in which the last timed one does are left out. There are at most 515 states of five values."""
    closed, order, out = _closed(arcs, values), _sorted(arcs, values), {}
    for k in range(1, len(values)):
        for timed in permutations(values, k):
            rest = [v for v in values if v not in timed]
            for m in range(1, len(rest) + 1):
                for untimed in combinations(rest, m):
                    if (v := latest(timed, untimed, closed, order)) != timed[-1]:
                        out[">".join(timed) + "|" + ">".join(untimed)] = v
    return out


def _state(field: str) -> Column:
    """Timed values by their last time and, behind a bar, untimed ones in the order of the domain."""
    last = {v: F.col(f"last_{field}_{v}") for v in DOMAINS[field]}
    timed = [F.when(t.isNotNull(), F.struct(t.alias("t"), (F.col(f"recent_{field}") == v).alias("r"), F.lit(-i).alias("i"), F.lit(v).alias("v"))) for i, (v, t) in enumerate(last.items())]
    untimed = [F.when(t.isNull() & (F.col(f"n_{field}_{v}") > 0), F.lit(v)) for v, t in last.items()]
    return F.concat(F.array_join(F.array_sort(F.array_compact(F.array(*timed)))["v"], ">"), F.lit("|"), F.concat_ws(">", *untimed))


def learn(grouped: DataFrame) -> dict[str, Arcs]:
    """Precedence graph of every field's values (at most len(DOMAINS) x 20 counts reach the driver)."""
    seen = transitions(grouped).collect()
    return {f: precedence([(r["earlier"], r["later"], r["n_groups"]) for r in seen if r["field"] == f], values) for f, values in DOMAINS.items()}


def survivors(edges: DataFrame, order: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per group: (group_id, keep_id, n_rows, head_id, tail_id, relation, source_type,
    provenance_class, quarantined, confidence, weight, source, revised_at, inferred_fields,
    source_type_written, provenance_class_written).

    ``inferred_fields`` names the fields whose value stands on no row with a usable timestamp, so that it came
    from learned precedence. ``order`` gives an order of the values; by default precedence is learned from
    ``edges``.
    """
    grouped = groups(prepare(edges))
    arcs = {f: dict.fromkeys(combinations(v, 2), 1) for f, v in order.items()} if order else learn(grouped)
    values, inferred, written = [], [], []
    for f, domain in DOMAINS.items():
        topmost = F.coalesce(*[F.when(F.col(f"n_{f}_{v}") > 0, F.lit(v)) for v in reversed(_sorted(arcs[f], domain))])
        recent, value = F.col(f"recent_{f}"), F.coalesce(F.col(f"recent_{f}"), topmost)
        if wins := _overtaken(arcs[f], domain):
            untimed = F.greatest(*[(F.col(f"n_{f}_{v}") > 0) & F.col(f"last_{f}_{v}").isNull() for v in domain])
            found = F.element_at(F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in wins.items())), F.lit(","), F.lit(":")), _state(f))
            value = F.when(recent.isNotNull() & untimed, F.coalesce(found, recent)).otherwise(value)
        values.append(value.alias(f))
        timeless = F.coalesce(*[F.when((F.col(f) == v) & F.col(f"last_{f}_{v}").isNull(), F.lit(f)) for v in domain])
        inferred.append(timeless)
        if f in WRITTEN:
            written.append(F.when(F.col(f) == "other", F.col(f"raw_{f}")).otherwise(F.col(f)).alias(f"{f}_written"))
    kept = grouped.select("*", *values)
    return kept.select("group_id", "keep_id", "n_rows", "head_id", "tail_id", F.col("rel").alias("relation"), *DOMAINS, "confidence", "weight", "source", "revised_at", F.array_compact(F.array(*inferred)).alias("inferred_fields"), *written)
