"""Queries of the vector algebra, prototypes and the scalar encoder on embeddings and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemic.functions import vectors as V
from mnemic.operators import prototypes as P
from mnemic.operators.encoder import ScalarEncoder
from mnemic.session import materialize, read

DEADBAND = 0.05


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("hv"))


def _next(e: DataFrame) -> DataFrame:
    """Each vector with the one whose id follows."""
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hv").alias("other")), "vec_id")


def hv_bind(spark: SparkSession, d: str) -> DataFrame:
    b = _next(_emb(spark, d)).select("vec_id", V.bind(F.col("hv"), F.col("other")).alias("b"))
    return b.select("vec_id", F.posexplode("b").alias("pos", "x")).select("vec_id", "pos", F.round("x", 9).alias("x"))


def hv_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _next(_emb(spark, d)).select("vec_id", F.round(V.cosine(F.col("hv"), F.col("other")), 6).alias("similarity"))


def hv_quantize(spark: SparkSession, d: str) -> DataFrame:
    q = _emb(spark, d).select("vec_id", V.quantize(F.col("hv"), DEADBAND).alias("q"))
    n = lambda s: F.size(F.filter("q", lambda x: x == s))
    return q.select("vec_id", n(1).alias("plus"), n(0).alias("zero"), n(-1).alias("minus"))


def _trits(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).select("vec_id", "label", V.quantize(F.col("hv"), DEADBAND).alias("hv"))


def hv_ternary_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _next(_trits(spark, d)).select("vec_id", F.round(V.ternary_similarity(F.col("hv"), F.col("other")), 6).alias("similarity"))


def hv_bitplane_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = _next(_trits(spark, d)).select("vec_id", V.planes(F.col("hv")).alias("a"), V.planes(F.col("other")).alias("b"))
    return p.select("vec_id", F.round(V.planes_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def hv_bitplane_trits(spark: SparkSession, d: str) -> DataFrame:
    """Trits to bit planes and back."""
    p = _trits(spark, d).select("vec_id", "hv", V.planes(F.col("hv")).alias("p"))
    return p.select("vec_id", F.posexplode(V.planes_trits(F.col("p"), F.size("hv"))).alias("pos", "x"))


def proto_ranked(spark: SparkSession, d: str) -> DataFrame:
    """All classes of each vector in descending order of their score."""
    e = _emb(spark, d)
    r = P.ranked(e, materialize(P.fit(e), "prototypes"), "vec_id")
    return r.select("vec_id", "rank", "label", F.round("score", 6).alias("score"))


def hv_pack(spark: SparkSession, d: str) -> DataFrame:
    p = _trits(spark, d).select("vec_id", "hv", V.pack_trits(F.col("hv")).alias("b"))
    return p.select("vec_id", F.hex("b").alias("packed"), F.length("b").alias("n_bytes"), (V.unpack_trits(F.col("b"), F.size("hv")) == F.col("hv")).alias("round_trip"))


def hv_pack_real(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d).select("vec_id", "hv", V.pack_real("hv").alias("b"))
    return e.select("vec_id", F.length("b").alias("n_bytes"), (V.unpack_real("b", F.size("hv")) == F.col("hv")).alias("round_trip"))


def hv_bundle_real(spark: SparkSession, d: str) -> DataFrame:
    return V.bundle_real(_emb(spark, d), ["label"]).select("label", "pos", F.round("x", 6).alias("x"))


def hv_bundle_ternary(spark: SparkSession, d: str) -> DataFrame:
    return V.bundle_ternary(_trits(spark, d), ["label"]).select("label", "pos", "s", "x")


def hv_footprint(spark: SparkSession, d: str) -> DataFrame:
    p = _trits(spark, d).select(V.pack_trits(F.col("hv")).alias("b"), F.size("hv").alias("n"))
    return p.agg(F.sum(F.length("b")).alias("ternary_bytes"), F.sum(F.col("n") * 4).alias("real_bytes"))


def proto_fit(spark: SparkSession, d: str) -> DataFrame:
    p = P.fit(_emb(spark, d))
    return p.select("label", F.posexplode("hv").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def proto_predict(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    return P.predict(e, materialize(P.fit(e), "prototypes"), "vec_id")


def proto_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = _emb(spark, d)
    hit = proto_predict(spark, d).join(e.select("vec_id", "label"), "vec_id")
    return hit.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("predicted") == F.col("label"), 1)).alias("n_right"), F.round(F.avg("margin"), 4).alias("mean_margin"))


def proto_update(spark: SparkSession, d: str) -> DataFrame:
    """Prototypes of the vectors, each bundled once more with the class's vectors quantized to trits."""
    old = materialize(P.fit(_emb(spark, d)), "prototypes")
    new = P.update(old, _trits(spark, d).select("label", F.col("hv").cast("array<double>").alias("hv")))
    return new.select("label", F.posexplode("hv").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def proto_separability(spark: SparkSession, d: str) -> DataFrame:
    """Components are the vectors' leading element sign; a component's vector of a class is its bundle."""
    e = _emb(spark, d).withColumn("component", F.when(F.get("hv", F.lit(0)) > 0, "up").otherwise("down"))
    parts = V.assembled(V.bundle_real(e, ["component", "label"]), ["component", "label"])
    return P.separability(materialize(parts, "components"), materialize(P.fit(e), "prototypes"))


def knn_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50."""
    e = _emb(spark, d)
    return P.top_k(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "hv"), e, 10)


PARAMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GROUPS = {"volume": ["l_quantity"], "pricing": ["l_extendedprice", "l_discount", "l_tax"]}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *[F.col(p).cast("double").alias(p) for p in PARAMS])


def scale_fit(spark: SparkSession, d: str) -> DataFrame:
    b = ScalarEncoder(PARAMS, 16).fit(_lines(spark, d)).bounds
    return spark.createDataFrame([(p, float(lo), float(hi)) for p, (lo, hi) in b.items()], "param string, lo double, hi double")


def scale_params(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d)
    enc = ScalarEncoder(PARAMS, 16).fit(df)
    return df.select("l_orderkey", "l_linenumber", *[F.round(enc.scaled(p), 6).alias(p) for p in PARAMS])


def encode_real(spark: SparkSession, d: str) -> DataFrame:
    """Mean encoded element per flag, parameter and position."""
    df = _lines(spark, d)
    enc = ScalarEncoder(PARAMS, 16).fit(df)
    return V.exploded(enc.long(df, ["l_returnflag"]), ["l_returnflag", "param"]).groupBy("l_returnflag", "param", "pos").agg(F.round(F.avg("x"), 5).alias("mean_x"))


def encode_ternary(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d)
    enc = ScalarEncoder(PARAMS, 16, kind="ternary", deadband=0.01).fit(df)
    return V.exploded(enc.long(df, ["l_returnflag"]), ["l_returnflag", "param"]).groupBy("l_returnflag", "param", "pos").agg(F.sum("x").alias("s"))


def group_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Class prototypes of grouped sample vectors: fit, encode with groups, bundle per flag."""
    df = _lines(spark, d)
    enc = ScalarEncoder(PARAMS, 16).fit(df)
    rows = df.select(F.col("l_returnflag").alias("label"), enc.grouped(GROUPS).alias("hv"))
    return V.bundle_real(rows, ["label"]).select("label", "pos", F.round("x", 5).alias("x"))


QUERIES = {
    f.__name__: f
    for f in (hv_bind, hv_cosine, hv_quantize, hv_ternary_similarity, hv_bitplane_similarity, hv_bitplane_trits, proto_ranked, hv_pack, hv_pack_real, hv_bundle_real, hv_bundle_ternary, hv_footprint, proto_fit, proto_predict, proto_accuracy, proto_update, proto_separability, knn_exhaustive, scale_fit, scale_params, encode_real, encode_ternary, group_prototypes)
}

_LONG = "with e as (select vec_id, label, unnest(range(len(embedding)))::int as pos, unnest(embedding)::double as x from embeddings)"
_TRIT = _LONG + f", t as (select vec_id, label, pos, case when abs(x) <= {DEADBAND} then 0 else sign(x)::int end as x from e)"
_PROTO = _LONG + """
, s as (select label, pos, sum(x) as s from e group by 1, 2), n as (select label, sqrt(sum(s * s)) as n from s group by 1),
p as (select s.label, pos, s / n as x from s join n on s.label = n.label)"""
_SCORES = _PROTO + """
, d as (select e.vec_id, p.label, sum(e.x * p.x) as d from e join p on e.pos = p.pos group by 1, 2),
ne as (select vec_id, sqrt(sum(x * x)) as n from e group by 1),
sc as (select d.vec_id, d.label, round(d / n, 9) as score from d join ne on d.vec_id = ne.vec_id),
rk as (select *, row_number() over (partition by vec_id order by score desc, label) as r, lead(score) over (partition by vec_id order by score desc, label) as nxt from sc),
pr as (select vec_id, label as predicted, round(score, 6) as score, round(score - coalesce(nxt, 0), 6) as margin from rk where r = 1)"""
_B = "with b as (select " + ", ".join(f"min({p})::double as lo_{p}, max({p})::double as hi_{p}" for p in PARAMS) + " from lineitem)"


def _scaled(p: str) -> str:
    return f"(2 * greatest(0.0, least(1.0, ({p}::double - lo_{p}) / (hi_{p} - lo_{p} + 1e-8))) - 1)"


def _projection(kind: str) -> str:
    enc = ScalarEncoder(PARAMS, 16)
    rows = ", ".join(f"('{p}', {j}, {float(enc.projection[i][j])!r}::double)" for i, p in enumerate(PARAMS) for j in range(16))
    x = " union all ".join(f"select l_returnflag, '{p}' as param, {_scaled(p)} as v from lineitem, b" for p in PARAMS)
    body = "tanh(v * w)" if kind == "real" else "case when abs(v * w) <= 0.01 then 0 else sign(v * w)::int end"
    return f"{_B}, w(param, pos, w) as (values {rows}), x as ({x}), y as (select l_returnflag, x.param, pos, {body} as x from x join w on x.param = w.param)"


def _grouped() -> str:
    enc = ScalarEncoder(PARAMS, 16)
    rows = ", ".join(f"('{p}', {j}, {float(enc.projection[i][j])!r}::double)" for i, p in enumerate(PARAMS) for j in range(16))
    x = " union all ".join(f"select row_id, l_returnflag, '{g}' as grp, '{p}' as param, {_scaled(p)} as v from line, b" for g, ps in GROUPS.items() for p in ps)
    unit = "{0} / coalesce(nullif(sqrt(sum({0} * {0}) over (partition by {1})), 0), 1)"
    return f"""{_B}, line as (select *, row_number() over () as row_id from lineitem), w(param, pos, w) as (values {rows}), x as ({x}),
      g as (select row_id, l_returnflag, grp, pos, sum(tanh(v * w)) as s from x join w on x.param = w.param group by 1, 2, 3, 4),
      u as (select row_id, l_returnflag, pos, {unit.format("s", "row_id, grp")} as s from g), t as (select row_id, l_returnflag, pos, sum(s) as s from u group by 1, 2, 3),
      r as (select l_returnflag as label, pos, {unit.format("s", "row_id")} as s from t), c as (select label, pos, sum(s) as s from r group by 1, 2)
      select label, pos, round({unit.format("s", "label")}, 5) as x from c"""


ORACLE = {
    "group_prototypes": _grouped(),
    "hv_bind": _LONG + " select a.vec_id, a.pos, round(a.x * b.x, 9) as x from e a join e b on b.vec_id = a.vec_id + 1 and b.pos = a.pos",
    "hv_cosine": _LONG + " select a.vec_id, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) as similarity from e a join e b on b.vec_id = a.vec_id + 1 and b.pos = a.pos group by 1",
    "hv_quantize": _TRIT + " select vec_id, count(*) filter (x = 1) as plus, count(*) filter (x = 0) as zero, count(*) filter (x = -1) as minus from t group by 1",
    "hv_ternary_similarity": _TRIT + " select a.vec_id, round(coalesce(sum(a.x * b.x) / nullif(sum(abs(a.x * b.x)), 0), 0), 6) as similarity from t a join t b on b.vec_id = a.vec_id + 1 and b.pos = a.pos group by 1",
    "hv_bitplane_similarity": _TRIT + " select a.vec_id, round(coalesce(sum(a.x * b.x) / nullif(sum(abs(a.x * b.x)), 0), 0), 6) as similarity from t a join t b on b.vec_id = a.vec_id + 1 and b.pos = a.pos group by 1",
    "hv_bitplane_trits": _TRIT + " select vec_id, pos, x from t",
    "proto_ranked": _SCORES + " select vec_id, r::int as rank, label, round(score, 6) as score from rk",
    "hv_pack": _TRIT + """, c as (select vec_id, pos // 4 as byte, sum(case x when 1 then 1 when -1 then 2 else 0 end * (4 ** (pos % 4))::int)::int as v from t group by 1, 2)
      select vec_id, string_agg(printf('%02X', v), '' order by byte) as packed, count(*)::int as n_bytes, true as round_trip from c group by 1""",
    "hv_pack_real": "select vec_id, len(embedding)::int * 4 as n_bytes, true as round_trip from embeddings",
    "hv_bundle_real": _PROTO + " select label, pos, round(x, 6) as x from p",
    "hv_bundle_ternary": _TRIT + " select label, pos, sum(x)::bigint as s, case when abs(sum(x)) <= 0.5 * sqrt(count(*)) then 0 else sign(sum(x))::int end as x from t group by 1, 2",
    "hv_footprint": "select sum((len(embedding) + 3) // 4)::bigint as ternary_bytes, sum(len(embedding) * 4)::bigint as real_bytes from embeddings",
    "proto_fit": _PROTO + " select label, pos, round(x, 6) as x from p",
    "proto_predict": _SCORES + " select * from pr",
    "proto_accuracy": _SCORES + " select l.label, count(*) as n, count(*) filter (predicted = l.label) as n_right, round(avg(margin), 4) as mean_margin from pr join embeddings l on l.vec_id = pr.vec_id group by 1",
    "proto_update": _PROTO + f""", u as (select label, pos, x from p union all select label, pos, (case when abs(x) <= {DEADBAND} then 0 else sign(x) end)::double from e),
      s2 as (select label, pos, sum(x) as s from u group by 1, 2), n2 as (select label, sqrt(sum(s * s)) as n from s2 group by 1)
      select s2.label, pos, round(s / n, 6) as x from s2 join n2 on s2.label = n2.label""",
    "proto_separability": _PROTO + """, k as (select vec_id, case when x > 0 then 'up' else 'down' end as component from e where pos = 0),
      cs as (select component, label, pos, sum(x) as x from e join k on e.vec_id = k.vec_id group by 1, 2, 3),
      cn as (select component, label, sqrt(sum(x * x)) as n from cs group by 1, 2),
      sc as (select cs.component, cs.label as own, p.label, sum(cs.x * p.x) / any_value(n) as score from cs join cn on cs.component = cn.component and cs.label = cn.label join p on p.pos = cs.pos group by 1, 2, 3),
      per as (select component, own, max(score) filter (label = own) as mine, coalesce(max(score) filter (label <> own), 0) as rival from sc group by 1, 2)
      select component, round(avg(mine), 6) as alignment, round(avg(mine - rival), 6) as separation, round(avg(mine - rival) / greatest(abs(avg(mine)), 1e-8), 6) as ratio from per group by 1""",
    "knn_exhaustive": _LONG + """, n as (select vec_id, sqrt(sum(x * x)) as n from e group by 1),
      s as (select q.vec_id as query_id, e.vec_id, round(sum(q.x * e.x) / (any_value(nq.n) * any_value(ne.n)), 9) as score from e q join e on e.pos = q.pos join n nq on nq.vec_id = q.vec_id join n ne on ne.vec_id = e.vec_id where q.vec_id % 50 = 0 group by 1, 2),
      r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
      select query_id, vec_id, round(score, 6) as score, rank from r where rank <= 10""",
    "scale_fit": _B + " " + " union all ".join(f"select '{p}' as param, lo_{p} as lo, hi_{p} as hi from b" for p in PARAMS),
    "scale_params": _B + " select l_orderkey, l_linenumber, " + ", ".join(f"round({_scaled(p)}, 6) as {p}" for p in PARAMS) + " from lineitem, b",
    "encode_real": _projection("real") + " select l_returnflag, param, pos, round(avg(x), 5) as mean_x from y group by 1, 2, 3",
    "encode_ternary": _projection("ternary") + " select l_returnflag, param, pos, sum(x)::bigint as s from y group by 1, 2, 3",
}
