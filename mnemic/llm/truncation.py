"""Texts cut off by a field limit or a broken transfer.

Two kinds of evidence are combined into the probability that a text was cut.

Length. The lengths of a source's texts follow a log-normal distribution that a field limit censors from
the right. Limits are lengths on which far more texts lie than the fitted density or the lengths around them
let expect (texts come in several shapes, which no single log-normal fits): more than chance allows and more
than twice as many, so that most of them were cut. Every length is tested. The
distribution is fitted by maximum likelihood with the texts at a limit as censored observations (EM). The
share of a limit's texts that the density does not explain is the censoring posterior of a text of that
length. Texts elsewhere have their source's rate of broken transfers as prior, estimated by EM from the
endings of all its texts.

Ending. A logistic model of the last line says how much likelier it is as the beginning of a line of prose
than as a whole line (a sentence's end, heading, link, list item, caption or footer). It labels its own
data: lines inside texts are whole lines, the same lines cut at a random character are cut ones; the last
lines of texts that do not end a sentence take part with their current probability, over a few rounds, as
footers occur nowhere else. The model is fitted on SAMPLE_DOCS texts (those with the smallest hashed ids)
and applied to all; counts, lengths, limits, rates and decisions cover all texts.

Defined results. Null texts and texts of blanks only are not cut. Null sources form one source. Ties do not
arise; repeated rows give one result. Empty tables give empty results. Very long last lines are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemic.llm import sample
from mnemic.session import materialize, spread

#: Texts the ending model is fitted on, and the lines taken from each.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 8
#: Slots of the hashed features; rounds of re-weighting; steps of a fit.
DIM, ROUNDS, STEPS = 4096, 8, 150
#: Texts of the sample that a form of last line ends to be taken for a footer at first.
FOOTER = 4
#: A limit needs this many texts, and a number that chance reaches at any length with less than this
#: probability; how far below a limit a text may end when it was cut at a blank or blanks were stripped.
LIMIT_TEXTS, CHANCE, SLACK = 5, 1e-3, 40
#: Lengths beside a length that tell whether it stands out.
NEXT = 5
#: Rounds of testing all lengths and fitting the distribution anew with those that pass as censored.
FITS = 3
#: Units in which a field can be limited.
UNITS = ("chars", "bytes")
_BLANK = " \t\r\n ​"
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_STOP = re.compile(r"[.!?…][\"'”’»)\]]*$")
_BREAK = re.compile(r"[.!?…][\"'”’»)\]]*\s+\S")
_MARKS = "|·>©@/[]:#•–—()&"


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIM


def _kind(word: str, common: frozenset[str]) -> str:
    if word.lower() in common:
        return "f"
    return "d" if word[0].isdigit() else "C" if word[0].isupper() else "l"


def features(line: str, common: frozenset[str], known: frozenset[str]) -> list[int]:
    """Slots that are on for a line. ``common``: words of a large part of texts; ``known``: words seen whole."""
    line = line.strip(_BLANK)
    words = _WORD.findall(line)
    names = ["bias"]
    end = line[-1:]
    stop = bool(_STOP.search(line))
    inner = bool(_BREAK.search(line))
    names.append(f"stop{int(stop)}")
    names.append("end" + ("w" if end.isalpha() else "d" if end.isdigit() else end))
    names.append(f"inner{int(inner)}")
    start = line[:1]
    names.append("start" + ("C" if start.isupper() else "l" if start.islower() else "d" if start.isdigit() else start))
    n = len(words)
    names.append(f"n{n if n < 6 else 6 if n < 10 else 10}")
    names += [f"mark{c}" for c in _MARKS if c in line]
    if "  " in line:
        names.append("gap")
    last_sentence = words
    if inner:
        last_sentence = _WORD.findall(line[[m.end() for m in _BREAK.finditer(line)][-1] - 1 :])
    kinds = [_kind(w, common) for w in last_sentence]
    if words:
        last, first = words[-1], words[0]
        names.append(f"lastkind{kinds[-1] if kinds else '-'}{int(last.lower() in known)}{int(len(last) < 3)}{int(stop)}")
        names.append(f"tail{int(inner)}{int(stop)}{kinds[-1] if kinds else '-'}{int(last.lower() in known)}{int(end.isalnum())}")
        names.append(f"firstkind{_kind(first, common)}")
        if first.lower() in common:
            names.append("first=" + first)
        if last.lower() in common:
            names.append("last=" + last)
        names.append(f"few{min(kinds.count('f'), 4)}{int(stop)}{int(inner)}")
        caps = sum(k == "C" for k in kinds[1:])
        names.append(f"caps{min(caps, 3)}of{min(len(kinds), 5)}{int(stop)}")
        if n <= 7:
            shape = "".join(_kind(w, common) for w in words)
            names.append(f"shape{shape}{int(stop)}")
            names.append("text" + " ".join(w if w.lower() in common else _kind(w, common) for w in words) + ("" if end.isalnum() else end))
    else:
        names.append("empty")
    return [_slot(x) for x in names]


def _matrix(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat slots and the row of each."""
    return np.fromiter((s for r in rows for s in r), np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _score(w: np.ndarray, slots: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, w[slots], n)


def _fit(slots: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Adam, with a small ridge; deterministic."""
    m, v, n = np.zeros(DIM), np.zeros(DIM), len(y)
    for i in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(_score(w, slots, row, n), -30, 30)))
        g = np.bincount(slots, ((p - y) * weight)[row], DIM) / weight.sum() + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


class Endings:
    """The fitted model of last lines: log likelihood ratio of cut against whole."""

    def __init__(self, texts: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        df, whole = Counter(), Counter()
        split = []
        for t in texts:
            lines = [x for x in (x.strip(_BLANK) for x in t.strip(_BLANK).split("\n")) if x]
            split.append(lines)
            seen = {w.lower() for x in lines for w in _WORD.findall(x)}
            df.update(seen)
            whole.update({w.lower() for x in lines[:-1] for w in _WORD.findall(x)})
        self.common = frozenset(w for w, n in df.items() if n >= max(3, 0.03 * len(texts)) and not w.isdigit())
        self.known = frozenset(w for w, n in whole.items() if n >= 2)
        self.w = np.zeros(DIM)
        rows, y, open_rows, forms = [], [], [], []
        for lines in split:
            inside = lines[1:-1]
            pick = rng.permutation(len(inside))[:SAMPLE_LINES]
            for i in pick:
                line = inside[i]
                rows.append(self._slots(line))
                y.append(0.0)
                if _STOP.search(line) and len(_WORD.findall(line)) > 3:  # prose: a cut falls anywhere in it
                    at = int(rng.integers(1, len(line)))
                    cut = line[:at].strip(_BLANK)
                    if cut and not _STOP.search(cut):
                        # a byte limit may leave part of a character, which readers show as U+FFFD
                        rows.append(self._slots(cut + "\ufffd" if rng.random() < 0.02 else cut))
                        y.append(1.0)
            if lines:
                if _STOP.search(lines[-1]):
                    rows.append(self._slots(lines[-1]))
                    y.append(0.0)
                else:
                    open_rows.append(self._slots(lines[-1]))
                    forms.append(" ".join(w if w.lower() in self.common else _kind(w, self.common) for w in _WORD.findall(lines[-1])))
        if not rows or not any(y):
            return
        y = np.array(y)
        base = np.ones(len(y))
        base[y == 1] = (y == 0).sum() / max(1, (y == 1).sum())  # equal weight of both sides: the score is a ratio
        n_open = len(open_rows)
        slots, row = _matrix(rows + open_rows + open_rows)
        # to begin with, forms that end several texts are footers and the like, forms that end one are cut lines
        often = Counter(forms)
        p = np.array([0.05 if often[f] >= FOOTER else 0.7 for f in forms])
        # open last lines are the very lines to be told apart, so each counts more than a line inside
        heavy = 2.0
        prior = 0.25
        for _ in range(ROUNDS):
            target = np.concatenate([y, np.ones(n_open), np.zeros(n_open)])
            weight = np.concatenate([base, 0.0 * p, heavy * (1 - p)])
            self.w = _fit(slots, row, target, weight, self.w)
            if not n_open:
                break
            s = _score(self.w, slots, row, len(target))[len(y) : len(y) + n_open]
            for _ in range(10):
                p = 1 / (1 + np.exp(-np.clip(s + math.log(prior / (1 - prior)), -30, 30)))
                prior = float(np.clip(p.mean(), 0.01, 0.9))

    def _slots(self, line: str) -> list[int]:
        return features(line, self.common, self.known)

    def ratio(self, lines: list[str]) -> np.ndarray:
        if not lines:
            return np.zeros(0)
        slots, row = _matrix([self._slots(x) for x in lines])
        return _score(self.w, slots, row, len(lines))


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def fit_lengths(n: float, s1: float, s2: float, censored: list[tuple[float, float]]) -> tuple[float, float]:
    """Mean and deviation of log length: n whole texts with sums s1, s2 of log length and its square, and
    (log limit, number) of censored ones. EM for a right-censored normal."""
    total = n + sum(m for _, m in censored)
    if total <= 0:
        return 0.0, 1.0
    mu = (s1 + sum(c * m for c, m in censored)) / total
    sd = math.sqrt(max(1e-4, (s2 + sum(c * c * m for c, m in censored)) / total - mu * mu))
    for _ in range(100):
        e1, e2 = s1, s2
        for c, m in censored:
            z = (c - mu) / sd
            hazard = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / max(_normal_sf(z), 1e-12)
            mean = mu + sd * hazard
            e1 += m * mean
            e2 += m * (mu * mu + sd * sd + sd * (c + mu) * hazard)
        mu_, sd_ = e1 / total, math.sqrt(max(1e-4, e2 / total - (e1 / total) ** 2))
        if abs(mu_ - mu) + abs(sd_ - sd) < 1e-9:
            break
        mu, sd = mu_, sd_
    return mu, sd


def _mass(mu: float, sd: float, lo: float, hi: float) -> float:
    """Share of lengths in [lo, hi]."""
    a, b = (math.log(max(x, 0.5)) for x in (lo - 0.5, hi + 0.5))
    return max(0.0, _normal_sf((a - mu) / sd) - _normal_sf((b - mu) / sd))


def _by_chance(k: int, expected: float) -> float:
    """Probability that a Poisson number is k or more (upper bound)."""
    if k <= expected:
        return 1.0
    term = math.exp(k * math.log(max(expected, 1e-12)) - expected - math.lgamma(k + 1))
    return min(1.0, term / max(1e-12, 1 - expected / (k + 1)))


class Lengths:
    """Length distribution, limits and censoring posteriors of one source, in one unit."""

    def __init__(self, n: int, s1: float, s2: float) -> None:
        self.n, self.s1, self.s2 = n, s1, s2
        self.limits: dict[int, int] = {}
        self.around: dict[int, float] = {}
        self.prior: dict[int, tuple[float, float]] = {}
        self.mu, self.sd = fit_lengths(n, s1, s2, [])

    def expected(self, length: int, around: float) -> float:
        """Texts of this length that the density, or the number ``around`` it, lets expect."""
        return max(self.n * _mass(self.mu, self.sd, length, length), around)

    def unexpected(self, length: int, k: int, around: float) -> bool:
        """Whether k texts of this length are too many for chance and mostly unexplained."""
        expected = self.expected(length, around)
        return k >= LIMIT_TEXTS and k > 2 * expected and _by_chance(k, expected) * self.n < CHANCE

    def censor(self, limits: dict[int, int], around: dict[int, float]) -> None:
        """Take these lengths, and their numbers of texts, for limits and fit the distribution anew."""
        self.limits, self.around = limits, around
        taken = [(math.log(c), k) for c, k in limits.items()]
        m = sum(k for _, k in taken)
        self.mu, self.sd = fit_lengths(self.n - m, self.s1 - sum(a * k for a, k in taken), self.s2 - sum(a * a * k for a, k in taken), taken)

    def judge(self, near: dict[int, int]) -> None:
        """Censoring posteriors at and below the limits. near: texts within SLACK below each."""
        for c, k in self.limits.items():
            below = self.n * _mass(self.mu, self.sd, c - SLACK, c - 1)
            self.prior[c] = (min(0.995, max(0.5, 1 - self.expected(c, self.around[c]) / k)), min(0.95, max(0.02, 1 - below / max(near.get(c, 0), 1))))

    def at(self, length: int) -> tuple[int, float] | None:
        """Limit and censoring posterior of a text of this length, or None where no limit is near."""
        for c, (on, below) in self.prior.items():
            if length == c:
                return c, on
            if c - SLACK <= length < c:
                return c, below
        return None


def last_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, source, chars, bytes, line): lengths and last line of every text that has one."""
    text = F.regexp_replace(F.col("text"), "[\\s ​]+$", "")
    return documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.length("text").alias("chars"), F.octet_length(F.regexp_replace("text", "\ufffd+$", "")).alias("bytes"), F.substring_index(text, "\n", -1).alias("line")).filter("doc_id is not null and line <> ''")


def _scorer(model: Endings):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = model.ratio(batch.column("line").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", *UNITS)), pa.array(ratio)], names=["doc_id", "source", *UNITS, "ratio"])

    return scan


def _unexpected(lengths: dict[str, Lengths]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("source", "n", "k", "around")), strict=True)
            yield batch.filter(pa.array([lengths[s].unexpected(*r) for s, *r in rows], pa.bool_()))

    return scan


class Truncation:
    """Scores of all texts and per-source models; ``cut`` and ``rates`` are read off them."""

    def __init__(self, documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> None:
        self.model = Endings(sample.texts(documents, "doc_id", "text", sample_docs))
        scored = spread(last_lines(documents)).mapInArrow(_scorer(self.model), "doc_id long, source string, chars int, bytes int, ratio double")
        scored = materialize(scored, "endings")
        both = {u: self._lengths(scored, u) for u in UNITS}
        # a source's limit is in the unit in which more of its texts lie on limits
        self.unit = {s: max(UNITS, key=lambda u: (sum(both[u][s].limits.values()), u == "chars")) for s in both["chars"]}
        self.lengths = {s: both[u][s] for s, u in self.unit.items()}
        in_bytes = [s for s, u in self.unit.items() if u == "bytes"]
        self.scored = scored.select("doc_id", "source", F.when(F.col("source").isin(in_bytes), F.col("bytes")).otherwise(F.col("chars")).alias("n"), "ratio")
        self.rate = self._rates()

    @staticmethod
    def _lengths(scored: DataFrame, unit: str) -> dict[str, Lengths]:
        scored = scored.select("source", F.col(unit).alias("n"))
        log = F.log(F.col("n").cast("double"))
        sums = scored.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(log).alias("s1"), F.sum(log * log).alias("s2")).collect()
        # most texts per length beside, above and below a length, there beyond those that were cut at a blank before it
        w = Window.partitionBy("source").orderBy("n")
        sides = [F.coalesce(F.sum("k").over(w.rangeBetween(a, a + m - 1)), F.lit(0)) / m for a, m in ((1, NEXT), (-NEXT, NEXT), (1, SLACK), (-2 * SLACK, SLACK))]
        by_length = materialize(scored.groupBy("source", "n").agg(F.count(F.lit(1)).alias("k")).withColumn("around", F.greatest(*sides)), "lengths")
        often = by_length.filter(F.col("k") >= LIMIT_TEXTS)
        lengths = {r["source"]: Lengths(r["n"], r["s1"], r["s2"]) for r in sums}
        for _ in range(FITS):
            found = sorted(often.mapInArrow(_unexpected(lengths), often.schema).collect())  # those that pass only
            for s, x in lengths.items():
                x.censor({r["n"]: r["k"] for r in found if r["source"] == s}, {r["n"]: r["around"] for r in found if r["source"] == s})
        limits = [(s, c) for s, x in lengths.items() for c in x.limits]
        if limits:
            want = scored.sparkSession.createDataFrame(limits, "source string, c int")
            got = by_length.join(F.broadcast(want), "source").filter((F.col("n") >= F.col("c") - SLACK) & (F.col("n") < F.col("c"))).groupBy("source", "c").agg(F.sum("k").alias("k")).collect()
            for s, x in lengths.items():
                x.judge({r["c"]: r["k"] for r in got if r["source"] == s})
        return lengths

    def _prior(self) -> DataFrame:
        """(source, c, lo, hi, p): lengths in [lo, hi] have the censoring posterior p."""
        rows = []
        for s, x in self.lengths.items():
            for c, (on, below) in x.prior.items():
                rows += [(s, c, c, c, on), (s, c, c - SLACK, c - 1, below)]
        return self.scored.sparkSession.createDataFrame(rows, "source string, c int, lo int, hi int, p double")

    def _with_prior(self) -> DataFrame:
        known = F.broadcast(self._prior().withColumnRenamed("source", "s"))  # two rows per limit
        hit = (F.col("source") == F.col("s")) & F.col("n").between(F.col("lo"), F.col("hi"))
        joined = self.scored.join(known, hit, "left").groupBy("doc_id", "source", "n", "ratio")
        return joined.agg(F.max_by("c", "p").alias("c"), F.max("p").alias("p")).withColumn("p", F.when(F.col("p") > 0, F.col("p")))

    def _rates(self) -> dict[str, float]:
        """Rate of broken transfers per source, by EM over binned endings of texts at no limit."""
        bins = self._with_prior().filter("p is null").groupBy("source", F.round(F.greatest(F.least("ratio", F.lit(15.0)), F.lit(-15.0)) * 4).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()
        def fitted(rows: np.ndarray) -> float:
            rate = 0.05
            for _ in range(50):
                p = 1 / (1 + np.exp(-(rows[:, 0] + math.log(rate / (1 - rate)))))
                rate = float(np.clip((p * rows[:, 1]).sum() / rows[:, 1].sum(), 0.0005, 0.5))
            return rate

        of = {s: np.array([(r["b"] / 4, r["k"]) for r in bins if r["source"] == s]) for s in self.lengths}
        if not bins:
            return dict.fromkeys(self.lengths, 0.01)
        whole = fitted(np.concatenate([x for x in of.values() if len(x)]))
        # a source's own rate, but no less than the whole collection's: few broken texts say little about a source
        out = {s: max(whole, fitted(x)) if len(x) else whole for s, x in of.items()}
        return out

    def scores(self) -> DataFrame:
        """(doc_id, source, n, c, p_cut): probability that the text was cut, and the limit that explains it."""
        if not self.lengths:
            return self.scored.select("doc_id", "source", "n", F.lit(None).cast("int").alias("c"), F.lit(0.0).alias("p_cut"))
        rate = F.element_at(F.create_map(*[F.lit(x) for kv in self.rate.items() for x in kv]), F.col("source"))
        prior = F.coalesce("p", rate)
        odds = F.col("ratio") + F.log(prior / (1 - prior))
        return self._with_prior().select("doc_id", "source", "n", "c", (1 / (1 + F.exp(-odds))).alias("p_cut"))

    def cut(self) -> DataFrame:
        return self.scores().filter("p_cut >= 0.5").select("doc_id", "source", "n", "c", "p_cut").dropDuplicates(["doc_id"])

    def rates(self) -> DataFrame:
        """(source, n_docs, n_cut, n_at_limit, rate, limits) per source."""
        limits = {s: ",".join(f"{c} {self.unit[s]}" for c in sorted(x.limits)) for s, x in self.lengths.items()} or {"": ""}
        named = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("source"))
        cut = F.col("p_cut") >= 0.5
        return self.scores().groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(cut, 1)).alias("n_cut"), F.count(F.when(cut & F.col("c").isNotNull(), 1)).alias("n_at_limit"), F.round(F.avg(cut.cast("int")), 6).alias("rate")).withColumn("limits", named)
