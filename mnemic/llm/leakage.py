"""Evaluation texts leaking into training text.

Spaced-seed hashing. Fixed masks over windows of ``SPAN`` words ignore some positions, so a window still
hits when words at ignored positions were substituted. Windows of the test items are hashed under each
mask; every window of every document is hashed the same way and looked up; around each hit the two texts
are aligned word by word and the overlap is verified, exactly or with a number of substitutions.

The test items are a query set that is held against all rows in blocks: their window hashes are sorted
arrays of at most ``BLOCK_SEEDS`` entries, so what is sent to the executors is bounded whatever the number
of items; more items mean more blocks, each a scan of the documents. Documents are never shuffled, and each
is read whole within the scan, so the cost is linear in their text and no key can be hot.

Completeness. SPAN is at most the length of the shortest overlap that is asked for, so every exact overlap
contains a window that hits under every mask. With substitutions, the positions of a window are dealt into
classes, two more than substitutions are allowed or further, and there is a mask for every choice of as many
classes to ignore as there are substitutions: wherever they fall, one mask ignores them all, so every overlap is
found. A hit whose window differs in more words than are allowed belongs to no overlap and is dropped.

Defined results. Null and empty texts have no words. Items with fewer words than the overlap asked for
cannot leak. Items with equal text all count. Duplicate rows give one result. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemic.llm import words
from mnemic.session import spread

SPAN = 12
#: Numbers of classes that a window's positions are dealt into.
CLASSES = (3, 4, 6, 12)
#: Pairs of a window and a seed that are compared at a time.
PAIRS = 1_000_000
#: Most window hashes in one block of test items (8 bytes and an 8-byte position each).
BLOCK_SEEDS = 2_000_000
MIN_EXACT = 12


def cover(substitutions: int) -> tuple[tuple[int, ...], ...]:
    """Positions of a window that count, per mask: any ``substitutions`` positions are ignored by one of them."""
    if not 0 <= substitutions <= SPAN - 2:
        raise ValueError(f"a window of {SPAN} words bears 0 to {SPAN - 2} substitutions")
    n = next(c for c in CLASSES if c >= substitutions + 2)
    return tuple(tuple(p for p in range(SPAN) if p % n not in ignored) for ignored in combinations(range(n), substitutions))


class _Items:
    """A block of test items: words, and for each mask the sorted hashes of their windows."""

    def __init__(self, ids: list[int], texts: list[str | None], masks: tuple[tuple[int, ...], ...]) -> None:
        self.ids = np.array(ids, np.int64)
        self.masks = masks
        self.code, self.starts = words.flatten(texts)
        self.seeds = []
        for mask in masks:
            h, n = words.runs(self.code, self.starts, SPAN, mask)
            item = np.repeat(np.arange(len(ids)), np.diff(n))
            at = np.arange(len(h)) - n[item] + self.starts[item]
            order = np.argsort(h, kind="stable")
            self.seeds.append((h[order], item[order], at[order]))


def _extend(code: np.ndarray, lo: int, hi: int, other: np.ndarray, olo: int, ohi: int, p: int, q: int, spare: int) -> tuple[int, int]:
    """Longest overlap along the diagonal of (p, q) with at most ``spare`` substitutions that covers the
    window at (p, q) where it can, starting and ending on equal words: (length, substitutions)."""
    back = min(p - lo, q - olo)
    n = back + min(hi - p, ohi - q)
    same = code[p - back : p - back + n] == other[q - back : q - back + n]
    wrong = np.concatenate(([-1], np.flatnonzero(~same), [n]))
    best, subs = 0, 0
    for i in range(len(wrong) - 1):
        j = min(i + 1 + spare, len(wrong) - 1)
        a, b, used = wrong[i] + 1, wrong[j], j - i - 1
        if a == wrong[i + 1]:  # nor is a start on one
            continue
        while used and b > a and wrong[j - 1] == b - 1:  # an end on a substitution is no overlap
            j, b, used = j - 1, wrong[j - 1], used - 1
        if (b - a, -used) > (best, -subs):
            best, subs = int(b - a), int(used)
    return best, subs


def _rank(found: tuple[int, int]) -> tuple[int, int]:
    return found[0], -found[1]


def _pairs(lo: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a hit and one of its seeds, about PAIRS at a time; hit k has the seeds from lo[k] on."""
    ends = np.cumsum(size)
    cuts = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)), [len(size)])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = np.repeat(np.arange(a, b), size[a:b])
        yield k, np.arange(len(k)) + np.repeat(lo[a:b] - (ends[a:b] - size[a:b]) + ends[a] - size[a], size[a:b])


def _near(code: np.ndarray, other: np.ndarray, k: np.ndarray, t: np.ndarray, pos: np.ndarray, at: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose windows differ in at most ``spare`` words."""
    wrong = np.zeros(len(k), np.int64)
    for j in range(SPAN):
        wrong += code[pos[k] + j] != other[at[t] + j]
        keep = wrong <= spare
        k, t, wrong = k[keep], t[keep], wrong[keep]
    return k, t


def _hits(items: _Items, min_words: int, spare: int):
    names = ["item_id", "doc_id", "n_words", "n_substituted"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            code, starts = words.flatten(batch.column("text").to_pylist())
            best: dict[tuple[int, int], tuple[int, int]] = {}
            done: set[tuple[int, int, int]] = set()
            for mask, (seeds, item, at) in zip(items.masks, items.seeds, strict=True):
                h, n = words.runs(code, starts, SPAN, mask)
                if not len(h) or not len(seeds):
                    continue
                lo = np.searchsorted(seeds, h, "left")
                hit = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == h)
                if not len(hit):
                    continue
                doc = np.searchsorted(n, hit, "right") - 1
                pos = hit - n[doc] + starts[doc]
                size = np.searchsorted(seeds, h[hit], "right") - lo[hit]
                for k, t in _pairs(lo[hit], size):
                    k, t = _near(code, items.code, k, t, pos, at, spare)
                    _, first = np.unique(np.stack((doc[k], item[t], pos[k] - at[t])), axis=1, return_index=True)
                    for d, i, p, q in zip(doc[k[first]].tolist(), item[t[first]].tolist(), pos[k[first]].tolist(), at[t[first]].tolist(), strict=True):
                        if (d, i, p - q) in done:
                            continue
                        done.add((d, i, p - q))
                        found = _extend(code, starts[d], starts[d + 1], items.code, items.starts[i], items.starts[i + 1], p, q, spare)
                        if found[0] >= min_words and _rank(found) > _rank(best.get((d, i), (0, 0))):
                            best[d, i] = found
            rows = [(int(items.ids[i]), int(ids[d]), *v) for (d, i), v in best.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=names)

    return scan


def _blocks(items: DataFrame, masks: tuple[tuple[int, ...], ...]) -> Iterator[_Items]:
    """Test items in blocks of a bounded number of seeds, streamed to the driver one partition at a time."""
    ids, texts, n = [], [], 0
    for row in items.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        size = len(row["text"]) // 2 + 1  # no text has more words than this
        if ids and (n + size) * len(masks) > BLOCK_SEEDS:
            yield _Items(ids, texts, masks)
            ids, texts, n = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        n += size
    if ids:
        yield _Items(ids, texts, masks)


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_EXACT, substitutions: int = 0) -> DataFrame:
    """(item_id, doc_id, n_words, n_substituted): the longest verified overlap of each leaked item and document."""
    if min_words < SPAN:
        raise ValueError(f"overlaps shorter than {SPAN} words have no whole window")
    spark = documents.sparkSession
    schema = "item_id long, doc_id long, n_words int, n_substituted int"
    found = spark.createDataFrame([], schema)
    masks = cover(substitutions) if substitutions else cover(1)[:1]  # an exact overlap hits under any mask
    docs = spread(documents.select("doc_id", "text").filter("doc_id is not null and text is not null"))
    for block in _blocks(items, masks):
        shared = spark.sparkContext.broadcast(block)  # bounded by BLOCK_SEEDS
        found = found.unionByName(docs.mapInArrow(_lazy(shared, min_words, substitutions), schema))
    best = F.struct("n_words", (-F.col("n_substituted")).alias("s"))
    return found.groupBy("item_id", "doc_id").agg(F.max(best).alias("b")).select("item_id", "doc_id", F.col("b.n_words").alias("n_words"), (-F.col("b.s")).alias("n_substituted"))


def _lazy(shared, min_words: int, substitutions: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _hits(shared.value, min_words, substitutions)(batches)

    return scan
