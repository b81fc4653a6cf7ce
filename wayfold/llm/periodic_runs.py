"""Runs of words that repeat with a period, found by probing a harmonic grid (operator 11).

For every period p the words at jp and (j + 1)p are compared, for all j: about n log n probes for n words. A run of
period p that is four periods long holds three such probes in a row. Only these survive; their words are compared
in chunks of growing size, and what stays is extended to both sides. Probes within a run that was found
before, of the same period or of one that divides p, are skipped: they would find that run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import table

#: A run holds at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared at first when probes are checked or extended, and at most at a time.
CHUNK, MOST_CHUNK = 32, 1 << 16
#: Rows of a batch that are worked on at a time.
ROWS = 256
#: What parts words: the ASCII white space that ``bytes.split`` knows.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))


def first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """The first place where two arrays of one length differ, or their length."""
    at, width = 0, CHUNK
    while at < len(a):
        other = a[at : at + width] != b[at : at + width]
        k = int(other.argmax())
        if other[k]:
            return at + k
        at, width = at + width, min(2 * width, MOST_CHUNK)
    return len(a)


def _held(w: np.ndarray, at: np.ndarray, p: int) -> np.ndarray:
    """Those places ``at`` whose next 2p + 1 words all come again p further on."""
    done, width, last = 0, CHUNK, 2 * p + 1
    while len(at) and done < last:
        off, step = np.arange(done, min(done + width, last)), max(1, (1 << 20) // width)
        same = [(w[at[k : k + step, None] + off] == w[at[k : k + step, None] + (off + p)]).all(1) for k in range(0, len(at), step)]
        at, done, width = at[np.concatenate(same)], done + width, min(4 * width, MOST_CHUNK)
    return at


def _within(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which stretches from ``first`` to ``last`` lie in a run; of runs of one period the one that starts last before them ends last."""
    k = np.searchsorted(starts, first, "right") - 1
    return (k >= 0) & (last < ends[k])


class _Found:
    """The runs found so far, by rising period."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []
        self._ends = np.empty((0, 3), "int64")

    def _known(self) -> np.ndarray:
        if len(self._ends) != len(self.runs):
            self._ends = np.array([(s, s + n, q) for s, n, q in self.runs], "int64")
        return self._ends

    def longer(self, words: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(period, starts, ends) of the runs of at least so many words; starts and ends both rise."""
        known = self._known()
        known = known[known[:, 1] - known[:, 0] >= words]
        cuts = np.flatnonzero(np.diff(known[:, 2])) + 1
        return [(int(k[0, 2]), k[:, 0], k[:, 1]) for k in np.split(known, cuts) if len(k)]

    def extend(self, w: np.ndarray, at: np.ndarray, p: int) -> None:
        """Add the runs of period ``p`` that hold one of the probes ``at``, which rise."""
        for q, starts, ends in self.longer(LEAST_PERIODS * p):
            if p % q == 0:
                at = at[~_within(starts, ends, at, at + 3 * p)]
        end = -1
        for i in _held(w, at, p).tolist():
            if i < end:
                continue
            end = i + first_difference(w[i : len(w) - p], w[i + p :])
            start = i - first_difference(w[:i][::-1], w[p : p + i][::-1])
            if end - start + p >= max(LEAST_WORDS, LEAST_PERIODS * p):
                self.runs.append((start, end - start + p, p))


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in the numbers ``w``, by start, then period."""
    n, found = len(w), _Found()
    top, root = n // LEAST_PERIODS, isqrt(n)
    for p in range(1, min(top, root) + 1):
        grid = w[::p]
        hit = grid[1:] == grid[:-1]
        at = np.flatnonzero(hit[:-2] & hit[1:-1] & hit[2:]) * p
        if len(at):
            found.extend(w, at, p)
    # Periods over the root have fewer probes than the root: they are gone through by j, for all periods at once.
    known, some = found.longer(LEAST_PERIODS * (root + 1)), []
    for j in range((n - 1) // (root + 1) - 2 if top > root else 0):
        p = np.arange(root + 1, min(top, (n - 1) // (j + 3)) + 1)
        p = p[w[j * p] == w[(j + 1) * p]]
        p = p[w[(j + 1) * p] == w[(j + 2) * p]]
        p = p[w[(j + 2) * p] == w[(j + 3) * p]]
        for q, starts, ends in known if len(p) else ():
            p = p[(p % q != 0) | ~_within(starts, ends, j * p, (j + 3) * p)]
        if len(p):
            some.append(np.stack([p, j * p]))
    if some:
        p, at = np.concatenate(some, 1)
        order = np.lexsort((at, p))
        p, at = p[order], at[order]
        cuts = np.flatnonzero(np.diff(p)) + 1
        for period, places in zip(p[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            found.extend(w, places, period)
    return sorted(found.runs, key=lambda r: (r[0], r[2]))


def numbers(words: list[bytes]) -> np.ndarray:
    """Words as numbers: equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(x, len(known)) for x in words), "int64", len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stay)] if runs else words)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            runs, texts = [], []
            for text in b.column(0):
                words = (text.as_py() or b"").split()
                runs.append(runs_of(numbers(words)))
                texts.append(collapsed(words, runs[-1]).decode())
            named = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([len(r) for r in runs], "int64"), pa.array(named, kind), pa.array(texts, "string")], [*b.schema.names[1:], "n_runs", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the runs of ``text``: (n_runs, runs, collapsed).

    Words are what ASCII white space parts. A run is a stretch of words of smallest period q that holds at least six
    words and four periods and that no neighbouring word extends; ``runs`` has (start, length, period) of each, from word 0,
    by start, then period. ``collapsed`` is the text without the words that a run holds after its first period, joined by
    one space. A null, empty or blank text has no runs and an empty ``collapsed``. Rows are worked on one by one, whole,
    however long; repeated rows give repeated results, and an empty table an empty one. No column of ``keep`` may be
    called like a result.
    """
    given = docs.select(F.col(text).cast("string").cast("binary").alias("_text"), *keep)
    out = docs.select(*keep).schema.add("n_runs", "long").add("runs", RUNS).add("collapsed", "string")
    return given.mapInArrow(_search, out)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a period written into every tenth document, by its id's hash h: from word a on, word i is word a + (i - a) % p.

    a = floor(h / 10) % n and p = 1 + floor((n - a) / (3 + floor(h / 10) % 8)), for n words. Without an id or words nothing is written.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", SPACE), lambda w: w != "")).alias("w"))
    some = some.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.floor(F.col("h") / 10) % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.floor(F.col("h") / 10) % 8)))
    i = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    written = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda k: F.get("w", i(k).cast("int"))), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), written).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a period written into every tenth: the number of runs, the longest one, and digests of all runs and of the collapsed text.

    Of runs of the greatest length the first, then the one of the smallest period, is given; without runs it is null.
    """
    found = periodic_runs(planted(table(spark, sf_dir, "documents")), "text", ["doc_id"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.select("*", longest.alias("best"), (-longest["less"]).alias("length"))
    return found.select("doc_id", "n_runs", F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"), F.floor(1000 * F.col("length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
