"""Language identification by families (operator 10).

A linear support vector machine first picks the language family; within it, one-versus-one machines between
each two languages vote. Features are hashed counts of byte n-grams over the whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BINS = 1 << 13
N_GRAMS = (1, 2, 3, 4)
UNDETERMINED = "und"
#: Bytes of a text that are counted at a time.
SLICE = 1 << 20
#: The bound of the labelled sample that the machines are fitted on: about so many rows, of whole texts of so many
#: characters at most, as many of each language, but at least ``LANG_ROWS`` of each. Every language that is labelled is learned.
SAMPLE_ROWS, SAMPLE_CHARS, LANG_ROWS = 3200, 20_000, 16
#: More families than this are merged by likeness, so that a model of very many languages has machines for related ones alone:
#: 1,128 between families, and for L languages some L * L / 96 within them, of ``BINS`` numbers each.
MOST_FAMILIES = 48
LETTER = regex.compile(r"\p{L}")
#: Language families by code. A language that is missing here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "mr", "ur", "pa"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], "uint32")


def features(text: str) -> np.ndarray:
    """Unit vector of the roots of hashed byte n-gram counts of the lower-cased text, counted in slices of it."""
    data = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), "uint8")
    counts = np.zeros(BINS, "float32")
    for at in range(0, len(data), SLICE):
        # n-grams that begin in the slice; they end in the next.
        part = data[at : at + SLICE + N_GRAMS[-1] - 1].astype("uint32")
        code = np.zeros(len(part), "uint32")
        for n in N_GRAMS:
            code = (code[: len(part) - n + 1] + part[n - 1 :] + np.uint32(n)) * PRIMES[n - 1] if len(part) >= n else code[:0]
            mixed = (code[:SLICE] ^ (code[:SLICE] >> np.uint32(15))) * PRIMES[1]
            counts += np.bincount(mixed >> np.uint32(32 - 13), minlength=BINS)
    v = np.sqrt(counts)
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear machine of squared hinge loss, classes weighed alike, by accelerated gradient steps; y is 1 or -1."""
    w, look, bias, look_b = np.zeros(x.shape[1], "float32"), np.zeros(x.shape[1], "float32"), 0.0, 0.0
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype("float32")
    rate = 1 / (1 / c + 4.0)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look + look_b)) * weight
        g = look / c - 2 * (x.T @ (slack * y))
        new, new_b = look - rate * g, look_b + rate * 2 * float((slack * y).sum())
        look, look_b = new + t / (t + 3) * (new - w), new_b + t / (t + 3) * (new_b - bias)
        w, bias = new, new_b
    return w.astype("float32"), float(bias)


def fit_pairs(x: np.ndarray, names: np.ndarray) -> dict:
    """One machine for each two names; ``names`` gives each row's."""
    kinds = sorted(set(names))
    machines = []
    for i, j in combinations(range(len(kinds)), 2):
        of = (names == kinds[i]) | (names == kinds[j])
        machines.append((i, j, *fit_svm(x if of.all() else x[of], np.where(names[of] == kinds[i], 1, -1).astype("float32"))))
    return {"kinds": kinds, "pairs": [(i, j) for i, j, _, _ in machines], "w": np.stack([m[2] for m in machines], 1) if machines else np.zeros((x.shape[1], 0), "float32"), "b": np.array([m[3] for m in machines], "float32")}


def families(langs: np.ndarray, texts: np.ndarray) -> dict[str, str]:
    """The family of each language: by its code, or one of its own. While there are more than ``MOST_FAMILIES``, the smallest
    joins the one whose mean text is most like its own, of those that are not large already."""
    of = {v: FAMILY_OF.get(v, v) for v in sorted(set(langs))}
    members: dict[str, list[str]] = {}
    for v, f in of.items():
        members.setdefault(f, []).append(v)
    if len(members) <= MOST_FAMILIES:
        return of
    mean = {f: np.zeros(BINS, "float64") for f in members}
    for v, t in zip(langs, texts):
        mean[of[v]] += features(t)
    room = 2 * -(-len(of) // MOST_FAMILIES)
    while len(members) > MOST_FAMILIES:
        small = min(members, key=lambda f: (len(members[f]), f))
        others = [f for f in members if f != small and len(members[f]) + len(members[small]) <= room] or [f for f in members if f != small]
        unit = lambda f: mean[f] / max(float(np.sqrt(mean[f] @ mean[f])), 1e-9)
        to = max(others, key=lambda f: (float(unit(f) @ unit(small)), f))
        members[to] += members.pop(small)
        mean[to] += mean.pop(small)
    return {v: f for f, vs in members.items() for v in vs}


def fit(labelled: pd.DataFrame) -> dict:
    """A model from rows (text, lang): machines between families, and between the languages of each."""
    rows = labelled[[bool(t) and bool(LETTER.search(t)) for t in labelled["text"]]]
    if not len(rows):
        return {"families": None, "within": {}}
    langs = rows["lang"].to_numpy(object)
    of = families(langs, rows["text"].to_numpy(object))
    family = np.array([of[v] for v in langs], object)
    # The sample's matrix is the driver's largest value: it is made once, in order of family, and cut without copies.
    order = np.argsort(family, kind="stable")
    langs, family, texts = langs[order], family[order], rows["text"].to_numpy(object)[order]
    x = np.empty((len(texts), BINS), "float32")
    for i, t in enumerate(texts):
        x[i] = features(t)
    names, first = np.unique(family, return_index=True)
    parts = zip(names, first, [*first[1:], len(family)])
    return {"families": fit_pairs(x, family), "within": {f: fit_pairs(x[a:b], langs[a:b]) for f, a, b in parts}}


def vote(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(index of the winning kind, its confidence from 0 to 1) of each row: most votes, then the larger margin sum."""
    n, k = len(x), len(m["kinds"])
    if k == 1:
        return np.zeros(n, int), np.ones(n)
    margins = x @ m["w"] + m["b"]
    votes, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
    for at, (i, j) in enumerate(m["pairs"]):
        v = margins[:, at]
        votes[:, i] += v >= 0
        votes[:, j] += v < 0
        sums[:, i] += v
        sums[:, j] -= v
        least[:, i] = np.minimum(least[:, i], v)
        least[:, j] = np.minimum(least[:, j], -v)
    best = np.argmax(votes + 0.5 * np.tanh(sums / k), axis=1)
    return best, 1 / (1 + np.exp(-4 * np.clip(least[np.arange(n), best], -9, 9)))


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``und`` and 0 for a text without letters, or if no row was labelled."""
    out, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model["families"] else []
    if not some:
        return out, score
    x = np.stack([features(texts[i]) for i in some])
    families, sure = vote(x, model["families"])
    for f in set(families.tolist()):
        m, of = model["within"][model["families"]["kinds"][f]], np.flatnonzero(families == f)
        best, conf = vote(x[of], m)
        for at, b, c in zip(of.tolist(), best.tolist(), (conf * sure[of]).tolist()):
            out[some[at]], score[some[at]] = m["kinds"][b], float(c)
    return out, score


def sample(labelled: DataFrame, key: str, max_rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """About ``max_rows`` labelled rows, or ``LANG_ROWS`` of each language if that is more, chosen by a hash of ``key``; as many of each language."""
    labelled = labelled.where(F.length("text") <= SAMPLE_CHARS)
    # One row a language.
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    share = max(max_rows / len(counts), LANG_ROWS)
    part = F.pmod(F.xxhash64(key, F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    # A rare language is taken whole: by its rate alone it might have no row.
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, share / n)])
    return labelled.where(part < rate[F.col("lang")]).select("text", "lang").toPandas()


def identify(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``, predicted from the whole ``text`` alone."""
    model_bytes = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # BINS floats a machine
    given = docs.select(F.col("text").cast("string").alias("read"), *keep)
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model_bytes.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                langs, scores = predict(b.column(0).to_pylist(), m)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs), pa.array(scores, "float64")], [*keep, "lang_pred", "score"])

    return given.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_on(docs: DataFrame) -> dict:
    """A model of the documents that are labelled and not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    return fit(sample(known, "doc_id"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language.

    Null, empty and letterless texts give ``und`` with score 0; a null doc_id is not held out. Very long
    texts are read whole; repeated rows are predicted alike; without labelled rows all is ``und``.
    """
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return identify(docs, fit_on(docs), ["doc_id", "held_out"])


def known_language(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with ``lang`` as predicted, all other columns as they are.

    Rejected are texts without a letter, and those whose score is below ``least_score``.
    """
    # The row travels in one struct, so that no column of it can clash with the prediction's.
    found = identify(docs.select("text", F.struct("*").alias("row")), fit_on(docs), ["row"])
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    return kept.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])
