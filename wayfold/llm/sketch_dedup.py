"""Near-duplicate components by fast similarity sketches (operator 12).

A sketch has ``T`` coordinates. In each of up to T rounds every shingle is hashed to one coordinate and a value there;
a coordinate keeps the least value of the first round that reached it. What T rounds leave empty is filled by one
more round each, in which all shingles go to that coordinate. So every coordinate is filled whatever the set's size,
and the share of coordinates in which two sketches agree keeps close to the similarity.

Sets that share a band of their sketches meet in a bucket, a large bucket in cells of two blocks each. Pairs whose sketches
agree are verified on the whole sets, exactly. Only components are asked for: a pair that its cell has joined already is
not verified again, and a cell gives each linked member the first member of its component there, no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, stage, table, with_facts, worker_memory
from .graph import components
from .ngram_join import MEMO_SIZE, by_cell, in_cells, least_linked, pairs, set_key, shared, word_grams

SHINGLE_WORDS = 4
#: The similarity, as a ratio of whole numbers so that the test is exact.
NEAR = (80, 100)
#: 32 bands of 4 coordinates of 16 bits: two sets at 0.8 share no band once in twenty million times.
BANDS, BAND_ROWS = 32, 4
T = BANDS * BAND_ROWS
#: Hash values that are sorted at once, at least: small sets run several rounds together.
SPREAD = 1024
#: Chance that the sketches of a pair at 0.8 agree too seldom for the pair to be verified.
TOLERANCE = 1e-10
#: Pairs of a cell that are compared at a time.
PAIRS = 50_000
_VALUE = np.uint64(49)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_seeds = np.random.RandomState(20250311)
SEEDS = _seeds.randint(0, 1 << 32, 2 * T).astype("uint64") << np.uint64(32) | _seeds.randint(0, 1 << 32, 2 * T).astype("uint64")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(grams: np.ndarray) -> np.ndarray:
    """The ``T`` coordinates of a set of 64-bit hashes that is not empty, as 16 bits of (round, least value) each."""
    best, done = np.full(T, EMPTY), 0
    while done < T and (best == EMPTY).any():
        rounds = np.arange(done, min(T, done + max(1, SPREAD // len(grams))), dtype="uint64")
        h = _mixed(grams[None, :] ^ SEEDS[rounds][:, None])
        # The coordinate's number, the round, the value: sorted, each coordinate's first is what it keeps.
        code = np.sort(((h >> np.uint64(57) << np.uint64(57)) | (rounds[:, None] << _VALUE) | (h & np.uint64((1 << 49) - 1))).ravel())
        at = (code >> np.uint64(57)).astype("int64")
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        first = first[best[at[first]] == EMPTY]
        best[at[first]] = code[first] & np.uint64((1 << 57) - 1)
        done += len(rounds)
    for b in np.flatnonzero(best == EMPTY):
        best[b] = (np.uint64(T + b) << _VALUE) | (_mixed(grams ^ SEEDS[T + b]) & np.uint64((1 << 49) - 1)).min()
    return (_mixed(best) >> np.uint64(48)).astype("<u2")


def least_agreement() -> int:
    """The least number of equal coordinates with which a pair is verified."""
    p, tail, m = NEAR[0] / NEAR[1], 0.0, -1
    while tail < TOLERANCE:
        m += 1
        tail += comb(T, m) * p**m * (1 - p) ** (T - m)
    return m


def text_grams(texts: list[bytes | None]) -> list[np.ndarray]:
    """Each text's set of shingles: A-Z lower-cased, words parted by ASCII white space."""
    known = worker_memory("words of sketches")
    if len(known) > MEMO_SIZE:
        known.clear()
    return [word_grams((t or b"").lower().split(), SHINGLE_WORDS, known) for t in texts]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            sets = text_grams(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([set_key(g) if len(g) else None for g in sets], "binary"), pa.array([len(g) for g in sets], "int64"), pa.array([sketch(g).tobytes() if len(g) else None for g in sets], "binary")], ["doc_id", "text_hash", "key", "n", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            sets = [g for g in text_grams(whole.slice(at, 500).column(0).to_pylist()) if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(g) for g in sets], "binary"), pa.array([g.tobytes() for g in sets], "binary")], ["key", "grams"])


def agreeing(t: pa.Table) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The function that tells which pairs of rows of ``t`` are to be verified: sizes within the ratio, sketches that agree often
    enough, met in the first band that they share."""
    sig, n, band = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(-1, T), t["n"].to_numpy(), t["band"].to_numpy()
    least = least_agreement()

    def stay(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.flatnonzero(NEAR[1] * np.minimum(n[a], n[b]) >= NEAR[0] * np.maximum(n[a], n[b]))
        equal = sig[a[keep]] == sig[b[keep]]
        some = np.flatnonzero(equal.sum(1) >= least)
        keep, bands = keep[some], equal[some].reshape(-1, BANDS, BAND_ROWS).all(2)
        return keep[bands.any(1) & (bands.argmax(1) == band[a[keep]])]

    return stay


def _pairs(t: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return pairs(starts, sizes, t["bi"].to_numpy() != t["bj"].to_numpy(), t["mine"].to_numpy(), PAIRS)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of members of at least one pair that is to be verified."""
    for t, starts, sizes in by_cell(batches):
        stay, found = agreeing(t), np.zeros(t.num_rows, bool)
        for a, b in _pairs(t, starts, sizes):
            keep = stay(a, b)
            found[a[keep]] = found[b[keep]] = True
        yield from t.filter(pa.array(found)).to_batches()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, root) for each linked member of a cell: the first member of its component there."""
    for t, starts, sizes in by_cell(batches):
        stay, keys, root, n = agreeing(t), t["key"].to_pylist(), np.arange(t.num_rows), t["n"].to_numpy()
        grams = [np.frombuffer(g, "uint64") for g in t["grams"].to_pylist()]
        for a, b in _pairs(t, starts, sizes):
            keep = stay(a, b)
            a, b = a[keep], b[keep]
            cell = np.searchsorted(starts, a, "right") - 1
            order = np.argsort(cell, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                at = cell[part[0]]
                lo, here, x, y = starts[at], np.arange(sizes[at]), a[part], b[part]
                # A few at first: what they join needs no more comparison.
                step = 64
                while len(x):
                    x, y, u, v = x[step:], y[step:], x[:step], y[:step]
                    both = shared(grams, u, v)
                    near = NEAR[1] * both >= NEAR[0] * (n[u] + n[v] - both)
                    root[lo + here] = lo + least_linked(len(here), np.append(u[near] - lo, here), np.append(v[near] - lo, root[lo + here] - lo))
                    apart = root[x] != root[y]
                    x, y, step = x[apart], y[apart], 4 * step
        some = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], "binary"), pa.array([keys[i] for i in root[some]], "binary")], ["a", "b"])


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Rows whose sets of 4-word shingles have a Jaccard similarity of 0.8 or more are linked; ``component_id`` is the least doc_id
    reachable, ``kept`` tells whether it is the row's own. A text of one to three words has one shingle, all of it. Null,
    empty and blank texts have none and are linked with nothing. Equal sets are one set with copies. Repeated doc_ids
    are separate rows; nulls are the greatest id, so a component of rows with null ids alone has a null component_id and
    its rows are kept. Texts are read whole; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text")
    digest = stage(docs.mapInArrow(_digests, docs.select("doc_id", "text_hash").schema.add("key", "binary").add("n", "long").add("sig", "binary")), "sketch-digest")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    sets = stage(digest.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min(row).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")), "sketch-sets")
    n_sets = sets.count()

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    members = sets.select("key", "n", "sig", band).select("key", "n", "band", F.xxhash64(F.substring("sig", 2 * BAND_ROWS * F.col("band") + 1, F.lit(2 * BAND_ROWS)), "band").alias("b"))
    rows = in_cells(members, sets, n_sets, BANDS)
    kept = stage(rows.mapInArrow(_prune, rows.schema), "sketch-kept")

    # One text of each set that is still in play, read again from the documents.
    wanted = kept.select("key").distinct().join(sets.select("key", "least"), "key").select(F.col("least.doc_id").alias("w_id"), F.col("least.text_hash").alias("w_hash"))
    texts = docs.join(wanted, (F.col("text_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi").select("text")
    grams = texts.mapInArrow(_sets, "key binary, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))
    rows = kept.join(grams, "key").repartition("b", "bi", "bj").sortWithinPartitions("b", "bi", "bj", "key")
    found = stage(rows.mapInArrow(_verify, "a binary, b binary"), "sketch-links")

    label = components(found)
    named = stage(sets.select("key", "copies", "least").join(label.withColumnRenamed("node", "key"), "key", "left").select("key", "copies", "least", F.coalesce("label", "key").alias("label")), "sketch-named")
    heads = stage(named.groupBy("label").agg(F.min("least").alias("head"), F.count("*").alias("held")), "sketch-heads")
    hot = lambda count: F.col(count) > HOT_SHARE * n_sets
    of_set = stage(with_facts(named, heads, "label", hot("held")).select("key", "copies", F.col("head.doc_id").alias("component_id")), "sketch-of-set")
    digest = digest.select("doc_id", "key", F.col("n").alias("n_shingles"))
    out = with_facts(digest.where("key is not null"), of_set, "key", hot("copies")).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(digest.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the component of near copies of each, and whether it is its component's least."""
    return near_components(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
  from documents),
grams as (
  select distinct doc_id, array_to_string(w[i : i + {SHINGLE_WORDS - 1}], ' ') as g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE_WORDS - 1}, 1))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
near as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where {NEAR[1]} * common >= {NEAR[0]} * (x.n + y.n - common)),
reach(a, b) as (select a, b from near union select reach.a, near.b from reach join near on reach.b = near.a)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) as component_id, d.doc_id <= coalesce(c.low, d.doc_id) as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join (select a, min(b) as low from reach group by a) c on c.a = d.doc_id
"""
