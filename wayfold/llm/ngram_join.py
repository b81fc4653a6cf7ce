"""N-gram Jaccard self-join with Bayesian pruning of candidates (operator 7).

Documents with one shingle set are joined once, through a representative. Representatives that share a band
of their MinHash signature are candidates; a pair's MinHash values are compared a few at a time, and the pair
is dropped as soon as the posterior probability of reaching the threshold falls below a tolerance. Pairs that
stay are verified on the shingle sets. No pair becomes a row: a task that holds a block of a bucket gives, for
each member, the number of its links there and the least member it is linked with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, stage, table, with_facts, worker_memory
from .graph import components

SHINGLE_WORDS = 5
#: The similarity, as a ratio of whole numbers so that the test is exact.
NEAR = (4, 5)
#: 36 bands of 5 MinHash values of 8 bits: two sets at 0.8 share no band once in two million times.
BANDS, BAND_ROWS = 36, 5
N_HASHES = BANDS * BAND_ROWS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 30, 1e-7
#: Members of a bucket are dealt to blocks of about this size; each two blocks meet in a task.
BLOCK = 256
#: The shingles of a block at most, about: a cell's sets are held in memory while its pairs are verified.
BLOCK_SHINGLES = 1 << 20
#: Words whose hashes a Python worker remembers; the bound is of memory only.
MEMO_SIZE = 500_000

_random = np.random.RandomState(20240607)
FACTORS = _random.randint(0, 1 << 31, N_HASHES).astype("uint32") * np.uint32(2) + np.uint32(1)
OFFSETS = _random.randint(0, 1 << 31, N_HASHES).astype("uint32") * np.uint32(2) + _random.randint(0, 2, N_HASHES).astype("uint32")


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` remembers them."""
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), "uint64", len(words))


def shingles(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of five words, lower-cased and split at white space.

    A text of one to four words has one shingle, all of it; a null or blank text has none.
    """
    return word_grams((text or "").lower().split(), SHINGLE_WORDS, known)


def word_grams(words: list, width: int, known: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``width`` words; of fewer words, the one of all of them; of none, none."""
    if not words:
        return np.empty(0, "uint64")
    w = word_hashes(words, known)
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, "uint64")
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(grams: np.ndarray) -> bytes:
    """8 mixed bits of each of the set's MinHash values."""
    x = (grams >> np.uint64(32)).astype("uint32")[:, None]
    least = np.full(N_HASHES, 0xFFFFFFFF, "uint32")
    for at in range(0, len(x), 2048):
        y = x[at : at + 2048] * FACTORS
        y += OFFSETS
        np.minimum(least, y.min(axis=0), out=least)
    least = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    least = (least ^ (least >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (least >> np.uint32(24)).astype("uint8").tobytes()


def set_key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _shingled(texts: list[str | None]) -> list[np.ndarray]:
    known = worker_memory("word hashes")
    if len(known) > MEMO_SIZE:
        known.clear()
    return [shingles(t, known) for t in texts]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            sets = _shingled(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([set_key(g) if len(g) else None for g in sets], "binary"), pa.array([len(g) for g in sets], "int32"), pa.array([signature(g) if len(g) else None for g in sets], "binary")], ["doc_id", "text_hash", "key", "n", "sig"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            sets = _shingled(whole.slice(at, 500).column(0).to_pylist())
            sets = [g for g in sets if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(g) for g in sets], "binary"), pa.array([g.tobytes() for g in sets], "binary")], ["key", "grams"])


@cache
def least_matches() -> list[int]:
    """For each number of compared values, the least number of equal ones with which a pair stays.

    With a flat prior the posterior of the match rate is a beta distribution; its tail above the threshold
    is a binomial sum. Unequal MinHash values agree in their 8 bits once in 256 times.
    """
    t = NEAR[0] / NEAR[1] + (1 - NEAR[0] / NEAR[1]) / 256
    out = []
    for n in range(STEP, N_HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < TOLERANCE:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(sig: np.ndarray, n: np.ndarray, band: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of rows stay: sizes within the ratio, met first in this band, not pruned."""
    small, large = np.minimum(n[a], n[b]).astype("int64"), np.maximum(n[a], n[b]).astype("int64")
    keep = np.flatnonzero(NEAR[1] * small >= NEAR[0] * large)
    equal = sig[a[keep]] == sig[b[keep]]
    bands = equal.reshape(-1, BANDS, BAND_ROWS).all(2)
    stay = bands.any(1) & (bands.argmax(1) == band[a[keep]])
    keep, equal = keep[stay], equal[stay]
    matches = np.zeros(len(keep), "int32")
    for step, least in enumerate(least_matches()):
        matches += equal[:, step * STEP : (step + 1) * STEP].sum(1, dtype="int32")
        stay = matches >= least
        keep, equal, matches = keep[stay], equal[stay], matches[stay]
    return keep


def pairs(starts: np.ndarray, sizes: np.ndarray, cross: np.ndarray, mine: np.ndarray, per_chunk: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each cell, or between the two blocks of a cell that joins two, in chunks."""
    for m in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(int(m), 1)
        at = starts[sizes == m]
        step = max(1, per_chunk // len(i))
        for k in range(0, len(at), step):
            for p in range(0, len(i), per_chunk):
                a = (at[k : k + step, None] + i[None, p : p + per_chunk]).ravel()
                b = (at[k : k + step, None] + j[None, p : p + per_chunk]).ravel()
                meet = ~cross[a] | (mine[a] != mine[b])
                yield a[meet], b[meet]


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole cells, with each cell's first row and size; rows come sorted by (b, bi, bj)."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table, last: bool):
        ids = np.stack([t.column(c).to_numpy().astype("int64") for c in ("b", "bi", "bj")])
        starts = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(0)]))
        end = t.num_rows if last else int(starts[-1])
        starts = starts if last else starts[:-1]
        return t.slice(0, end), starts, np.diff(np.append(starts, end)), t.slice(end)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole, starts, sizes, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
        if len(starts):
            yield whole, starts, sizes
        held = rest.to_batches()
    if held:
        whole, starts, sizes, _ = cut(pa.Table.from_batches(held).combine_chunks(), True)
        yield whole, starts, sizes


def _columns(t: pa.Table):
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "uint8").reshape(-1, N_HASHES)
    return sig, t.column("n").to_numpy(), t.column("band").to_numpy(), t.column("mine").to_numpy(), t.column("bi").to_numpy() != t.column("bj").to_numpy()


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of members of at least one pair that stays."""
    for t, starts, sizes in by_cell(batches):
        sig, n, band, mine, cross = _columns(t)
        found = np.zeros(t.num_rows, bool)
        for a, b in pairs(starts, sizes, cross, mine):
            keep = surviving(sig, n, band, a, b)
            found[a[keep]] = found[b[keep]] = True
        yield from t.filter(pa.array(found)).to_batches()


def shared(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, counted on bit sets over the cell's shingles."""
    if len(a) == 1:
        return np.array([len(np.intersect1d(grams[a[0]], grams[b[0]], assume_unique=True))])
    used, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = [grams[u] for u in used]
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    bits = np.zeros((len(used), -(-len(names) // 64)), "uint64")
    rows = np.repeat(np.arange(len(used)), [len(s) for s in sets])
    np.bitwise_or.at(bits, (rows, at >> 6), np.uint64(1) << (at & 63).astype("uint64"))
    i, j, out, step = inverse[: len(a)], inverse[len(a) :], np.empty(len(a), "int64"), max(1, (1 << 22) // bits.shape[1])
    for k in range(0, len(a), step):
        out[k : k + step] = np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(1, dtype="int64")
    return out


def least_linked(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of a cell's rows the first row of its component under the links (a, b)."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each linked member of a cell: (key, links, root), links being the copies of its partners."""
    for t, starts, sizes in by_cell(batches):
        sig, n, band, mine, cross = _columns(t)
        keys, copies = t.column("key").to_pylist(), t.column("copies").to_numpy()
        grams = [np.frombuffer(g, "uint64") for g in t.column("grams").to_pylist()]
        links, root = np.zeros(t.num_rows, "int64"), np.arange(t.num_rows)
        for a, b in pairs(starts, sizes, cross, mine):
            keep = surviving(sig, n, band, a, b)
            a, b = a[keep], b[keep]
            cell = np.searchsorted(starts, a, "right")
            order = np.argsort(cell, kind="stable")
            cuts = np.flatnonzero(np.diff(cell[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                x, y = a[part], b[part]
                both = shared(grams, x, y)
                near = NEAR[1] * both >= NEAR[0] * (n[x].astype("int64") + n[y] - both)
                x, y = x[near], y[near]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                if len(x):
                    # The cell's earlier chunks are in its roots; they join as edges.
                    at = cell[part[0]] - 1
                    lo, here = starts[at], np.arange(sizes[at])
                    root[lo + here] = lo + least_linked(len(here), np.append(x - lo, here), np.append(y - lo, root[lo + here] - lo))
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], "binary"), pa.array(links[some], "int64"), pa.array([keys[i] for i in root[some]], "binary")], ["key", "links", "root"])


def in_cells(members: DataFrame, reps: DataFrame, n_sets: int, bands: int) -> DataFrame:
    """(key, band, b, bi, bj, mine, n, sig): the ``members`` (key, n, band, b) of every bucket b of two or more, with the
    signature that ``reps`` (key, n, sig) has of each, sorted by cell.

    A bucket is dealt to blocks; a cell is one block with itself (bi = bj) or two of them, ``mine`` the member's own block.
    """
    buckets = stage(members.groupBy("b").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1"), "near-buckets")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.least(F.col("size"), F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    dealt = with_facts(members, buckets, "b", F.col("size") > HOT_SHARE * bands * n_sets).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # A member meets its signature once a bucket and takes it along to its cells.
    dealt = stage(dealt.select("key", "band", "b", "mine", "blocks"), "near-dealt").join(reps.select("key", "n", "sig"), "key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = dealt.select("key", "band", "b", "mine", "n", "sig", other).select("key", "band", "b", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine", "n", "sig")
    return cells.repartition("b", "bi", "bj").sortWithinPartitions("b", "bi", "bj", "key")


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, first) for each row of ``docs`` (doc_id, text).

    ``first`` tells whether the row's (doc_id, text_hash) is the least of its class, nulls last.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text")
    digest = stage(docs.mapInArrow(_digests, docs.select("doc_id", "text_hash").schema.add("key", "binary").add("n", "integer").add("sig", "binary")), "near-digest")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    reps = stage(digest.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min(row).alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-sets")

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    members = reps.select("key", "n", "sig", band).select("key", "n", "band", F.xxhash64(F.substring("sig", F.col("band") * BAND_ROWS + 1, F.lit(BAND_ROWS)), "band").alias("b"))
    n_sets = reps.count()
    rows = in_cells(members, reps, n_sets, BANDS)
    kept = stage(rows.mapInArrow(_prune, rows.schema), "near-kept")

    # One text of each set that is still in play, read again from the documents.
    need = kept.select("key").distinct().join(reps.select("key", "least", "copies"), "key")
    wanted = need.select(F.col("least.doc_id").alias("w_id"), F.col("least.text_hash").alias("w_hash"))
    texts = docs.join(wanted, (F.col("text_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi").select("text")
    grams = texts.mapInArrow(_grams, "key binary, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))
    sets = need.select("key", "copies").join(grams, "key")
    rows = kept.join(sets, "key").repartition("b", "bi", "bj").sortWithinPartitions("b", "bi", "bj", "key")
    found = stage(rows.mapInArrow(_verify, "key binary, links long, root binary"), "near-links")

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = reps.select("key", "least", "copies").join(links, "key", "left").join(label.withColumnRenamed("node", "key"), "key", "left").select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("label", "key").alias("label"), "copies")
    named = stage(named, "near-named")
    classes = named.groupBy("label").agg(F.min("least").alias("head"), F.count("*").alias("held"))
    # Copies of one set, and the sets of one class, may be a large share of all: their rows stay where they are.
    classes = stage(classes, "near-classes")
    of_key = with_facts(named, classes, "label", F.col("held") > HOT_SHARE * n_sets).select("key", "head", "n_links", "copies")
    of_key = stage(of_key, "near-of-key")
    is_first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    out = with_facts(digest.where("n > 0").select("doc_id", "text_hash", "key"), of_key, "key", F.col("copies") > HOT_SHARE * n_sets).select("doc_id", "text_hash", F.col("head.doc_id").alias("class_id"), "n_links", is_first.alias("first"))
    return out.unionByName(digest.where("n = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of ``docs`` (doc_id, text).

    ``n_links`` counts the other rows whose shingle sets have a Jaccard similarity of 0.8 or more; links
    join rows to classes, named by their least doc_id. Rows of equal shingle sets count as one set with
    copies. Null and blank texts have no shingles: such a row has no link and is its own class, as is a row
    without near copies. Repeated doc_ids are separate rows; nulls are the greatest id, so a class of rows
    with null ids alone has a null class_id. An empty table gives an empty result.
    """
    return linked(docs).select("doc_id", "class_id", "n_links")


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of the least doc_id. Rows without shingles all stay.

    All columns stay as they are, whatever their names; of rows alike in id and text, but for those without
    shingles, any one stays.
    """
    found = stage(linked(docs).select("doc_id", "text_hash", "first"), "near-found")
    # The row travels in one struct, so that no column of it can clash with these.
    has_words = F.coalesce(F.regexp_count(F.col("text"), F.lit("\\S")) > 0, F.lit(False))
    mine = docs.select(F.struct("*").alias("kept"), F.col("doc_id").alias("m_id"), F.xxhash64(F.col("text").cast("string")).alias("m_hash"), has_words.alias("has_words"))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
        return rows.join(keys, (F.col("m_hash") == F.col("k_hash")) & F.col("m_id").eqNullSafe(F.col("k_id")), how)

    kept = among(mine, found.where(~F.col("first")), "left_anti")
    # Rows that share id and text with another: of those with shingles one stays.
    twice = stage(found.where("first").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"), "near-twice")
    if twice.take(1):
        again = among(kept, twice, "left_semi")
        once = again.where("has_words").dropDuplicates(["m_id", "m_hash"])
        kept = among(kept, twice, "left_anti").unionByName(again.where("not has_words")).unionByName(once)
    return kept.select("kept.*")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the class of near copies of each, and the number of its links."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') as w from documents),
grams as (
  select distinct doc_id, array_to_string(w[i : i + {SHINGLE_WORDS - 1}], ' ') as g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE_WORDS - 1}, 1))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
near as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where {NEAR[1]} * common >= {NEAR[0]} * (x.n + y.n - common)),
reach(a, b) as (select a, b from near union select reach.a, near.b from reach join near on reach.b = near.a)
select d.doc_id, least(d.doc_id, coalesce(c.low, d.doc_id)) as class_id, coalesce(l.n, 0)::bigint as n_links
from documents d left join (select a, min(b) as low from reach group by a) c on c.a = d.doc_id left join (select a, count(*) as n from near group by a) l on l.a = d.doc_id
"""
