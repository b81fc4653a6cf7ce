"""Token ids as ORC files (operator 2).

ORC stores the ids with integer run-length encoding in stripes; row indexes and a Bloom filter on doc_id
let a lookup skip stripes and row groups by metadata, and large files are read stripe by stripe in parallel.
Files are range partitioned and sorted by doc_id.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, small, table, worker_memory

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Distinct words that a worker remembers, and the longest that it remembers; both bound memory only.
MEMO_SIZE, MEMO_CHARS = 1_000_000, 64
#: Fixed value: the words of the vocabulary's pattern. Runs beyond Latin letters and with marks are left to the library whole.
WORD, WHOLE = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+)", r"[^\x{00}-\x{24F}]|<\|"
SPECIAL = "<|endoftext|>"
#: How a vocabulary must normalise and cut for words to be encoded one by one.
NORMALISES = ["NFC", "Replace", "Lowercase"]
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters at which Python's split() breaks and the vocabulary's pattern does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
FILE_SCHEMA = "part int, before long, doc_id long, n_tokens int, ids array<int>"


def cuts_words(path: str) -> bool:
    """Whether a vocabulary's file lets words be encoded one by one, as ``Encoder`` does. The driver reads it, for all workers."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normalises = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])]
    first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    special = any(t["content"] == SPECIAL for t in made.get("added_tokens", []))
    return normalises == NORMALISES and first.get("type") == "Split" and first["pattern"].get("Regex") == CUTS and first.get("invert") is True and special and made.get("post_processor") is None


class Encoder:
    """``batch(texts)``: ids as little-endian 32-bit integers, equal to the tokenizers library's encodings.

    The vocabulary's pattern never crosses white space, and normalisation acts within its limits, so a text's
    ids are those of its space-free runs in turn, and a run's are those of its words. Each distinct word is
    encoded by the library once and remembered. Texts for which that could differ go to the library whole, as
    do all texts with a vocabulary that normalises or cuts in another way.
    """

    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.by_word = Tokenizer.from_file(path), {}, by_word

    def encode(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def encode_joined(self, strings: list[str], per_text: int = 500) -> list[bytes]:
        """As ``encode`` for strings without "<|", many to a call: the library keeps what stands between special tokens apart."""
        texts = [SPECIAL.join(strings[i : i + per_text]) + SPECIAL for i in range(0, len(strings), per_text)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<i4")
        ends, raw = (4 * np.flatnonzero(ids == self.tokenizer.token_to_id(SPECIAL))).tolist(), ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]

    def lists_of(self, words: pa.StringArray) -> pa.ListArray:
        """The ids of each of some distinct words; new ones are encoded and remembered."""
        if len(self.memo) > MEMO_SIZE:
            self.memo.clear()
        distinct = words.to_pylist()
        known = list(map(self.memo.get, distinct))
        new = [i for i, v in enumerate(known) if v is None]
        plain, marked = ([i for i in new if ("<|" in distinct[i]) == odd] for odd in (False, True))
        found = [*self.encode_joined([distinct[i] for i in plain]), *self.encode([distinct[i] for i in marked])]
        for i, v in zip([*plain, *marked], found):
            known[i] = v
            if len(distinct[i]) <= MEMO_CHARS:
                self.memo[distinct[i]] = v
        ends = np.cumsum(np.fromiter(map(len, known), "int64", len(known)) // 4)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(np.frombuffer(b"".join(known), "<i4")))

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and how many each text has; a null text has none.

        Arrow numbers the distinct runs of the texts, then the distinct words of those, so that Python sees
        each word once.
        """
        if not self.by_word:
            found = [np.frombuffer(v, "<i4") for v in self.encode([t or "" for t in texts])]
            return np.concatenate([*found, np.empty(0, "<i4")]), np.array([len(v) for v in found], "int64")
        lower = [(t or "").lower() for t in texts]
        odd = [bool(t) and (not t.isascii()) and (not is_normalized("NFC", t) or not is_normalized("NFC", s) or "\u03a3" in t) or any(c in s for c in NOT_SPACE) for t, s in zip(texts, lower)]
        cut = pc.utf8_split_whitespace(pa.array(["" if o else s for s, o in zip(lower, odd)], "string"))
        runs = cut.flatten().dictionary_encode()
        mixed = pc.invert(pc.utf8_is_alpha(runs.dictionary))
        some = runs.dictionary.filter(mixed)
        spaced = pc.if_else(pc.match_substring_regex(some, WHOLE), some, pc.replace_substring_regex(some, WORD, "\\1 "))
        parts = pc.utf8_split_whitespace(pc.replace_with_mask(runs.dictionary, mixed, spaced))
        words = parts.flatten().dictionary_encode()
        by_word = self.lists_of(words.dictionary).take(words.indices)
        by_run = pa.ListArray.from_arrays(by_word.offsets.take(parts.offsets), by_word.values)
        taken = by_run.take(runs.indices)
        values, bounds = taken.values.to_numpy(), taken.offsets.to_numpy()[cut.offsets.to_numpy()]
        if any(odd):
            parts, whole = np.split(values, bounds[1:-1]), iter(self.encode([t for t, o in zip(texts, odd) if o]))
            parts = [np.frombuffer(next(whole), "<i4") if o else v for v, o in zip(parts, odd)]
            return np.concatenate(parts), np.array([len(v) for v in parts])
        return values, np.diff(bounds)


@cache
def _encoder(path: str, by_word: bool) -> Encoder:
    return Encoder(path, by_word)


def worker_encoder(path: str, by_word: bool) -> Encoder:
    """One encoder for all tasks of a Python worker, so that its memory carries over."""
    out = _encoder(path, by_word)
    out.memo = worker_memory(f"tokens {path}")
    return out


def encoder(path: str, end_id: int, per_call: int = 800):
    """For mapInArrow over (doc_id, text) in file order: rows of ``FILE_SCHEMA``."""
    by_word = cuts_words(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = worker_encoder(path, by_word), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, per_call):
                b = whole.slice(at, per_call)
                values, counts = encode.batch(b.column(1).to_pylist())
                n = counts + 1
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(np.insert(values, np.cumsum(counts), end_id)))
                ahead = before + ends - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, "int32")), pa.array(ahead.astype("int64")), b.column(0), pa.array(n.astype("int32")), ids], ["part", "before", "doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> str:
    """Encode (doc_id, text) and write ORC files in ascending doc_id order, nulls first; returns ``path``.

    ``part`` numbers the files in that order and ``before`` counts the ids ahead of a row in its file. Rows
    that repeat a doc_id follow each other. An empty table writes a file without rows.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = ordered.mapInArrow(encoder(vocabulary, end_id), FILE_SCHEMA)
    rows.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "10000").option("orc.stripe.size", str(64 << 20)).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; ``doc_ids`` are looked up through the stripes' statistics and Bloom filters."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        values, ends = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B"), ids.offsets.to_numpy().tolist()
        crc = [zlib.crc32(values[4 * i : 4 * j]) for i, j in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype("int64")), pa.array(crc, "int64")], ["part", "before", "doc_id", "n_tokens", "ids_crc32"])


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read from the files: a row for each document."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a file.
    bases = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    each = rows.select("part", "before", "doc_id", "ids").mapInArrow(checksums, "part int, before long, doc_id long, n_tokens long, ids_crc32 long")
    return each.join(small(bases), "part").select("doc_id", (F.col("base") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents as ORC token files, read back and digested. A null text counts as empty: its end id only."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    path = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-files"), vocabulary)
    return digest(read_tokens(spark, path))
