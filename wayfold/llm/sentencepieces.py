"""SentencePiece encoding and decoding by suffix-array matching (operator 3).

The distinct words of a batch are concatenated and indexed by a suffix array; every piece is located by
binary search; its occurrences are edges, sorted by position and relaxed. The vocabulary is a BPE, for which
the best path is the only one whose neighbouring pieces would not merge otherwise: a relaxation keeps, for
each position, the edge that may follow the one kept at its start.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, worker_memory

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: A piece with a space after another character would let merges cross words; the constructor rejects such models.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
MEMO_SIZE, MEMO_CHARS = 400_000, 64
#: Texts encoded at a time.
PER_CALL = 500
#: Pairs of pieces whose fit a worker remembers.
PAIRS = 500_000
#: Characters indexed at once; longer words are cut nowhere, a batch holds at least one word.
INDEX_CHARS = 1 << 18
UNKNOWN = 0xFFFF


class Pieces:
    """The pieces of a BPE model file with byte fallback, in numbers."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.strings = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(self.strings[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.skip = {i for i in range(n) if sp.is_control(i)}
        self.id_of = {self.strings[i]: i for i in plain}
        self.rank = {self.strings[i]: -sp.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of) or len(self.bytes) != 256:
            raise ValueError("not a word-bound BPE model with byte fallback")
        chars = sorted({c for p in self.id_of for c in p})
        #: Numbers of the characters from 1 on; 0 ends a word.
        self.codes = {c: k for k, c in enumerate(chars, 1)}
        self.code_of = np.full(0x110000, UNKNOWN, "uint16")
        self.code_of[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.width = max(map(len, self.id_of))
        ordered = sorted(self.id_of)
        self.ids = np.array([self.id_of[p] for p in ordered])
        self.lengths = np.array([len(p) for p in ordered])
        keys = np.zeros((len(ordered), self.width), ">u2")
        for row, p in enumerate(ordered):
            keys[row, : len(p)] = [self.codes[c] for c in p]
        self.keys = keys
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The BPE of a short string: again and again the best-ranked mergeable pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: (self.rank.get(parts[k] + parts[k + 1], np.inf), k))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two pieces, side by side, stay as they are; distinct pairs are decided once and remembered."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        both = left.astype("int64") * len(self.strings) + right
        kinds, inverse = np.unique(both, return_inverse=True)
        out = np.empty(len(kinds), bool)
        for k, pair in enumerate(kinds.tolist()):
            known = self.pairs.get(pair)
            if known is None:
                a, b = self.strings[pair // len(self.strings)], self.strings[pair % len(self.strings)]
                known = self.pairs[pair] = self.merged(a + b) == [a, b]
            out[k] = known
        return out[inverse]


def suffix_order(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of the ``width`` characters that begin there, cut at the word's end, and those as keys."""
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)].astype(">u2")
    ended = np.logical_or.accumulate(view == 0, axis=1)
    view[ended] = 0
    keys = np.ascontiguousarray(view).view(f"S{2 * width}").ravel()
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def occurrences(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, id) of every occurrence of every piece: a range of the suffix array each, in order of start."""
    order, keys = suffix_order(codes, pieces.width)
    low = np.ascontiguousarray(pieces.keys).view(f"S{2 * pieces.width}").ravel()
    high = pieces.keys.copy()
    high[np.arange(pieces.width)[None, :] >= pieces.lengths[:, None]] = UNKNOWN
    first = np.searchsorted(keys, low, "left")
    after = np.searchsorted(keys, np.ascontiguousarray(high).view(f"S{2 * pieces.width}").ravel(), "right")
    counts = after - first
    which = np.repeat(np.arange(len(counts)), counts)
    at = order[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)]
    by_start = np.lexsort((pieces.lengths[which], at))
    at, which = at[by_start], which[by_start]
    return at, at + pieces.lengths[which], pieces.ids[which]


def segments(n: int, starts: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Where words and their segments start: a segment begins where no piece spans.

    No merge crosses such a place, so what stands before it cannot decide what follows, and segments relax side by side."""
    at, end, _ = edges
    spans = np.bincount(at + 1, minlength=n + 2) - np.bincount(end, minlength=n + 2)
    free = np.cumsum(spans)[:n] == 0
    free[starts] = True
    return np.flatnonzero(free)


def relax(codes: np.ndarray, starts: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each position the last piece of the encoding of its word so far, and where that piece begins; -1 if none.

    ``starts`` are those of words and of their segments. Edges are relaxed in order of their offset in the segment, for all at once. An unknown character is
    an edge of its own with no piece, past which nothing merges.
    """
    n = len(codes)
    last, back = np.full(n + 1, -2, "int64"), np.full(n + 1, -1, "int64")
    at, end, ids = edges
    lone = np.flatnonzero(codes == UNKNOWN)
    at, end, ids = np.concatenate([at, lone]), np.concatenate([end, lone + 1]), np.concatenate([ids, np.full(len(lone), -1)])
    word = np.searchsorted(starts, at, "right") - 1
    offset = at - starts[word]
    order = np.argsort(offset, kind="stable")
    at, end, ids, offset = at[order], end[order], ids[order], offset[order]
    cuts = np.append(np.flatnonzero(np.diff(offset, prepend=-1)), len(offset))
    for lo, hi in zip(cuts, cuts[1:]):
        a, e, t = at[lo:hi], end[lo:hi], ids[lo:hi]
        # Of a word's first position, and after an unknown character, any piece may stand.
        before = np.where(offset[lo] == 0, -1, last[a])
        open_ = before != -2
        a, e, t, before = a[open_], e[open_], t[open_], before[open_]
        free = (before == -1) | (t == -1)
        ok = free.copy()
        ok[~free] = pieces.may_follow(before[~free], t[~free])
        last[e[ok]], back[e[ok]] = t[ok], a[ok]
    return last, back


class Encoder:
    """``batch(texts)``: ids as little-endian 32-bit integers, equal to the model's own encoding of each text."""

    def __init__(self, path: str):
        self.pieces, self.memo = Pieces(path), {}

    def index(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, which are concatenated and matched together."""
        p = self.pieces
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths + 1) - lengths - 1
        codes = p.code_of[np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4")].astype("int64")
        codes[starts + lengths] = 0
        edges = occurrences(codes.astype("uint16"), p)
        last, back = relax(codes, segments(len(codes), starts, edges), edges, p)
        last, back, out = last.tolist(), back.tolist(), []
        for w, s, n in zip(words, starts.tolist(), lengths.tolist()):
            ids, at = [], s + n
            while at > s:
                if last[at] >= 0:
                    ids.append(last[at])
                else:
                    ids.extend(p.bytes[x] for x in reversed(w[at - 1 - s].encode("utf-8", "replace")))
                at = back[at]
            out.append(np.array(ids[::-1], "<i4").tobytes())
        return out

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; new ones are indexed together and remembered."""
        if len(self.memo) > MEMO_SIZE:
            self.memo.clear()
        known = list(map(self.memo.get, words))
        lost = [i for i, v in enumerate(known) if v is None]
        at = 0
        while at < len(lost):
            size, upto = 0, at
            while upto < len(lost) and (upto == at or size < INDEX_CHARS):
                size += len(words[lost[upto]]) + 1
                upto += 1
            for i, v in zip(lost[at:upto], self.index([words[i] for i in lost[at:upto]])):
                known[i] = v
                if len(words[i]) <= MEMO_CHARS:
                    self.memo[words[i]] = v
            at = upto
        return known

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and the bounds of each text's. Null and empty texts have no ids.

        A text gets one space in front; spaces become U+2581. Where single spaces part the words, Arrow cuts
        the texts and numbers their distinct words.
        """
        odd = [bool(t) and (t[0] == " " or "  " in t or SPACE in t) for t in texts]
        cut = pc.split_pattern(pa.array([None if o or not t else t for t, o in zip(texts, odd)], "string"), " ")
        words = cut.flatten().dictionary_encode()
        known = self.ids_of([SPACE + w for w in words.dictionary.to_pylist()])
        ends = np.cumsum(np.fromiter(map(len, known), "int64", len(known)) // 4)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(np.frombuffer(b"".join(known), "<i4")))
        taken = lists.take(words.indices)
        values, bounds = taken.values.to_numpy(), taken.offsets.to_numpy()[cut.offsets.to_numpy()]
        if any(odd):
            runs = [WORD.findall(SPACE + t.replace(" ", SPACE)) for t, o in zip(texts, odd) if o]
            distinct = list({w for ws in runs for w in ws})
            look = dict(zip(distinct, self.ids_of(distinct))).__getitem__
            other = iter([np.frombuffer(b"".join(map(look, ws)), "<i4") for ws in runs])
            parts = [next(other) if o else v for v, o in zip(np.split(values, bounds[1:-1]), odd)]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return values, bounds


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that its memory carries over."""
    out = _encoder(path)
    out.memo = worker_memory(f"pieces {path}")
    return out


class Decoder:
    """``texts(ids, bounds)``: pieces put together, byte pieces decoded, the space in front removed."""

    def __init__(self, pieces: Pieces):
        by_id = {i: b for b, i in pieces.bytes.items()}
        self.raw = pa.array([bytes([by_id[i]]) if i in by_id else b"" if i in pieces.skip else s.replace(SPACE, " ").encode() for i, s in enumerate(pieces.strings)], "large_binary")

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        taken = self.raw.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, "int64")[: len(ids) + 1][bounds].tolist() if len(ids) else [0] * len(bounds)
        data = memoryview(data or b"")
        out = [str(data[a:b], "utf-8", "replace") for a, b in zip(at, at[1:])]
        return [t[1:] if t[:1] == " " else t for t in out]


def encode(docs: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``ids``, the encoding of the whole ``text``; null and empty texts have none."""
    schema = T.StructType([docs.schema[c] for c in keep]).add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, PER_CALL):
                b = whole.slice(at, PER_CALL)
                values, bounds = enc.batch(b.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(pa.array(bounds.astype("int32")), pa.array(values))], [*keep, "ids"])

    return docs.select(F.col("text").cast("string").alias("text"), *[F.col(c) for c in keep]).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` with ``text``, decoded from ``ids``; null ids give a null text."""
    schema = T.StructType([rows.schema[c] for c in keep]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(Pieces(vocabulary))
        for b in batches:
            ids = b.column(0)
            flat = ids.flatten()
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
            texts = pa.array(dec.texts(flat.to_numpy(), bounds), "string")
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pc.if_else(ids.is_valid(), texts, None)], [*keep, "text"])

    return rows.select("ids", *keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), n_chars and text_crc32 of the decoded text, and whether it equals the original.

    A null or empty text has no ids and decodes to the empty text. Repeated rows give repeated rows.
    """
    schema = T.StructType([docs.schema["doc_id"]]).add("n_tokens", "long").add("ids_crc32", "long").add("n_chars", "long").add("text_crc32", "long").add("exact", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(vocabulary)
        dec = Decoder(enc.pieces)
        for whole in batches:
            for at in range(0, whole.num_rows, PER_CALL):
                b = whole.slice(at, PER_CALL)
                texts = b.column(1).to_pylist()
                values, bounds = enc.batch(texts)
                back, raw, at = dec.texts(values, bounds), memoryview(np.ascontiguousarray(values, "<i4")).cast("B"), bounds.tolist()
                columns = [[j - i for i, j in zip(at, at[1:])], [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at, at[1:])], [len(t) for t in back], [zlib.crc32(t.encode("utf-8", "replace")) for t in back]]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, "int64") for c in columns], pa.array([t == (o or "") for t, o in zip(back, texts)])], schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op3_sentencepieces(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents encoded and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary or vocabulary_path())
