"""Byte-level BPE encoding of a corpus with the rank file of a public tokenizer.

Pre-tokenisation is done on codepoint-class arrays. The pattern of the rank files (contractions, runs of letters, numbers or
other characters with one leading space, runs of white space) is a definite automaton: whatever state it is in, the transition
functions of two neighbouring classes compose to a constant. The associative scan over these functions therefore ends after a
fixed number of steps, and each step is one comparison of the class array with a shifted copy of itself; no regular expression
runs. A boundary depends on at most three codepoints to the left and right, so documents are laid end to end, with a guard
class between them, and scanned together.

The slices between boundaries are made distinct, and each distinct one is merged once per worker (a cache bounded by
CACHE_PIECES; clearing it changes speed only). Null and empty texts give an empty list. Marks of special tokens in a text are
ordinary text. Where offsets are kept, the k-th is the byte of the UTF-8 text at which the k-th id begins; ids and the rank file
give the text back exactly.
"""

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.session import spread

#: Where the rank files of the public tokenizers lie unless a caller says otherwise.
TOKENIZER_DIR = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"

CACHE_PIECES = 500_000
#: Codepoints that are scanned together; a longer text is scanned alone.
SCAN_CHARS = 1_000_000

OTHER, LETTER, NUMBER, SPACE, GUARD = range(5)
#: The codepoints of the property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_classes: np.ndarray | None = None


def codepoint_classes() -> np.ndarray:
    """Class of every codepoint; the place behind the last one is the guard."""
    global _classes
    if _classes is None:
        table = np.full(0x110001, OTHER, dtype=np.uint8)
        major = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        table[:-1][major == ord("L")] = LETTER
        table[:-1][major == ord("N")] = NUMBER
        table[list(WHITE_SPACE)] = SPACE
        table[0x110000] = GUARD
        _classes = table
    return _classes


def _shift(a: np.ndarray, by: int, fill: int) -> np.ndarray:
    out = np.full_like(a, fill)
    if by > 0:
        out[by:] = a[:-by]
    else:
        out[:by] = a[-by:]
    return out


def boundaries(points: np.ndarray) -> np.ndarray:
    """True where a piece begins, for codepoints of documents with guards (0x110000) around each."""
    kind = codepoint_classes()[points]
    before, after = _shift(kind, 1, GUARD), _shift(kind, -1, GUARD)
    prev, nxt = _shift(points, 1, 0x110000), _shift(points, -1, 0x110000)
    begins = kind != before
    # white space: the last one of a run goes to the word behind it, if it is a blank, else it stands alone
    space, word = kind == SPACE, (kind < SPACE)
    begins |= space & (before == SPACE) & (after < SPACE)
    begins &= ~(word & (prev == 0x20))
    # contractions: an apostrophe that begins a piece takes one or two letters along and the rest of the letters begins anew
    quote = (points == 0x27) & begins & (after == LETTER)
    two = _shift(points, -2, 0x110000)
    one = quote & np.isin(nxt, [ord(c) for c in "stmd"])
    pair = quote & (((nxt == ord("r")) | (nxt == ord("v"))) & (two == ord("e")) | (nxt == ord("l")) & (two == ord("l")))
    begins &= ~_shift(one | pair, 1, False)
    begins |= _shift(one, 2, False) & (kind != GUARD)
    begins |= _shift(pair, 3, False) & (kind != GUARD)
    return begins & (kind != GUARD)


class Bpe:
    """Ranks of one tokenizer with a cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.cache: dict[str, np.ndarray] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of least rank is merged until none has a rank; the leftmost goes first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j >= n or part[i] + part[j] != pair:
                continue
            part[i], part[j] = pair, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                longer = pair + part[right[i]]
                if longer in ranks:
                    heapq.heappush(heap, (ranks[longer], i, longer))
            if left[i] >= 0:
                longer = part[left[i]] + pair
                if longer in ranks:
                    heapq.heappush(heap, (ranks[longer], left[i], longer))
        return [ranks[p] for p in part if p is not None]

    def ids_of(self, piece: str) -> np.ndarray:
        ids = self.cache.get(piece)
        if ids is None:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            ids = np.array(self.merge(piece.encode("utf-8")), dtype=np.int32)
            if len(piece) <= 200:
                self.cache[piece] = ids
        return ids

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end to end; number of ids of each text)."""
        joined = "\U0010ffff".join(["", *texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).copy()
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        guards = np.r_[0, np.cumsum(sizes + 1)]
        points[guards] = 0x110000
        starts = np.flatnonzero(boundaries(points))
        ends = np.r_[starts[1:], len(points)] if len(starts) else starts
        following = guards[np.searchsorted(guards, starts, side="right")] if len(starts) else starts
        ends = np.minimum(ends, following)
        place: dict[str, int] = {}
        codes = np.fromiter((place.setdefault(joined[a:b], len(place)) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.int64, count=len(starts))
        distinct = [self.ids_of(p) for p in place]
        lengths = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
        flat = np.concatenate(distinct) if distinct else np.zeros(0, dtype=np.int32)
        first = np.cumsum(lengths) - lengths
        count = lengths[codes]
        total = int(count.sum())
        at = np.arange(total) + np.repeat(first[codes] - (np.cumsum(count) - count), count)
        per_text = np.bincount(np.searchsorted(guards, starts, side="right") - 1, weights=count, minlength=len(texts))[: len(texts)]
        return flat[at], per_text.astype(np.int64)

    def decode(self, ids) -> bytes:
        return b"".join(self.tokens[int(i)] for i in ids)

    def offsets(self, ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Byte of its own text at which each id begins."""
        size = np.fromiter((len(self.tokens[int(i)]) for i in ids), dtype=np.int64, count=len(ids))
        ahead = np.cumsum(size) - size
        first = np.cumsum(per_text) - per_text
        base = np.where(per_text > 0, ahead[np.minimum(first, max(len(ahead) - 1, 0))] if len(ahead) else 0, 0)
        return (ahead - np.repeat(base, per_text)).astype(np.int32)


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > SCAN_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _ranks_path(tokenizer: str) -> str:
    return tokenizer if os.path.sep in tokenizer else os.path.join(TOKENIZER_DIR, tokenizer)


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer: str = BYTE_BPE, offsets: bool = False) -> DataFrame:
    """The columns of keep with ids (array of int) and, if asked for, offsets (array of int). No shuffle; one pass over the texts."""
    path, keep = _ranks_path(tokenizer), keep or ["doc_id"]
    slim = spread(df.select(*keep, df[text].cast("string").alias("__text")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]] + ["ids array<int>"] + ["offsets array<int>"] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("__text"), "").to_pylist()
            for a, b in _slices(texts):
                ids, per_text = model.encode_batch(texts[a:b])
                ends = pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32))
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.ListArray.from_arrays(ends, pa.array(ids, type=pa.int32()))]
                if offsets:
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(model.offsets(ids, per_text), type=pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", *["offsets"] * offsets])

    return slim.mapInArrow(run, ", ".join(fields))


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer: str = BYTE_BPE) -> DataFrame:
    """The columns of keep with tokens (bigint): how many ids each text has."""
    path, keep = _ranks_path(tokenizer), keep or ["doc_id"]
    slim = spread(df.select(*keep, df[text].cast("string").alias("__text")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]] + ["tokens bigint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("__text"), "").to_pylist()
            for a, b in _slices(texts):
                _, per_text = model.encode_batch(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(per_text, type=pa.int64())], names=[*keep, "tokens"])

    return slim.mapInArrow(run, ", ".join(fields))


def decode(df: DataFrame, keep: list[str] | None = None, tokenizer: str = BYTE_BPE) -> DataFrame:
    """The columns of keep with the text of ids; a null list gives null."""
    path, keep = _ranks_path(tokenizer), keep or ["doc_id"]
    slim = df.select(*keep, "ids")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]] + ["text string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(texts, type=pa.string())], names=[*keep, "text"])

    return slim.mapInArrow(run, ", ".join(fields))
