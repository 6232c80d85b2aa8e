"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that stands side by side in no token of the vocabulary can never be merged
across, so the place between them is a certain cut. A batch of texts is one run of bytes: the
pre-tokenizer's boundaries and the forced boundaries are found in it with array operations, the
bytes between are the fragments. Equal fragments of a batch are encoded once and remembered for
the life of the Python worker, up to a bound. The ids of a text are its fragments' ids in order.
Decoding gathers the bytes of the ids.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

#: Bytes of texts that are worked on at a time, and most rows. A longer text is cut where its pieces end anyway.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 8192
#: Fragments that a worker remembers before its memory starts anew, and the longest remembered.
MEMORY, MEMORY_BYTES = 400_000, 64
#: Fragments of more bytes are merged with a heap.
SHORT = 48
NEVER = 1 << 30
#: Bytes of a vocabulary file that may be broadcast.
VOCABULARY_BYTES = 64 << 20
#: Fixed by the vocabulary's format: the pre-tokenizer's classes, and the endings that an apostrophe takes with it.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Fixed by the vocabulary's format: settings under which this encoder is exact.
SETTINGS = (
    ("normalizer", None), ("post_processor", None), ("pre_tokenizer.type", "ByteLevel"), ("pre_tokenizer.add_prefix_space", False), ("pre_tokenizer.use_regex", True), ("decoder.type", "ByteLevel"), ("model.type", "BPE"),
    ("model.dropout", None), ("model.unk_token", None), ("model.continuing_subword_prefix", None), ("model.end_of_word_suffix", None), ("model.byte_fallback", False), ("model.ignore_merges", False),
)
CUT = re.compile(rb"[A-Za-z0-9](?=[ \n])")


def byte_letters() -> list[str]:
    """The format's letter for each byte: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def character_classes() -> np.ndarray:
    """Class of every code point."""
    classes = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(name, every):
            a, b = m.span()
            classes[ord(every[a]) : ord(every[b - 1]) + 1] = value  # surrogates stand in no text
    return classes


def check_settings(data: dict) -> None:
    """Refuse a vocabulary with settings that this encoder doesn't know."""
    for path, value in SETTINGS:
        at: object = data
        for key in path.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        if (at or None) != (value or None):
            raise ValueError(f"vocabulary setting {path} is {at!r}, known is {value!r}")
    for token in data.get("added_tokens") or []:
        if token.get("single_word") or token.get("lstrip") or token.get("rstrip"):
            raise ValueError(f"added token {token.get('content')!r} strips or asks for single words")


class Vocabulary:
    """A byte-level BPE vocabulary from the text of a tokenizer's JSON file."""

    def __init__(self, text: str | bytes) -> None:
        data = json.loads(text)
        check_settings(data)
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        ids = data["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.bytes = [b""] * (1 + max([*ids.values(), *specials.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.specials = {token.encode(): i for token, i in specials.items()}
        self.special_pattern = re.compile(b"|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if specials else None
        for token, i in self.specials.items():
            self.bytes[i] = token
        self.single = [ids[c] for c in self.letters]
        #: Rank of a pair of ids, and the id that the merge of a rank makes.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a], ids[b]] = rank
            self.made.append(ids[a + b])
        pairs = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        self.rank_of = np.argsort(pairs)
        self.pairs = np.append(pairs[self.rank_of], np.int64(1) << 62)
        self.rank_of = np.append(self.rank_of, NEVER)
        self.single, self.made_ids = np.array(self.single, np.int64), np.array(self.made, np.int64)
        self.byte_ranks = self.pair_ranks(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)
        self.forced = np.ones((256, 256), bool)
        for i in ids.values():
            raw = np.frombuffer(self.bytes[i], np.uint8)
            self.forced[raw[:-1], raw[1:]] = False
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.classes = character_classes()

    def piece_starts(self, raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Bytes at which a pre-tokenizer's piece or a special token of a text starts.

        ``raw`` holds the UTF-8 of all texts, ``texts`` the byte at which each starts. Pieces are
        runs of a class with one blank before them, white space up to its last character if
        something follows, and an apostrophe with an ending.
        """
        starts = np.zeros(len(raw), bool)
        text = raw.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        opens = np.zeros(len(raw) + 1, bool)
        opens[texts] = True
        special = np.zeros(0, np.int64).reshape(0, 2)
        if self.special_pattern is not None:
            special = np.array([m.span() for m in self.special_pattern.finditer(raw.tobytes())], np.int64).reshape(-1, 2)
            opens[special] = True
        opens = opens[at]
        kind = self.classes[points]
        n = len(points)
        first = opens.copy()
        first[1:] |= kind[1:] != kind[:-1]  # a run of one class starts
        space = kind == SPACE
        follows = np.zeros(n, bool)  # something else than white space follows in the text
        follows[:-1] = ~space[1:] & ~opens[1:]
        begin = first.copy()
        begin |= space & follows  # the last character of white space stands alone or goes to what follows
        begin[1:] &= ~((points[:-1] == 32) & follows[:-1])  # a blank before a run belongs to it
        mark = np.flatnonzero(first & begin & (points == ord("'")))
        mark = mark[mark + 1 < n]
        mark = mark[first[mark + 1] & ~opens[mark + 1] & (kind[mark + 1] == LETTER)]
        for i in mark.tolist():
            for ending in ENDINGS:
                end = i + 1 + len(ending)
                if text[i + 1 : end] == ending and not opens[i + 1 : min(end, n)].any():
                    begin[i + 1] = False
                    if end < n:
                        begin[end] |= ~(first[end] & ~begin[end])  # a run after it keeps its blank
                    break
        starts[at[begin]] = True
        for a, b in special.tolist():
            starts[a + 1 : b] = False
        return starts

    def cuts(self, raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Bytes at which a fragment starts: those of pieces, and the forced boundaries within them."""
        starts = self.piece_starts(raw, texts)
        inside = self.forced[raw[:-1], raw[1:]]
        if self.special_pattern is not None:
            for m in self.special_pattern.finditer(raw.tobytes()):
                inside[m.start() : m.end() - 1] = False
        starts[1:] |= inside
        return np.flatnonzero(starts)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, NEVER without one."""
        keys = a << 32 | b
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.rank_of[at], NEVER)

    def merge(self, fragments: list[bytes]) -> list[bytes]:
        """The bytes of each fragment's int32 ids: merges by rank, leftmost first, one in every fragment at a time."""
        out: list[bytes] = [b""] * len(fragments)
        short = [i for i, f in enumerate(fragments) if len(f) <= SHORT]
        if len(short) < len(fragments):
            for i, f in enumerate(fragments):
                if len(f) > SHORT:
                    out[i] = array("i", self._merge_long(self.single[np.frombuffer(f, np.uint8)].tolist())).tobytes()
        if not short:
            return out
        data = np.frombuffer(b"".join(fragments[i] for i in short), np.uint8)
        sizes = np.array([len(fragments[i]) for i in short], np.int64)
        ids, owner = self.single[data], np.repeat(np.arange(len(short)), sizes)
        ranks = np.full(len(data), NEVER)
        ranks[:-1] = self.byte_ranks[data[:-1], data[1:]]
        ranks[np.cumsum(sizes) - 1] = NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            full = np.repeat(least == NEVER, sizes)
            if full.any():
                done.append((owner[full], ids[full]))
                ids, owner, ranks, least, sizes = ids[~full], owner[~full], ranks[~full], least[least != NEVER], sizes[least != NEVER]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]  # the leftmost of each fragment
            ids[at] = self.made_ids[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ranks[at] = ranks[at + 1]  # NEVER where the fragment ends
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            at = at - np.arange(len(at))
            after = at[at + 1 < len(ids)]
            after = after[owner[after] == owner[after + 1]]
            ranks[after] = self.pair_ranks(ids[after], ids[after + 1])
            before = at[at > 0]
            before = before[owner[before - 1] == owner[before]]
            ranks[before - 1] = self.pair_ranks(ids[before - 1], ids[before])
        owner, ids = np.concatenate([o for o, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(owner, kind="stable")
        raw = ids[order].astype(np.int32).tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(short))) * 4
        for i, a, b in zip(short, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[i] = raw[a:b]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of candidate pairs over a linked list."""
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := get((ids[i], ids[i + 1]), NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (found := get((ids[left], ids[right]), NEVER)) != NEVER:
                    heapq.heappush(heap, (found, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids in order."""
        sizes = self.sizes[ids]
        return gather(self.blob, self.starts[ids], sizes)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with the given starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Coder:
    """Encodes batches of texts and remembers the ids of fragments, as bytes of int32, up to a bound."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[bytes, bytes] = {}

    def runs(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of distinct fragments."""
        v, known = self.vocabulary, self.known
        out = list(map(known.get, fragments))
        missing = [i for i, ids in enumerate(out) if ids is None]
        made = v.merge([fragments[i] for i in missing])
        for i, ids in zip(missing, made, strict=True):
            f = fragments[i]
            out[i] = ids = np.int32(v.specials[f]).tobytes() if f in v.specials else ids
            if len(f) <= MEMORY_BYTES:
                known[f] = ids
        if len(known) > MEMORY:
            known.clear()
        return out

    def encode(self, raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the place in them at which each text's start (and the end of the last)."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = self.vocabulary.cuts(raw, texts)
        offsets = pa.array(np.append(starts, len(raw)).astype(np.int32))
        fragments = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(raw)]).dictionary_encode()
        runs = self.runs(fragments.dictionary.to_pylist())
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        kinds = fragments.indices.to_numpy()
        own = sizes[kinds]
        ids = gather(np.frombuffer(b"".join(runs), np.int32), (np.cumsum(sizes) - sizes)[kinds], own)
        ends = np.concatenate([[0], np.cumsum(own)])
        return ids, ends[np.searchsorted(starts, np.append(texts, len(raw)))]


_CODERS: dict[str, Coder] = {}


def coder_of(key: str, read: Callable[[], bytes]) -> Coder:
    """The worker's coder of a vocabulary; workers are reused, so it serves all their tasks."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(Vocabulary(read()))
    return _CODERS[key]


def text_batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrow batches in slices of about BATCH_BYTES of text, nulls as empty texts."""
    for column in columns:
        column = column.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        at = 0
        while at < len(column):
            to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, "right")) - 1), at + BATCH_ROWS, len(column))
            yield column.slice(at, to - at)
            at = to


def long_parts(raw: np.ndarray, size: int, whole: bool) -> list[tuple[int, int]]:
    """Spans of a long text that end where a piece ends anyway: before white space that follows a letter or number."""
    data, out, at = raw.tobytes(), [], 0
    while not whole and len(data) - at > size and (m := CUT.search(data, at + size)):
        out.append((at, m.end()))
        at = m.end()
    return [*out, (at, len(data))]


def code(coder: Coder, column: pa.Array) -> pa.StructArray:
    """The struct of ids and decoded text of each text of a large_binary column without nulls."""
    v = coder.vocabulary
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    texts = ends - ends[0]
    if len(column) == 1 and len(raw) > BATCH_BYTES:
        parts = long_parts(raw, BATCH_BYTES, any(CUT.search(s) or CUT.search(s + b" ") for s in v.specials))
        ids = np.concatenate([coder.encode(raw[a:b], np.zeros(1, np.int64))[0] for a, b in parts])
        offsets = np.array([0, len(ids)])
    else:
        ids, offsets = coder.encode(raw, texts[:-1])
    sizes = np.concatenate([[0], np.cumsum(v.sizes[ids])])[offsets]
    decoded = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(v.decode(ids))])
    try:
        decoded = decoded.cast(pa.string())
    except pa.ArrowInvalid:  # a vocabulary whose ids don't give UTF-8 back
        decoded = pa.array([x.decode("utf-8", "replace") for x in decoded.to_pylist()], pa.string())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), decoded], names=["ids", "decoded"])


CODED = "struct<ids:array<int>,decoded:string>"


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` and a struct ``coded``: the ids of ``text`` and the text decoded from the ids.

    ``path`` is a vocabulary file that the driver can open; its text is broadcast. Unknown settings
    in it are refused. A null text counts as empty (no ids, decoded to the empty text). Special
    tokens that stand in a text are encoded as such, as the tokenizers library does by default.
    Equal rows give equal results, an empty table none; long texts are encoded whole. A column of
    ``docs`` named coded is replaced.
    """
    size = os.path.getsize(path)
    if size > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {size} bytes, more than may be broadcast")
    with open(path, "rb") as f:
        data = f.read()
    check_settings(json.loads(data))
    key, shared = xxhash.xxh3_128_hexdigest(data), docs.sparkSession.sparkContext.broadcast(data)

    @F.arrow_udf(CODED)
    def coded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = coder_of(key, lambda: shared.value)
        for column in text_batches(texts):
            yield code(coder, column)
        release_memory()

    return docs.drop("coded").withColumn("coded", coded("text"))
