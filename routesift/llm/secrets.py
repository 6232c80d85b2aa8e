"""Secret scans with a recursive decoding worklist.

Base matches are found in the text itself. Then segments that look URL-encoded, Unicode-escaped
or base64-encoded (also wrapped over lines, with UTF-16 inside, or with gzip, zlib or bzip2, also within
each other and in several members) are unwrapped, each decoded layer is scanned with the same patterns
and searched for further segments, until nothing new comes up. Nested escapes are unwrapped level by
level and also to their fixpoint in one pass. Bytes that aren't UTF-8 spoil no more than themselves.
A layer that repeats a text at the same place is skipped, which ends cycles. Every character of a
layer carries the span of the original code points it came from, so matches map back.
"""

from __future__ import annotations

import base64
import bz2
import itertools
import re
import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

KINDS = ("assign", "access", "hex")
#: Fixed patterns. A shorter run of the access or hex class can't contain a match, so their lengths are part of the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
MIN_VALUE = 8
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
#: Base64 that is wrapped over lines; nothing is tried twice.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]{2,}+)+={0,2}")
#: Characters of base64 and how many of them the first of several lines has at least.
B64_BYTES, WRAP_FIRST = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 40
#: Escapes within escapes of which every layer is searched; of deeper ones the first so many and the innermost, and they are counted in ``n_oversized``.
LEVELS = 32
DIGITS = {ord(c): int(c, 16) for c in "0123456789abcdefABCDEF"}
ESCAPE = re.compile(r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
SPACE = re.compile(r"\s")
#: Bytes of a compressed layer that are searched at a time, and those that a stretch without white space may have to be searched in one.
#: A longer stretch is searched in overlapping parts: matches are found, encoded segments across two parts may not be, so it is counted in ``n_oversized``.
WINDOW, STRETCH, OVERLAP = 4 << 20, 32 << 20, 4096
#: Bytes unfolded at a time, and compressed layers within each other that are opened; a deeper one is counted in ``n_oversized``.
CHUNK, MAX_DEPTH = 1 << 20, 64
#: Beneath a compressed layer every character has the span of the layer's run, so bytes are searched and kinds are kept.
B_ASSIGN, B_ACCESS, B_HEX, B_BASE64, B_WRAPPED, B_PERCENT, B_ESCAPE = (re.compile(p.pattern.encode(), p.flags & re.IGNORECASE) for p in (ASSIGN, ACCESS, HEX, BASE64, WRAPPED, PERCENT, ESCAPE))
B_SPACE = re.compile(rb"\s")
#: Runs of blanks, and what an assignment may hold before them.
BLANKS = re.compile(rb"\x20+")
OPEN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?$|[:=]$""", re.IGNORECASE)


def matches(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ASSIGN_WORDS.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _segments(text: str, mark: re.Pattern) -> Iterator[tuple[int, int]]:
    """Maximal stretches without white space that hold the mark."""
    end = 0
    for m in mark.finditer(text):
        if m.start() >= end:
            start = m.start()
            while start > end and not text[start - 1].isspace():
                start -= 1
            stop = SPACE.search(text, m.end())
            end = stop.start() if stop else len(text)
            yield start, end


def _characters(raw: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """Text of UTF-8 and each character's first and last byte. Every byte that isn't UTF-8 is a character of its own."""
    try:
        text = raw.decode("utf-8")
        first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    except UnicodeDecodeError:
        points = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4").copy()
        bad = (points >= 0xDC80) & (points <= 0xDCFF)
        sizes = np.where(bad, 1, 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
        first = np.cumsum(sizes) - sizes
        points[bad] = 0xFFFD
        text = points.tobytes().decode("utf-32-le")
    return text, first, np.append(first[1:], len(raw)) - 1


def _value(escape: str | bytes) -> bytes:
    """UTF-8 of an escape; the bytes of half a surrogate pair aren't UTF-8."""
    if escape[:1] in ("%", b"%"):
        return bytes([int(escape[1:], 16)])
    if len(escape) == 12:
        return chr(0x10000 + (int(escape[2:6], 16) - 0xD800 << 10) + int(escape[8:], 16) - 0xDC00).encode()
    return chr(int(escape[2:], 16)).encode("utf-8", "surrogatepass")


def _unescape(text: str, mark: re.Pattern) -> tuple[str, np.ndarray, np.ndarray]:
    """Replace escapes once; positions in ``text`` of each new character (first, end)."""
    raw, lo, hi, at = bytearray(), [], [], 0
    units: list[tuple[bytes, int, int]] = []
    for m in mark.finditer(text):
        units += [(c.encode("utf-8", "surrogatepass"), i, i + 1) for i, c in enumerate(text[at : m.start()], at)]
        units.append((_value(m[0]), m.start(), m.end()))
        at = m.end()
    units += [(c.encode("utf-8", "surrogatepass"), i, i + 1) for i, c in enumerate(text[at:], at)]
    for data, a, b in units:
        raw += data
        lo += [a] * len(data)
        hi += [b] * len(data)
    new, first, last = _characters(bytes(raw))
    return new, np.array(lo, np.int64)[first], np.array(hi, np.int64)[last]


def _unwrap(chars: Sequence[bytes]) -> tuple[bytearray, list[int], list[int]]:
    """Escapes of all kinds replaced to the fixpoint in one pass: the bytes, and for each the first and end index in ``chars``.

    An escape is replaced as soon as its last digit stands, so what it gives can complete the next:
    the time grows with the text, not with the depth of nesting.
    """
    data: list[bytes] = []
    code: list[int] = []  # of ASCII characters, else -1
    lo: list[int] = []
    hi: list[int] = []
    for i, c in enumerate(chars):
        data.append(c)
        code.append(c[0] if len(c) == 1 and c[0] < 128 else -1)
        lo.append(i)
        hi.append(i + 1)
        while code[-1] in DIGITS:
            n = len(code)
            if n >= 3 and code[-3] == 37 and code[-2] in DIGITS:
                size, value = 3, bytes([DIGITS[code[-2]] << 4 | DIGITS[code[-1]]])
            elif n >= 4 and code[-4] == 92 and code[-3] == 120 and code[-2] in DIGITS:
                size, value = 4, chr(DIGITS[code[-2]] << 4 | DIGITS[code[-1]]).encode()
            elif n >= 6 and code[-6] == 92 and code[-5] == 117 and all(d in DIGITS for d in code[-4:-1]):
                point = int(bytes(code[-4:]), 16)
                size, value = 6, chr(point).encode("utf-8", "surrogatepass")
                if 0xDC00 <= point < 0xE000 and n >= 7 and code[-7] == -1 and len(data[-7]) == 3 and b"\xed\xa0" <= data[-7][:2] < b"\xed\xb0":
                    high = ord(data[-7].decode("utf-8", "surrogatepass"))
                    size, value = 7, chr(0x10000 + (high - 0xD800 << 10) + point - 0xDC00).encode()
            else:
                break
            start, end = lo[-size], hi[-1]
            del data[-size:], code[-size:], lo[-size:], hi[-size:]
            data.append(value)
            code.append(value[0] if len(value) == 1 and value[0] < 128 else -1)
            lo.append(start)
            hi.append(end)
    raw = bytearray(b"".join(data))
    sizes = list(map(len, data))
    return raw, [a for a, n in zip(lo, sizes, strict=True) for _ in range(n)], [b for b, n in zip(hi, sizes, strict=True) for _ in range(n)]


def _unwrapped(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """``text`` with all escapes replaced, also those that replaced ones form, and the positions of its characters."""
    raw, lo, hi = _unwrap([c.encode("utf-8", "surrogatepass") for c in text])
    new, first, last = _characters(bytes(raw))
    return new, np.array(lo, np.int64)[first], np.array(hi, np.int64)[last]


def _wide(raw: bytes) -> tuple[str, np.ndarray, np.ndarray] | None:
    """Text of UTF-16 that is mostly Latin, and each character's first and last byte; None for other bytes."""
    half = len(raw) // 2
    for zeros, name in ((raw[1::2], "utf-16-le"), (raw[::2], "utf-16-be")):
        if half >= 8 and zeros.count(0) * 4 >= half * 3:
            text = raw[: half * 2].decode(name, "replace")
            sizes = np.array([2 + 2 * (ord(c) > 0xFFFF) for c in text], np.int64)
            ends = np.cumsum(sizes)
            return text, np.minimum(ends - sizes, half * 2 - 1), np.minimum(ends, half * 2) - 1
    return None


def _tool(raw: bytes):
    """A decompressor for the format that the bytes start with, or None."""
    if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78":
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if raw[:3] == b"BZh" else None


def _compressed(raw: bytes) -> bool:
    """Whether the bytes start a compressed stream, not only with its first letters."""
    try:
        return (tool := _tool(raw)) is not None and (tool.decompress(raw, 1) != b"" or tool.eof)
    except (zlib.error, OSError, ValueError):
        return False


def _inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Unfold all members of a compressed stream, at most CHUNK bytes at a time. Bytes that can't be unfolded are given as they are, on a line of their own."""
    rest = next(chunks, b"")
    while rest:
        while len(rest) < 64 and (more := next(chunks, None)) is not None:
            rest += more
        tool = _tool(rest) if _compressed(rest) else None
        try:
            while tool is not None and not tool.eof:
                out = tool.decompress(rest, CHUNK)
                rest = getattr(tool, "unconsumed_tail", b"")
                if out:
                    yield out
                if not tool.eof and not rest and len(out) < CHUNK and not (rest := next(chunks, b"")):
                    return
        except (zlib.error, OSError, ValueError):
            tool = None
        if tool is None:
            yield b"\n" + rest
            yield from chunks
            return
        rest = tool.unused_data or next(chunks, b"")


def _unbase64(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except ValueError:
        return None


def _safe_end(held: bytearray) -> int:
    """The last place after white space that no match or segment goes over; 0 if there is none."""
    end = max(held.rfind(c) for c in (b"\n", b"\t", b"\r", b"\v", b"\f"))
    at = held.rfind(b" ", end + 1)
    while at > end and OPEN.search(held[max(at - 10, 0) : at]):
        at = held.rfind(b" ", end + 1, at)
    return max(at, end) + 1


def _open_run(held: bytearray, end: int) -> int:
    """Where base64 wrapped over lines begins that may go on after ``end``; ``end`` if there is none."""
    at = len(held[:end].rstrip(b" \t")) if held[end - 1 : end] in (b" ", b"\t") else end
    begin = end
    while at and held[at - 1] == 10:
        stop = at - 1 - (at > 1 and held[at - 2] == 13)
        start = held.rfind(b"\n", 0, stop) + 1
        line = bytes(held[start:stop])
        rest = line.rstrip(B64_BYTES)
        if len(line) - len(rest) >= WRAP_FIRST:
            begin = start + len(rest)
        if len(line) - len(rest) < 2 or rest.strip(b" \t"):
            break
        at = start
    return begin


def _windows(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """A layer in parts that end at white space outside wrapped base64, and whether a part was cut elsewhere."""
    held, limit = bytearray(), WINDOW
    for chunk in chunks:
        # matches allow any number of blanks where they allow one
        held += BLANKS.sub(b" ", chunk.lstrip(b" ") if held.endswith(b" ") else chunk)
        if len(held) >= limit:
            end = _safe_end(held)
            if end and (begin := _open_run(held, end)) < end:
                end = _safe_end(held[:begin])  # the run goes on with the white space before it
            if end:
                yield bytes(held[:end]), False
                del held[:end]
                # a run that is carried over is looked at again when the rest has doubled
                limit = max(WINDOW, min(STRETCH, 2 * len(held)))
            elif len(held) >= STRETCH:
                yield bytes(held), True
                del held[:-OVERLAP]
                limit = WINDOW
            else:
                limit = min(STRETCH, 2 * len(held))
    yield bytes(held), False


def _kinds(chunks: Iterator[bytes], depth: int = 0) -> tuple[set[str], int]:
    """Kinds of matches in a layer, which may be compressed, and in all layers within it; stretches cut or layers not opened."""
    kinds, oversized, opened = set(), 0, set()
    first = next(chunks, b"")
    while _compressed(first) and first not in opened and depth < MAX_DEPTH:
        opened.add(first)
        chunks = _inflate(itertools.chain([first], chunks))
        first, depth = next(chunks, b""), depth + 1
    oversized += depth == MAX_DEPTH
    for window, lost in _windows(itertools.chain([first], chunks)):
        oversized += lost
        work, seen = [(window, LEVELS)], {window}
        while work:
            layer, levels = work.pop()
            if any(len(m[2]) >= MIN_VALUE for m in B_ASSIGN.finditer(layer)):
                kinds.add("assign")
            kinds |= {kind for kind, pattern in (("access", B_ACCESS), ("hex", B_HEX)) if pattern.search(layer)}
            made = []
            escaped = [mark for mark in (B_PERCENT, B_ESCAPE) if mark.search(layer)]
            if escaped and levels > 0:
                # no match goes over the ends of a segment, so its white space becomes a line end
                flat = B_SPACE.sub(b"\n", layer)
                made += [(mark.sub(lambda m: _value(m[0]), flat), levels - 1) for mark in escaped]
                if levels == LEVELS:
                    made.append((bytes(_unwrap([flat[i : i + 1] for i in range(len(flat))])[0]), -1))
            oversized += bool(escaped) and levels == 0
            if (wide := _wide(layer)) is not None:
                made.append((wide[0].encode("utf-8", "replace"), LEVELS))
            for m in itertools.chain(B_BASE64.finditer(layer), B_WRAPPED.finditer(layer)):
                raw = _unbase64(B_SPACE.sub(b"", m[0]).decode()) or (b"\n" in m[0] and _unbase64(B_SPACE.sub(b"", m[0][: m[0].rfind(b"\n")]).decode()))
                if raw and depth < MAX_DEPTH and _compressed(raw):
                    if raw not in seen:
                        seen.add(raw)
                        more, over = _kinds(iter([raw]), depth)
                        kinds, oversized = kinds | more, oversized + over
                elif raw:
                    made.append((raw, LEVELS))
            for new, left in made:
                if new not in seen:
                    seen.add(new)
                    work.append((new, left))
    return kinds, oversized


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], int]:
    """Base spans, all spans (start, kind, end; sorted, distinct) and stretches cut.

    Of a layer with escapes two layers are made: one with every escape replaced once, which may hold
    escapes again and is searched for them up to LEVELS deep, and one with them replaced to the
    fixpoint, which has none.
    """
    base = [(a, k, b) for k, a, b in matches(text)]
    every, oversized = set(base), 0
    work: deque = deque([(text, None, None, LEVELS)])
    seen: set[tuple[int, int, bytes]] = set()
    while work:
        layer, lo, hi, escapes = work.popleft()  # -1: a fixpoint
        span = (lambda a, b: (a, b)) if lo is None else (lambda a, b, lo=lo, hi=hi: (int(lo[a:b].min()), int(hi[a:b].max())))
        if lo is not None:
            for kind, a, b in matches(layer):
                start, end = span(a, b)
                every.add((start, kind, end))
        made = []
        marked = [(a, b, mark) for mark, sign in ((PERCENT, "%"), (ESCAPE, "\\")) if sign in layer for a, b in _segments(layer, mark)]
        if escapes > 0:
            made += [(a, *_unescape(layer[a:b], mark), escapes - 1) for a, b, mark in marked]
            if escapes == LEVELS:
                made += [(a, *_unwrapped(layer[a:b]), -1) for a, b in sorted({(a, b) for a, b, _ in marked})]
        elif escapes == 0:
            oversized += bool(marked)
        for m in itertools.chain(BASE64.finditer(layer), WRAPPED.finditer(layer)):
            place = np.array([i for i, c in enumerate(m[0]) if not c.isspace()]) if "\n" in m[0] else None
            raw = _unbase64(m[0] if place is None else SPACE.sub("", m[0])) or (place is not None and _unbase64(SPACE.sub("", m[0][: m[0].rfind("\n")])))  # the last line may be a word that follows
            if not raw:
                continue
            if _compressed(raw):
                kinds, over = _kinds(iter([raw]))
                oversized += over
                start, end = span(*m.span())
                every |= {(start, kind, end) for kind in kinds}
                continue
            for new, first, last in filter(None, (_characters(raw), _wide(raw))):
                first, end = first // 3 * 4, np.minimum(last // 3 * 4 + 4, len(m[0]) if place is None else len(place))
                made.append((m.start(), new, *((first, end) if place is None else (place[first], place[end - 1] + 1)), LEVELS))
        for a, new, first, end, more in made:
            if not new:
                continue
            first, end = first + a, end + a
            if lo is not None:
                first, end = lo[first], hi[end - 1]
            key = (int(first.min()), int(end.max()), xxhash.xxh3_128_digest(new.encode("utf-8", "surrogatepass")))
            if key not in seen and new != layer:
                seen.add(key)
                work.append((new, first, end, more))
    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda s: (s[0], order[s[1]], s[2])
    return sorted(base, key=rank), sorted(every, key=rank), oversized


SPANS = "array<struct<kind:string,start:int,end:int>>"
FOUND = f"struct<base:{SPANS},spans:{SPANS},n_oversized:int>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in pieces(texts):
        base, spans, over = [], [], []
        for text in column.to_pylist():
            b, s, o = scan(text or "")
            base.append([{"kind": k, "start": x, "end": y} for x, k, y in b])
            spans.append([{"kind": k, "start": x, "end": y} for x, k, y in s])
            over.append(o)
        yield pa.StructArray.from_arrays([pa.array(base, _SPANS), pa.array(spans, _SPANS), pa.array(over, pa.int32())], names=["base", "spans", "n_oversized"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` and a struct ``found``: base matches, all matches (code point spans) and the number of stretches that were cut.

    A null text is empty and holds nothing. A match found by several ways is listed once.
    Rows are independent, so repeated rows repeat their result; an empty table gives none. Texts are
    scanned whole. A column of ``docs`` named found is replaced.
    """
    return docs.drop("found").withColumn("found", F.arrow_udf(_found, FOUND)("text"))


def spans_text(spans: str):
    """kind:start:end, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
