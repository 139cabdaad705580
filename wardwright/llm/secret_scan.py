"""Secret scan: a worklist of decoded layers, each rescanned and mapped back to the text."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import urllib.parse
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import prepare, table

KINDS = ("assign", "access", "hex")
#: Kind, expression, group whose length counts, least length (fixed values).
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # Runs are maximal, so asking for the length at once gives the same matches as dropping short ones.
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE_ESCAPE = re.compile(r"\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What stands between lines of wrapped base64, and a last line that is short.
_GAP = re.compile(r"={0,2}\r?\n[ \t]*")
_TAIL = re.compile(r"\r?\n[ \t]*[A-Za-z0-9+/_-]{1,15}={0,2}(?![A-Za-z0-9+/_=-])")
_HEX_BYTES = re.compile(r"[0-9A-Fa-f]{24,}")
_MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00")
#: No match of PATTERNS, escaped or not, is shorter than this in printable ASCII without a break.
_RUN = re.compile(rb"[\t\x20-\x7e]{12,}")

#: Bytes that the compressed layers of one text may yield. What would go beyond is not unwrapped; it is counted in `oversized`, and
#: `redact` masks it whole. Layers that are not compressed are never larger than what they were unwrapped from, and are not charged.
MAX_DECODED = 64 << 20


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each match, leftmost and not overlapping within a kind."""
    return [(kind, m.start(), m.end()) for kind, expression, group, least in PATTERNS
            for m in expression.finditer(text) if m.end(group) - m.start(group) >= least]


class Layer:
    """A text and where its characters come from: `marks` are the places in it where a stretch begins,
    `origins` the span of the original each stretch covers, `exact` whether the stretch was copied unchanged."""

    def __init__(self, text: str, marks: list[int], origins: list[tuple[int, int]], exact: list[bool]):
        self.text, self.marks, self.origins, self.exact = text, marks, origins, exact

    @classmethod
    def whole(cls, text: str) -> Layer:
        return cls(text, [0], [(0, len(text))], [True])

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original that the characters start..end (end > start) stand for."""
        a, b = bisect_right(self.marks, start) - 1, bisect_right(self.marks, end - 1) - 1
        first, last = self.origins[a], self.origins[b]
        return (first[0] + start - self.marks[a] if self.exact[a] else first[0],
                last[0] + end - self.marks[b] if self.exact[b] else last[1])


def _readable(data: bytes) -> list[str]:
    """The texts that `data` may be: UTF-8, and UTF-16 where it holds zero bytes. What does not decode is replaced, so
    text among other bytes is seen; without a printable run that could hold a match there is none."""
    texts = [data.decode("utf-8", "replace")] if _RUN.search(data) else []
    if b"\0" in data:
        texts += [data[k:].decode("utf-16-le", "replace") for k in (0, 1) if _RUN.search(data[k::2])]
    return texts


def _member(data: bytes, at: int, room: int) -> tuple[bytes | None, int]:
    """What the compressed member at `at` holds, None if that exceeds `room`, and where the member ends. Of a broken
    member the part that could be read. The input is fed in growing steps, as the rest behind a member is copied."""
    out, size, step = [], 0, 1024
    try:
        if data.startswith(b"BZh", at):
            tool = bz2.BZ2Decompressor()
        elif data.startswith(b"\xfd7", at):
            tool = lzma.LZMADecompressor(memlimit=64 << 20)
        else:
            tool = zlib.decompressobj(47)
        while at < len(data) and not tool.eof:
            part = data[at : at + step]
            at, step = at + len(part), min(2 * step, 1 << 20)
            out.append(tool.decompress(part, max_length=room - size + 1))
            size += len(out[-1])
            if size > room:
                return None, len(data)
    except lzma.LZMAError as e:
        return (None if "limit" in str(e) else b"".join(out)), len(data)
    except (zlib.error, OSError, EOFError, ValueError):
        return b"".join(out), len(data)
    return b"".join(out), at - len(tool.unused_data) if tool.eof else len(data)


def _texts(data: bytes, max_decoded: int, used: list[int]) -> Iterator[str | None]:
    """The texts in `data`; None for what would exceed `max_decoded`. Compressed members are found
    wherever they begin, and inflated again and again. Members that follow one another are one content, as their tools have
    it, and each is a content by itself; a run that is compressed without a header is tried as a whole."""
    work, seen = [(data, False)], set()
    while work:
        data, inflated = work.pop()
        mark = hashlib.sha256(data).digest()
        if mark in seen:
            continue
        seen.add(mark)
        groups: list[list[bytes]] = []
        at, end = 0, -1
        while m := _MAGIC.search(data, at):
            at = m.start()
            content, stop = _member(data, at, max(0, max_decoded - used[0]))
            if content is None:
                yield None
                at = stop
                continue
            if not content:
                at += 1
                continue
            used[0] += len(content)
            if end < 0 or data[end:at].strip(b"\0"):  # zeros may stand between members
                groups.append([])
            groups[-1].append(content)
            at = end = max(stop, at + 1)
        if not groups and not inflated and not _RUN.search(data) and (content := _headless(data, max_decoded - used[0])):
            used[0] += len(content)
            groups.append([content])
        for group in groups:
            work += [(content, True) for content in (group if len(group) > 1 else [])]
            work.append((b"".join(group), True))
        for text in _readable(data):
            yield text


def _headless(data: bytes, room: int) -> bytes:
    """What a whole run of raw deflate holds; nothing if it is not one."""
    tool = zlib.decompressobj(-15)
    try:
        out = tool.decompress(data, max_length=max(1, room))
    except zlib.error:
        return b""
    return out if tool.eof and not tool.unused_data else b""


def _unescape(m: re.Match) -> str:
    # Two halves of a pair join; a lone half, and what is no character, is replaced.
    units = [int(a or b, 16) if a or b else int(c) for a, b, c in _ONE_ESCAPE.findall(m.group())]
    return b"".join(u.to_bytes(2, "little") if u < 0x10000 else chr(min(u, 0x10FFFF)).encode("utf-16-le") for u in units).decode("utf-16-le", "replace")


def _unpercent(m: re.Match) -> str:
    return urllib.parse.unquote_to_bytes(m.group()).decode("utf-8", "replace")


def _replaced(layer: Layer, expression: re.Pattern, decode) -> Layer | None:
    """The layer with each run that decodes replaced in place, so that a secret half escaped is seen whole."""
    pieces, marks, origins, exact, at, length = [], [], [], [], 0, 0

    def copy(start: int, end: int) -> None:
        # Keep the stretches that the copied part already has.
        nonlocal length
        while start < end:
            k = bisect_right(layer.marks, start) - 1
            stop = min(end, layer.marks[k + 1] if k + 1 < len(layer.marks) else end)
            pieces.append(layer.text[start:stop])
            marks.append(length)
            origins.append(layer.span(start, stop))
            exact.append(layer.exact[k])
            length += stop - start
            start = stop

    for m in expression.finditer(layer.text):
        text = decode(m)
        if text:
            copy(at, m.start())
            at = m.end()
            pieces.append(text)
            marks.append(length)
            origins.append(layer.span(m.start(), m.end()))
            exact.append(False)
            length += len(text)
    if not at:
        return None
    copy(at, len(layer.text))
    return Layer("".join(pieces), marks, origins, exact)


def _unpacked(run: str, hexadecimal: bool) -> Iterator[bytes]:
    """The bytes a run stands for, for each place in a group where it may begin: what stands before the packed part in the run,
    such as the path of an address, only shifts it."""
    if hexadecimal:
        for k in (0, 1):
            yield bytes.fromhex(run[k : k + (len(run) - k) // 2 * 2])
        return
    run = run.translate(_PLAIN)
    for k in range(4):
        part = run[k:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        yield base64.b64decode(part + "=" * (-len(part) % 4))


#: Both alphabets of base64 as one; padding and white space left out.
_PLAIN = str.maketrans({"-": "+", "_": "/", **dict.fromkeys("= \t\r\n")})


def _wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each block of base64 that goes on over single line ends."""
    if "\n" not in text:
        return
    start, end, lines = 0, -1, 0

    def block() -> Iterator[tuple[int, int]]:
        tail = _TAIL.match(text, end) if lines else None
        if lines + bool(tail) > 1:
            yield start, tail.end() if tail else end

    for m in _BASE64.finditer(text):
        if lines and m.start() - end < 80 and _GAP.fullmatch(text, end, m.start()):
            end, lines = m.end(), lines + 1
        else:
            yield from block()
            start, end, lines = m.start(), m.end(), 1
    yield from block()


def _packed(layer: Layer, max_decoded: int, used: list[int], done: set) -> Iterator[tuple[Layer | None, tuple[int, int]]]:
    """A layer for each text in a run of base64 or hexadecimal bytes, straight or compressed, with the run's span; None for one too large.
    Runs that another layer had unchanged are not unpacked again."""
    runs = chain(((m.span(), False) for m in _BASE64.finditer(layer.text)), ((place, False) for place in _wrapped(layer.text)),
                 ((m.span(), True) for m in _HEX_BYTES.finditer(layer.text)))
    for (start, end), hexadecimal in runs:
        span, run = layer.span(start, end), layer.text[start:end]
        mark = (span, hashlib.sha256(run.encode()).digest(), hexadecimal)
        if mark in done:
            continue
        done.add(mark)
        for data in _unpacked(run, hexadecimal):
            for text in _texts(data, max_decoded, used):
                yield Layer(text, [0], [span], [False]) if text else None, span


def scan(text: str | None, max_decoded: int = MAX_DECODED) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, list[tuple[int, int]]]:
    """Spans in the text itself, spans of all layers, number of layers decoded, spans of runs left as too large.

    Works off a list of layers until none is new. A layer that was seen before, same text from the same
    span, is not taken again, which ends cycles such as an archive that unpacks to itself.
    """
    text = text or ""
    base = find(text)
    spans, seen, done, work, used, oversized = set(base), set(), set(), deque([Layer.whole(text)]), [0], []

    def unwrapped(layer: Layer) -> Iterator[Layer]:
        if "%" in layer.text and (x := _replaced(layer, _PERCENT, _unpercent)):
            yield x
        if ("\\" in layer.text or "&#" in layer.text) and (x := _replaced(layer, _ESCAPE, _unescape)):
            yield x
        for x, span in _packed(layer, max_decoded, used, done):
            if x:
                yield x
            else:
                oversized.append(span)

    while work:
        layer = work.popleft()
        for x in unwrapped(layer):
            mark = (hashlib.sha256(x.text.encode("utf-8", "surrogatepass")).digest(), x.origins[0][0], x.origins[-1][1])
            if mark in seen:
                continue
            seen.add(mark)
            spans.update((kind, *x.span(start, end)) for kind, start, end in find(x.text))
            work.append(x)
    return base, sorted(spans, key=_order), len(seen), oversized


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=_order))


SCAN_TYPE = ("base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, "
             "layers int, oversized int")


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `base` (spans matched in the text itself), `spans` (those and the ones found in decoded layers, mapped
    to the span of the text they were unwrapped from), `layers` and `oversized` to each row.

    Offsets count code points, the end is exclusive. URL and Unicode escapes are replaced in place; base64 and
    hexadecimal runs, in one line or wrapped, compressed or not, become layers of their own that map to the whole run.
    Bytes that do not decode are replaced, so a secret beside them is found. A null text counts
    as empty and has no spans; repeated rows give the same result twice; an empty table gives an empty one; input
    columns named like the results are replaced. Whole texts are scanned, however long.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf(SCAN_TYPE)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for value in batch:
                base, spans, layers, oversized = scan(value)
                rows.append(([{"kind": k, "start": s, "end": e} for k, s, e in sorted(base, key=_order)],
                             [{"kind": k, "start": s, "end": e} for k, s, e in spans], layers, len(oversized)))
            yield pd.DataFrame(rows, columns=["base", "spans", "layers", "oversized"])

    kept = [c for c in docs.columns if c not in ("base", "spans", "layers", "oversized")]
    return docs.select(*kept, scanned(text).alias("_found")).select(*kept, "_found.*")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents with every span that the scan finds replaced by `mask`; overlapping spans become one. Runs that are too
    large to unwrap are masked whole, as nobody knows what they hold.
    `n_chars`, if there, is set anew for a changed text. Columns and their order stay; null texts stay null."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            rows = []
            for value in batch:
                _, spans, _, oversized = scan(value)
                rows.append(None if value is None else _masked(value, spans + [("", *span) for span in oversized], mask))
            yield pd.Series(rows, dtype=object)

    kept = docs.columns
    changed = docs.withColumn("_masked", masked(text))
    if "n_chars" in kept:
        changed = changed.withColumn("n_chars", F.when(F.col("_masked") == F.col(text), F.col("n_chars"))
                                     .otherwise(F.coalesce(F.length("_masked"), F.col("n_chars"))).cast(docs.schema["n_chars"].dataType))
    return changed.withColumn(text, F.col("_masked")).select(*kept)


def _masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _text_of(column: str):
    item = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", item)


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_text_of("base").cast("binary"), 256).alias("base_sha256"),
                        _text_of("spans").alias("spans"), "layers", "oversized")
