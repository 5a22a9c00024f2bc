"""Secret scan with a worklist of decoded layers.

The text is scanned as it stands (base spans). Then every line in it that holds percent-encoding, or ``\\uXXXX``, ``\\xXX``
or ``&#N;`` escapes, is unwrapped into a layer of its own, so that a key in plain letters stays beside its encoded value,
and so is every base64 run, at each of the four places where its quartets may begin, and as a whole where it is wrapped
over lines. Bytes from base64, percent-encoding or escapes are searched for gzip, zlib, bzip2, xz and zstandard data, of
which all members and frames are decompressed. What is not clean UTF-8 is read as Latin-1 and entered where it holds a
secret or a further layer. Each layer is scanned and searched for further ones, until none is left. A layer whose content
was already seen at the same place is not entered again, so nesting that comes back to itself ends, and repeated lines are
all scanned. Every character of a layer knows the stretch of the original text it came from, and a secret found in a layer
is reported at the original stretch of its characters. Text and escapes are unwrapped character by character; what comes
out of base64 stands for the whole run, and what was compressed for the whole stretch of its bytes.

Null text counts as empty. Spans count code points, the end exclusive. A map over the rows without a shuffle; long texts
cost in proportion, since layers are those lines and runs alone, found in one pass each. Decompression stops at
MAX_UNPACKED bytes a run, which bounds memory against decompression bombs; such a run is scanned as far as that and the
row says so in ``n_cut``. Repeated rows give repeated results, empty tables empty ones; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
MAX_UNPACKED, MIN_BASE64 = 1 << 24, 16
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
_PERCENT, _PERCENT_BYTE = re.compile(r"(?:%[0-9A-Fa-f]{2})+"), re.compile("%([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_BASE64},}}={{0,2}}")
#: A base64 run to the end of a line, and what begins the lines below it.
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_BASE64},}}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={{0,2}}")
_PIECE = re.compile("[A-Za-z0-9+/_-]+")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Of a line's bytes as program text writes them.
_BYTE = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\u\{0{0,4}([0-9A-Fa-f]{1,2})\}|&#[xX]0{0,4}([0-9A-Fa-f]{1,2});|&#0{0,4}([0-9]{1,3});|\\([abtnvfr0\\'"])""")
_LETTER = dict(zip("abtnvfr0\\'\"", (7, 8, 9, 10, 11, 12, 13, 0, 92, 39, 34)))
_TEXT_BREAK = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three kinds, leftmost without overlap for each."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _percent(line: str) -> tuple[str, list[tuple[int, int]]]:
    """The decoded line, and the stretch of it that each character came from. Bytes that are not UTF-8 stand alone."""
    chars, places, at = [], [], 0
    for m in _PERCENT.finditer(line):
        chars.extend(line[at : m.start()])
        places.extend((k, k + 1) for k in range(at, m.start()))
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            n = 3 if 0xDC80 <= ord(c) <= 0xDCFF else 3 * len(c.encode("utf-8"))
            chars.append(c)
            places.append((at, at + n))
            at += n
    chars.extend(line[at:])
    places.extend((k, k + 1) for k in range(at, len(line)))
    return "".join(chars), places


def _escapes(run: str) -> tuple[str, list[tuple[int, int]]]:
    chars, places, at = [], [], 0

    def plain(a: int, b: int) -> None:
        chars.extend(run[a:b])
        places.extend((k, k + 1) for k in range(a, b))

    for m in _ESCAPE.finditer(run):
        plain(at, m.start())
        code = int(m[1] or m[2] or m[3] or m[5], 16) if m[4] is None else int(m[4])
        low = 0xDC00 <= code < 0xE000 and chars and 0xD800 <= ord(chars[-1]) < 0xDC00
        if low:  # the second half of a pair
            chars[-1] = chr(0x10000 + ((ord(chars[-1]) - 0xD800) << 10) + code - 0xDC00)
            places[-1] = (places[-1][0], m.end())
        else:
            chars.append(chr(code) if code < 0x110000 else "\ufffd")
            places.append(m.span())
        at = m.end()
    plain(at, len(run))
    return "".join(chars), places


def _opened(data: bytes, at: int):
    """A decompressor of what begins here, or None."""
    if data.startswith(b"\x1f\x8b\x08", at):
        return zlib.decompressobj(31)
    if data.startswith((b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"), at):
        return zlib.decompressobj()
    if data.startswith(b"BZh", at):
        return bz2.BZ2Decompressor()
    if data.startswith(b"\xfd7zXZ\x00", at):
        return lzma.LZMADecompressor()
    return None


def _frame(data: bytes, at: int, limit: int) -> tuple[bytes, int, bool]:
    """_member of a zstandard frame, whose plain decompressor cannot be told a limit."""
    import zstandard

    data = data[at:]
    try:
        got = zstandard.ZstdDecompressor().stream_reader(data).read(limit)
        if len(got) >= limit:
            return got, at + len(data), False
        whole = zstandard.ZstdDecompressor().decompressobj()
        whole.decompress(data)
    except zstandard.ZstdError:
        return b"", at, False
    return got, at + len(data) - len(whole.unused_data), whole.eof


def _member(data: bytes, at: int, limit: int) -> tuple[bytes, int, bool]:
    """One member or frame: what it holds up to the limit, where it ends, and whether it is complete."""
    if data.startswith(b"\x28\xb5\x2f\xfd", at):
        return _frame(data, at, limit)
    out, room, d = [], limit, _opened(data, at)
    try:
        while d is not None and not d.eof and at < len(data) and room > 0:
            piece = data[at : at + 65_536]
            out.append(d.decompress(piece, room))
            at, room = at + len(piece) - len(d.unused_data), room - len(out[-1])
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return b"".join(out), at, False
    return b"".join(out), at, d is not None and d.eof


def _members(data: bytes, at: int = 0) -> tuple[bytes, int, bool, bool]:
    """All members from a place on, joined; where they end; whether they are complete; whether the limit cut them."""
    out, room = [], MAX_UNPACKED
    while True:
        got, at, whole = _member(data, at, room)
        out.append(got)
        room -= len(got)
        if not whole or room <= 0:
            return b"".join(out), at, whole, room <= 0 and (not whole or _MAGIC.match(data, at) is not None)
        following = at
        while data.startswith(b"\0", following):  # padding between members
            following += 1
        if _MAGIC.match(data, following) is None:
            return b"".join(out), at, True, False
        at = following


def unpack(data: bytes) -> tuple[bytes, bool]:
    """Decompressed as long as it is compressed; whether the limit was reached."""
    cut, seen = False, set()
    while data and (digest := hashlib.sha256(data).digest()) not in seen:
        seen.add(digest)
        more, _, _, short = _members(data)
        if not more:
            break
        cut |= short
        data = more
    return data, cut


def packed_in(data: bytes):
    """(start, end, what it holds, cut) of compressed data anywhere in the bytes."""
    at = 0
    while (m := _MAGIC.search(data, at)) is not None:
        got, end, whole, cut = _members(data, m.start())
        at = end if got and whole else m.start() + 1
        if got:
            inner, more = unpack(got)
            yield m.start(), end, inner, cut or more


def _worth(chars: str) -> bool:
    return bool(find(chars)) or any(p.search(chars) for p in (_PERCENT, _ESCAPE, _BASE64_RUN))


def _readable(data: bytes) -> str | None:
    """The bytes as text: as UTF-8 where that is clean, else as Latin-1 where it holds something to look for."""
    try:
        if (text := data.decode("utf-8")) and not _TEXT_BREAK.search(text):
            return text
    except UnicodeDecodeError:
        pass
    text = data.decode("latin-1")
    return text if data and _worth(text) else None


def _base64(run: str):
    """(text, cut) of what a base64 run may hold, read from each of its first four characters on."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = body[skip:-1] if (len(body) - skip) % 4 == 1 else body[skip:]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        for _, _, inner, cut in packed_in(data):
            if (text := _readable(inner)) is not None or cut:
                yield text or "", cut
        if (text := _readable(data)) is not None:
            yield text, False


def _wrapped(text: str):
    """(start, end, joined run) of base64 wrapped over lines: a block goes on while lines are as long as its second one."""
    for m in _WRAPPED.finditer(text):
        lines = [x.span() for x in _PIECE.finditer(text, m.start(), m.end())]
        for first in (0, 1):  # the first line may be the end of a line with something else before it
            block, width = lines[first : first + 1], None
            for a, b in lines[first + 1 :]:
                if len(block) > 1 and b - a > width:  # the line before was a block's last
                    if len(block) > 1:
                        yield block[0][0], block[-1][1], "".join(text[x:y] for x, y in block)
                    block, width = [(a, b)], None
                    continue
                block.append((a, b))
                if width is not None and b - a < width:
                    yield block[0][0], block[-1][1], "".join(text[x:y] for x, y in block)
                    block, width = [], None
                else:
                    width = b - a
            if len(block) > 1:
                yield block[0][0], block[-1][1], "".join(text[x:y] for x, y in block)


def _bytes_of(line: str, pattern: re.Pattern, value) -> tuple[bytes, list[tuple[int, int]]]:
    """A line's bytes with encoded ones decoded, and the stretch that each came from."""
    out, places, at = bytearray(), [], 0

    def plain(a: int, b: int) -> None:
        for k in range(a, b):
            raw = line[k].encode("utf-8", "surrogatepass")
            out.extend(raw)
            places.extend([(k, k + 1)] * len(raw))

    for m in pattern.finditer(line):
        plain(at, m.start())
        code = value(m)
        if code > 255:
            plain(m.start(), m.end())
        else:
            out.append(code)
            places.append(m.span())
        at = m.end()
    plain(at, len(line))
    return bytes(out), places


def _packed_line(line: str, pattern: re.Pattern, value):
    """Layers of compressed data whose bytes a line holds in percent-encoding or escapes."""
    data, places = _bytes_of(line, pattern, value)
    found = list(packed_in(data))
    if b"+" in data and pattern is _PERCENT_BYTE and _MAGIC.search(data):  # forms write blanks so, and a plus as %2B
        data, places = _bytes_of(line.replace("+", " "), pattern, value)
        found += packed_in(data)
    for a, b, inner, cut in found:
        if (text := _readable(inner)) is not None or cut:
            yield text or "", [(places[a][0], places[b - 1][1])] * len(text or ""), cut


def _lines_with(pattern: re.Pattern, text: str):
    """(start, line) of each line that holds the pattern; no kind of secret goes over a line's end."""
    at = 0
    while (m := pattern.search(text, at)) is not None:
        start, at = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        at = at if at >= 0 else len(text)
        yield start, text[start:at]


def layers(text: str):
    """(decoded text, place in ``text`` of each character, cut) of every line or run in one layer."""
    if "%" in text:
        for start, line in _lines_with(_PERCENT, text):
            chars, places = _percent(line)
            yield chars, [(start + a, start + b) for a, b in places], False
            for chars, places, cut in _packed_line(line, _PERCENT_BYTE, lambda m: int(m[1], 16)):
                yield chars, [(start + a, start + b) for a, b in places], cut
    if "\\" in text or "&#" in text:
        for start, line in _lines_with(_ESCAPE, text):
            chars, places = _escapes(line)
            yield chars, [(start + a, start + b) for a, b in places], False
            for chars, places, cut in _packed_line(line, _BYTE, _byte):
                yield chars, [(start + a, start + b) for a, b in places], cut
    for m in _BASE64_RUN.finditer(text):
        for chars, cut in _base64(m[0]):
            yield chars, [m.span()] * len(chars), cut
    for a, b, run in _wrapped(text):
        for chars, cut in _base64(run):
            yield chars, [(a, b)] * len(chars), cut


def _byte(m: re.Match) -> int:
    return _LETTER[m[6]] if m[6] else int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans, number of layers entered, and of runs cut by the limit."""
    text = text or ""
    base = find(text)
    spans, seen, work, entered, n_cut = set(base), set(), [(text, None)], 0, 0
    while work:
        layer, origin = work.pop()
        for chars, places, cut in layers(layer):
            n_cut += cut
            if origin is not None:
                places = [(origin[a][0], origin[b - 1][1]) for a, b in places]
            mark = hashlib.sha256(f"{places[0][0]}:{places[-1][1]}:".encode() + chars.encode("utf-8", "surrogatepass")).digest() if chars else None
            if mark is None or mark in seen:
                continue
            seen.add(mark)
            entered += 1
            spans.update((places[a][0], kind, places[b - 1][1]) for a, kind, b in find(chars))
            work.append((chars, places))
    return base, sorted(spans), entered, n_cut


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans, their digest, all spans, layers entered and runs cut."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            found = [scan(t) for t in pdf["text"]]
            count = lambda k: [sum(x[1] == k for x in f[0]) for f in found]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
                "base_sha256": [hashlib.sha256(written(f[0]).encode()).hexdigest() for f in found], "spans": [written(f[1]) for f in found],
                "n_layers": [f[2] for f in found], "n_cut": [f[3] for f in found],
            })

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_cut bigint")
