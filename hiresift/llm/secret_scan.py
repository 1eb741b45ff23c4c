"""Secret scan with recursive decoding.

A worklist holds layers, each a text with the place in the document that every one of its
characters came from.  The document is the first layer.  From each layer further ones are
made: URL escapes decoded, Unicode escapes decoded, every base64 run decoded, compressed
data inflated.  A base64 run may be wrapped (single line breaks, indentation) and may be glued to
other characters of its alphabet: it is decoded from each of its first four characters, each line
also by itself, and the readable stretches and compressed data anywhere inside are taken.  Every layer is searched for secrets; a find is reported at the place in the
document.  Layers seen before (same text from the same place) are not taken up again, which
ends cycles such as data that inflates to itself; without new layers the fixpoint is reached.

Defined cases: a null text is an empty one and stays null when secrets are masked.  Rows are
judged one by one, so repeated rows get equal results.  Escapes that are no valid UTF-8 and
stretches of less than twelve characters, too short for any secret, make no layer.  Compressed data is
inflated block by block, all its members, however large; the readable stretches are searched
in pieces cut where nothing that is sought can cross.  Only where ``MAX_RUN`` characters have no
such place, pieces overlap by ``BLOCK`` instead; compressed data that is longer than that and
encoded in such a run is not opened.  A member that is damaged or cut off is not searched.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hiresift.llm.common import add_columns

BLOCK = 1 << 20  # of inflated data
FEED = 1 << 16  # of compressed data
MAX_RUN = 1 << 26
KINDS = ["assign", "access", "hex"]
MASK = "[SECRET]"

# Fixed patterns of the query; group 2 of the first has at least six characters.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

HINTS = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]{1,6})\})")
SHORTEST = 16
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that go on after single line breaks.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
STANDARD = bytes.maketrans(b"-_", b"+/")
#: How compressed data begins.
MAGICS = {
    "zlib": re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]"),
    "bzip2": re.compile(rb"BZh"),
    "xz": re.compile(rb"\xfd7zXZ\x00"),
    "zstd": re.compile(rb"\x28\xb5\x2f\xfd"),
}
HEAD = 6
ANY_MAGIC = re.compile(b"|".join(m.pattern for m in MAGICS.values()))
#: A stretch of readable text that may hold a secret; the shortest is like ``token=abcdef``.
STRETCH = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]{12,}")
#: No find, escape or run, in the text or in what is decoded from it, crosses the end of one of these.
BARRIER = re.compile(r"[^A-Za-z0-9+/_.=:\"'\x20\t\r\n%\\{}-]|\n\n|(?<=[G-Zg-z])\x20(?=[A-Za-z0-9])")


def find_plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets that stand in the text itself."""
    found = []
    if HINTS.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and, per character, the start and end of its source in the document."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, begin: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return begin, end
        return int(self.starts[begin:end].min()), int(self.ends[begin:end].max())

    def source(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            return np.arange(begin, end), np.arange(begin + 1, end + 1)
        return self.starts[begin:end], self.ends[begin:end]

    def key(self) -> tuple:
        place = (0, -1) if self.starts is None or not len(self.starts) else (int(self.starts[0]), int(self.ends[-1]))
        return (hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *place)


class _Reader:
    """One member of compressed data; ``step`` gives some of its content and the input not used yet."""

    def __init__(self, head: bytes):
        self.kind = next(k for k, magic in MAGICS.items() if magic.match(head))
        if self.kind == "zstd":
            import zstandard

            self.reader = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
            self.errors: tuple = (zstandard.ZstdError,)
        else:
            make = {"zlib": lambda: zlib.decompressobj(47), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}
            self.reader = make[self.kind]()
            self.errors = (zlib.error, OSError, EOFError, lzma.LZMAError)

    def step(self, data: bytes) -> tuple[bytes, bytes]:
        if self.kind == "zlib":
            out = self.reader.decompress(data, BLOCK)
            return out, self.reader.unused_data if self.reader.eof else self.reader.unconsumed_tail
        if self.kind == "zstd":  # has no bound for its output, so it gets little input at a time
            given, rest = data[:256], data[256:]
            out = self.reader.decompress(given)
        else:
            given, rest = (data, b"") if self.reader.needs_input else (b"", data)
            out = self.reader.decompress(given, BLOCK)
        return out, self.reader.unused_data + rest if self.reader.eof else rest


class _Members:
    """Content of compressed data that comes in blocks, member after member, in blocks again.

    ``used`` input bytes and ``whole`` content bytes end with the last whole member; ``key`` tells
    that content.  What comes after (damaged, cut off or something else) is no content.
    """

    def __init__(self, blocks: Iterable[bytes]):
        self.blocks, self.used, self.whole, self.key = blocks, 0, 0, None

    def __iter__(self) -> Iterator[bytes]:
        blocks, held, pulled, made = iter(self.blocks), b"", 0, 0
        digest = hashlib.blake2b(digest_size=16)
        while True:
            while len(held) < HEAD and (block := next(blocks, None)) is not None:
                pulled += len(block)
                held += block
                if self.key is not None:
                    held = held.lstrip(b"\0")  # padding between members
            if not any(magic.match(held) for magic in MAGICS.values()):
                return
            member = _Reader(held)
            try:
                while not member.reader.eof:
                    if not held and (block := next(blocks, None)) is not None:
                        pulled += len(block)
                        held = block
                    none_left = not held
                    out, held = member.step(held)
                    if out:
                        digest.update(out)
                        made += len(out)
                        yield out
                    elif none_left and not member.reader.eof:
                        return
            except member.errors:
                return
            self.used, self.whole, self.key = pulled - len(held), made, digest.digest()
            held = held.lstrip(b"\0")


def _first(blocks: Iterable[bytes], size: int) -> Iterator[bytes]:
    for block in blocks:
        yield block[:size]
        size -= len(block)
        if size <= 0:
            return


def _content(data: bytes, begin: int, wholes: list[int]) -> Iterator[bytes]:
    """The data from ``begin``, inflated once for each of ``wholes``, the bytes of content there."""
    blocks: Iterator[bytes] = (data[i : i + FEED] for i in range(begin, len(data), FEED))
    for whole in wholes:
        blocks = _first(_Members(blocks), whole)
    return blocks


def _inflate(data: bytes, begin: int = 0) -> tuple[int, list[int]] | None:
    """Where the compressed data at ``begin`` ends, and the content of every layer of it that opens.

    Nothing is kept: deeper layers are reached by inflating again.  None if the data is not
    compressed, not whole, or comes to itself, at once or over others.
    """
    used, wholes, seen = 0, [], set()
    while True:
        level = _Members(_content(data, begin, wholes))
        for _ in level:
            pass
        if level.key is None:
            return (used, wholes) if wholes else None
        if level.key in seen:
            return None
        seen.add(level.key)
        used = used or begin + level.used
        wholes.append(level.whole)


def _last_barrier(text: str, begin: int) -> int:
    """Where the last barrier from ``begin`` on ends; 0 without any."""
    for at in (max(begin, len(text) - 4096), begin):
        if last := max((m.end() for m in BARRIER.finditer(text, at)), default=0):
            return last
    return 0


def _texts(blocks: Iterable[bytes]) -> Iterator[str]:
    """The readable stretches of data in blocks, in pieces that no find and no run crosses."""
    decode = codecs.getincrementaldecoder("utf-8")("surrogateescape").decode
    tail, looked = "", 0
    for block in itertools.chain(blocks, [None]):
        tail += decode(block or b"", block is None)
        if block is not None and len(tail) - looked < BLOCK:
            continue
        cut = len(tail) if block is None else _last_barrier(tail, max(0, looked - 1))
        looked = len(tail)
        if not cut and looked >= MAX_RUN:
            yield from STRETCH.findall(tail)
            tail = tail[-BLOCK:]
        elif cut:
            yield from STRETCH.findall(tail[:cut])
            tail = tail[cut:]
        else:
            continue
        looked = len(tail)


def _opened(data: bytes, wholes: list[int], at: tuple[int, int]) -> Iterator[Layer]:
    """The layers of compressed data that stands at a place of the document, one after the other."""
    for text in _texts(_content(data, 0, wholes)):
        yield Layer(text, np.broadcast_to(at[0], len(text)), np.broadcast_to(at[1], len(text)))


def _replaced(layer: Layer, pieces: list[tuple[int, int, str, int]]) -> Layer:
    """A layer in which (begin, end, char, _) pieces stand decoded; all else is as it was."""
    text, starts, ends, at = [], [], [], 0
    for begin, end, char, _ in pieces:
        if at < begin:
            s, e = layer.source(at, begin)
            text.append(layer.text[at:begin]), starts.append(s), ends.append(e)
        s, e = layer.source(begin, end)
        text.append(char), starts.append(s[:1]), ends.append(e[-1:])
        at = end
    s, e = layer.source(at, len(layer.text))
    text.append(layer.text[at:]), starts.append(s), ends.append(e)
    return Layer("".join(text), np.concatenate(starts), np.concatenate(ends))


def _url_layers(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    pieces = []
    for m in URL_RUN.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        if (opened := _inflate(data)) is not None:
            end = m.start() + 3 * opened[0]
            yield from _opened(data, opened[1], layer.place(m.start(), end))
        at = m.start()
        for char in data.decode("utf-8", "surrogateescape"):
            if 0xDC80 <= ord(char) <= 0xDCFF:
                at += 3
                continue
            end = at + 3 * len(char.encode())
            pieces.append((at, end, char, 0))
            at = end
    if pieces:
        yield _replaced(layer, pieces)


def _unicode_layers(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text:
        return
    pieces: list[tuple[int, int, str, int]] = []
    for m in ESCAPE.finditer(layer.text):
        code = int(m[m.lastindex], 16)
        if pieces and pieces[-1][1] == m.start() and 0xD800 <= pieces[-1][3] < 0xDC00 <= code < 0xE000:
            begin, _, _, high = pieces.pop()
            code = 0x10000 + ((high - 0xD800) << 10) + code - 0xDC00
            pieces.append((begin, m.end(), chr(code), code))
        elif code < 0x110000:
            pieces.append((m.start(), m.end(), chr(code), code))
    pieces = [p for p in pieces if not 0xD800 <= p[3] < 0xE000]
    if pieces:
        yield _replaced(layer, pieces)


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    """What each run decodes to, whichever of its first four characters the base64 begins with."""
    for m in itertools.chain(BASE64_RUN.finditer(layer.text), BASE64_LINES.finditer(layer.text)):
        chars = np.frombuffer(m[0].encode(), np.uint8)
        within = np.flatnonzero(chars > 32)  # without breaks and indentation
        if len(within) < SHORTEST:
            continue
        if layer.starts is None:
            starts = within + m.start()
            ends = starts + 1
        else:
            starts, ends = layer.starts[within + m.start()], layer.ends[within + m.start()]
        body = chars[within].tobytes().rstrip(b"=").translate(STANDARD)
        for skip in range(4):
            part = body[skip:]
            if len(part) % 4 == 1:
                part = part[:-1]
            data = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
            yield from _data_layers(data, starts[skip:], ends[skip:])


def _data_layers(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[Layer]:
    """Compressed data that begins anywhere in decoded base64, and the readable stretches."""
    last_end, left, at = len(ends) - 1, bytearray(data), 0
    while (magic := ANY_MAGIC.search(data, at)) is not None:
        at = magic.start() + 1
        if (opened := _inflate(data, magic.start())) is not None:
            begin, at = magic.start(), opened[0]
            until = last_end if at == len(data) else (at - 1) // 3 * 4 + 3
            place = int(starts[begin // 3 * 4 : until + 1].min()), int(ends[begin // 3 * 4 : until + 1].max())
            yield from _opened(data[begin:at], opened[1], place)
            left[begin:at] = bytes(at - begin)  # what is opened isn't read as text too
    text, char, byte = left.decode("utf-8", "surrogateescape"), 0, 0
    for m in STRETCH.finditer(text):
        byte += len(text[char : m.start()].encode("utf-8", "surrogateescape"))
        sizes = np.array([len(c.encode()) for c in m[0]])
        last = byte + np.cumsum(sizes)
        first = last - sizes
        yield Layer(m[0], starts[first // 3 * 4], ends[np.minimum((last - 1) // 3 * 4 + 3, last_end)])
        char, byte = m.end(), int(last[-1])


def _inner_layers(layer: Layer) -> Iterator[Layer]:
    for make in (_url_layers, _unicode_layers, _base64_layers):
        yield from make(layer)


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain finds, and all finds with those inside decoded layers, both sorted."""
    text = text or ""
    plain = find_plain(text)
    found, seen, work = set(plain), set(), [_inner_layers(Layer(text))]
    while work:  # the layers of the last one first, so that an inflated stream is never held whole
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
            continue
        key = inner.key()
        if key in seen:
            continue
        seen.add(key)
        work.append(_inner_layers(inner))
        for start, kind, end in find_plain(inner.text):
            begin, stop = inner.place(start, end)
            found.add((begin, kind, stop))
    return plain, sorted(found)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every found stretch replaced; stretches that overlap become one mask."""
    if not spans or text is None:
        return text
    out, at, until = [], 0, -1
    for start, _, end in spans:
        if start >= until:
            if until >= 0:
                out.append(MASK)
                at = until
            out.append(text[at:start])
        until = max(until, end)
    return "".join([*out, MASK, text[until:]])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with plain_spans, spans (kind, start, end in code points) and masked_text; no shuffle."""

    def compute(batch: pa.RecordBatch) -> list:
        plain, every, texts = [], [], []
        for text in batch.column("text").to_pylist():
            base, found = find_secrets(text)
            plain.append([(KINDS[k], s, e) for s, k, e in base])
            every.append([(KINDS[k], s, e) for s, k, e in found])
            texts.append(masked(text, found))
        return [plain, every, texts]

    span = "array<struct<kind:string,start:int,end:int>>"
    return add_columns(docs, compute, f"plain_spans {span}, spans {span}, masked_text string")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def count(kind: str):
        return F.size(F.filter("plain_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(column: str):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return scan_secrets(docs).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined("plain_spans"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
