"""Secret scans with a recursive decoding worklist.

Every layer of a text is scanned for secrets, and for regions that decode: URL escapes, Unicode and character-reference
escapes, base64 of either alphabet, and compressed bytes (gzip, zlib) inside base64. Base64 is tried from each of the four
places where a quad may start, for what stands before it may look like base64, and over line ends; bytes that are not UTF-8
do not hide the rest. What a region decodes to is a layer of its own and joins
the worklist, until no layer decodes further. A decoded text is entered once, which ends cycles, and what it holds counts
for every region that yields it. A secret found in a layer is mapped to the text: character by character through escapes,
and to the whole encoded region through base64 and compression.

Defined cases: a null text is empty and has no spans; overlapping kinds all count; rows may repeat; an empty table gives an
empty result; extra columns are ignored by ``scan_secrets`` and kept by ``redact_secrets``. A compressed layer is inflated
in parts of ``MOST_INFLATED`` bytes, all its members; one that claims more is read on and reported as a span of kind
``bomb``. Inflating ends only where layers inside layers claim more than one compression of the whole text could.
"""

from __future__ import annotations

import base64
import codecs
import html
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, give_back

#: The base patterns; ASCII case only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Further kinds.
MORE = {
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    "forge": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
KINDS = ("assign", "access", "hex", *MORE, "bomb")
LEAST_VALUE = 6
#: What a layer of a kind must contain, so that others are not searched.
MARKS = {"pem": "-----BEGIN", "forge": "gh", "chat": "xox", "jwt": "eyJ"}

ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|lt|gt|apos|equals|colon);")
#: Runs of both base64 alphabets; breaks inside wrapped runs.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAP = re.compile(r"(?<=[A-Za-z0-9+/_-])[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST_RUN = 16
#: Where compressed bytes may begin.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
MOST_INFLATED = 64 << 20
#: How many times its size a compressed stream can claim.
MOST_RATIO = 1032
#: What a decoded text must have for a secret, an escape or a further run to be in it.
SOMETHING = re.compile(r"[A-Za-z0-9+/_-]{16}|(?:password|passwd|secret|token|api_?key)[\"' :=]|[%\\&\n]|xox|eyJ|-----BEGIN", re.I | re.A)
PLAIN = str.maketrans("-_", "+/")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds, leftmost non-overlapping within each kind."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _scan(text: str) -> list[Span]:
    found = base_spans(text)
    for kind, mark in MARKS.items():
        if mark in text:
            found += [(m.start(), m.end(), kind) for m in MORE[kind].finditer(text)]
    return found


def _decode_escape(run: str) -> Iterator[tuple[str, int]]:
    """What a run of escapes stands for, character by character, and how many characters of the run each takes.

    Bytes and halves of pairs that stand for no character become U+FFFD, so that they do not hide their neighbours.
    """
    if run[0] == "&":
        yield html.unescape(run), len(run)
    elif run.startswith("\\u{"):
        code = int(run[3:-1], 16)
        yield chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\ufffd", len(run)
    elif run[0] == "%" or run.startswith("\\u"):
        mark, encoding, width = ("%", "utf-8", 3) if run[0] == "%" else ("\\u", "utf-16-be", 6)
        decoder = codecs.getincrementaldecoder(encoding)("replace")
        done = 0
        for at in range(width, len(run) + 1, width):
            got = decoder.decode(bytes.fromhex(run[at - width + len(mark) : at]), at == len(run))
            if got:
                yield got, at - done
                done = at
    else:
        yield chr(int(run[2:], 16)), len(run)


def _unescape(text: str) -> tuple[str, list[tuple[int, int, int, int]]] | None:
    """The text with its escapes decoded, and pieces (start, end, start in ``text``, end in ``text``)."""
    out, pieces, at, size = [], [], 0, 0

    def add(part: str, low: int, high: int) -> None:
        nonlocal size
        if part:
            out.append(part)
            pieces.append((size, size + len(part), low, high))
            size += len(part)

    for m in ESCAPES.finditer(text):
        add(text[at : m.start()], at, m.start())
        at = m.start()
        for got, taken in _decode_escape(m[0]):
            add(got, at, at + taken)
            at += taken
    if not at:
        return None
    add(text[at:], at, len(text))
    return "".join(out), pieces


def _is_packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or len(raw) > 1 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0


class _Inflated:
    """The bytes of compressed ``pieces``, all members, in pieces of at most ``MOST_INFLATED``; what comes before an error
    counts. ``budget`` holds how many bytes may still come."""

    def __init__(self, pieces: Iterator[bytes], budget: list[int]):
        self.pieces, self.budget, self.size, self.ended = pieces, budget, 0, False

    def __iter__(self) -> Iterator[bytes]:
        machine = None
        for piece in self.pieces:
            while piece:
                machine = machine or zlib.decompressobj(wbits=zlib.MAX_WBITS | 32)
                out = b"-"
                while out and not machine.eof:
                    try:
                        out = machine.decompress(piece, MOST_INFLATED)
                    except zlib.error:
                        return
                    piece = machine.unconsumed_tail
                    if out:
                        self.size += len(out)
                        self.budget[0] -= len(out)
                        yield out
                        if self.budget[0] < 0:
                            return
                if machine.eof:
                    piece, machine = machine.unused_data.lstrip(b"\0"), None
                    if not _is_packed(piece):
                        piece = b""
        self.ended = machine is None


def _unpacked(raw: bytes, budget: list[int]) -> Iterator[tuple[str, bool, bool]]:
    """The text of compressed bytes, compressed once or more, in overlapping parts, as ``_decodings`` gives it."""
    stages: list[_Inflated] = []
    head, rest, seen = raw, iter(()), set()
    while _is_packed(head) and (key := _key(head)) not in seen:
        seen.add(key)
        stage = _Inflated(chain([head], rest), budget)
        pieces = iter(stage)
        got = next(pieces, None)
        if got is None:
            break
        stages.append(stage)
        head, rest = got, pieces
    if not stages:
        return
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    text = ""
    for piece in chain([head], rest):
        if text:
            at = max(len(text) - MOST_INFLATED // 4, 0)
            text = text[max(len(text[:at].rstrip(ALPHABET)), len(text) - MOST_INFLATED, 0) :]
        text += decoder.decode(piece)
        yield text, _is_bomb(stages, budget), False
    yield decoder.decode(b"", True), _is_bomb(stages, budget), not all(stage.ended for stage in stages)


def _is_bomb(stages: list[_Inflated], budget: list[int]) -> bool:
    return budget[0] < 0 or any(stage.size > MOST_INFLATED for stage in stages)


def _budget(text: str) -> list[int]:
    """Bytes that a text may inflate to: all that one compression can claim, so that only bombs inside bombs are cut."""
    return [MOST_INFLATED + MOST_RATIO * len(text)]


def _decodings(run: str, budget: list[int]) -> Iterator[tuple[str, bool, bool]]:
    """Texts inside a base64 run, at each of the four places a quad can start, and of compressed bytes anywhere in them;
    whether they claim too much; and whether a compressed stream lacks its end."""
    bare = run.rstrip("=").translate(PLAIN)
    for skip in range(4):
        part = bare[skip:]
        if len(part) % 4 == 1:
            part = part[:-1]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        for start in sorted({m.start() for m in PACKED.finditer(raw)} | {0}):
            yield from _unpacked(raw[start:], budget)
        yield raw.decode("utf-8", "replace"), False, False


def _is_word(run: str) -> bool:
    """Words of natural text have no digit or no change of case inside."""
    return run.isalpha() and run[1:].islower()


def _is_idle(run: str) -> bool:
    """Whether nothing that a run decodes to may hold anything, so that the run need not be looked at again."""
    return not any(_may_hold(text) for text, _, _ in _decodings(run, _budget(run)))


def _wrapped(layer: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of base64 characters that go on over line ends: the places of their lines' parts."""
    block: list[tuple[int, int]] = []
    at = 0
    for m in WRAP.finditer(layer):
        if not block or block[-1][1] != m.start():
            if block:
                yield block
            line = layer[max(at, layer.rfind("\n", 0, m.start()) + 1) : m.start()]
            block = [(m.start() - len(line) + len(line.rstrip(ALPHABET)), m.start())]
        block.append(m.span(1))
        at = m.end()
    if block:
        yield block


def _visit(layer: str, found: set[Span], regions: list[tuple[int, int, bytes]], budget: list[int]) -> Iterator[tuple[bytes, str]]:
    """Scan a layer and the layers its escapes give, all in places of ``layer``.

    Fills the secrets ``found`` and the encoded ``regions`` (start, end, key of what it decodes to); yields each region's
    key and decoded text, one at a time.
    """
    to_layer = None
    while True:
        found |= _mapped(_scan(layer), to_layer)
        for start, end, run in _runs(layer):
            for text, cut, _ in _decodings(run, budget):
                low, high = _place(start, end, to_layer)
                if cut:
                    found.add((low, high, "bomb"))
                if _may_hold(text):
                    regions.append((low, high, _key(text)))
                    yield regions[-1][2], text
        got = _unescape(layer) if "%" in layer or "\\" in layer or "&" in layer else None
        if not got:  # every escape is longer than what it stands for, so this comes
            return
        layer, to_layer = got[0], _through(got[1], to_layer)


def _may_hold(text: str) -> bool:
    """Whether there may be anything to find or to decode in a text; in most misaligned ones there is not."""
    return bool(SOMETHING.search(text))


def _hits(run: str) -> set:
    """What a run's decodings show at once: secrets, further runs, and streams without an end."""
    out = set()
    for text, cut, broken in _decodings(run, _budget(run)):
        out |= {(kind, text[a:b]) for a, b, kind in _scan(text)} | {("run", m[0]) for m in BASE64.finditer(text)}
        out |= {("escape", m[0]) for m in ESCAPES.finditer(text)}
        if cut:
            out.add(("bomb", ""))
        if broken:
            out.add(("broken", ""))
    return out


def _runs(layer: str) -> list[tuple[int, int, str]]:
    """(start, end, base64 characters) of the regions to decode: single runs, and runs wrapped at line ends where their
    lines by themselves show less. A wrapped run takes the place of its lines."""
    single = [(m.start(), m.end(), m[0]) for m in BASE64.finditer(layer)]
    if "\n" not in layer:
        return single
    taken: list[tuple[int, int]] = []
    for block in _wrapped(layer):
        parts = [layer[a:b] for a, b in block]
        if sum(map(len, parts)) < LEAST_RUN or all(map(_is_word, parts)) and _is_idle("".join(parts)):
            continue
        apart = set().union(*(_hits(part) for part in parts if len(part) >= LEAST_RUN))
        joined = _hits("".join(parts))
        if {h for h in joined if h[0] != "broken"} <= apart and ("broken", "") not in apart - joined:
            continue
        # A word before or after belongs to the run only if something is lost without it.
        while len(parts) > 1 and _is_word(parts[0]) and joined <= _hits("".join(parts[1:])):
            del parts[0], block[0]
        while len(parts) > 1 and _is_word(parts[-1]) and joined <= _hits("".join(parts[:-1])):
            del parts[-1], block[-1]
        single.append((block[0][0], block[-1][1], "".join(parts)))
        if apart - {("broken", "")} <= joined:
            taken.append((block[0][0], block[-1][1]))
    if taken:
        starts = [a for a, _ in taken]
        inside = lambda a, b: (i := bisect_right(starts, a)) and b <= taken[i - 1][1] and (a, b) != taken[i - 1]
        single = [r for r in single if not inside(r[0], r[1])]
    return sorted(single)


def _key(layer: str | bytes) -> bytes:
    return blake2b(layer.encode("utf-8", "surrogatepass") if isinstance(layer, str) else layer, digest_size=16).digest()


def find_secrets(text: str | None) -> list[Span]:
    """All spans (start, end, kind) in ``text``, of every layer, sorted and without repeats."""
    text = text or ""
    found, regions = set(), []
    layers = {_key(text): (found, regions)}  # each decoded text is entered once, however many regions yield it
    budget = _budget(text)
    work = [_visit(text, found, regions, budget)]
    while work:
        for key, decoded in work[-1]:
            if key not in layers:
                layers[key] = set(), []
                work.append(_visit(decoded, *layers[key], budget))
                break
        else:
            work.pop()
    if regions:
        kinds = _kinds_within(layers)
        found |= {(low, high, kind) for low, high, key in regions for kind in kinds[key]}
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _kinds_within(layers: dict) -> dict[bytes, set[str]]:
    """The kinds that each layer holds, its own and those of all it leads to; layers may lead to each other."""
    kinds = {key: {kind for _, _, kind in found} for key, (found, _) in layers.items()}
    above: dict[bytes, set[bytes]] = {key: set() for key in layers}
    for key, (_, regions) in layers.items():
        for _, _, inner in regions:
            above[inner].add(key)
    work = [key for key in layers if kinds[key]]
    while work:
        key = work.pop()
        for outer in above[key]:
            if not kinds[key] <= kinds[outer]:
                kinds[outer] |= kinds[key]
                work.append(outer)
    return kinds


def _place(start: int, end: int, to_text: list | None) -> tuple[int, int]:
    """The part of the text that a part of a layer comes from; partly covered encoded pieces count whole."""
    if to_text is None:
        return start, end
    low = high = None
    for i in range(bisect_right(to_text, start, key=lambda piece: piece[1]), len(to_text)):
        a, b, x, y, whole = to_text[i]
        if a >= end:
            break
        low = (x if whole or start <= a else x + (start - a)) if low is None else low
        high = y if whole or end >= b else x + (end - a)
    return (low, high) if low is not None else (start, end)


def _through(pieces: list, to_text: list | None) -> list:
    """``pieces`` of a layer over its parent, carried on to the text: (start, end, start, end, whole).

    A piece that the layer took over as it was is cut where the parent's pieces are, so that what was plain stays exact.
    """
    out = []
    for a, b, x, y in pieces:
        if b - a != y - x:
            out.append((a, b, *_place(x, y, to_text), True))
        elif to_text is None:
            out.append((a, b, x, y, False))
        else:
            for i in range(bisect_right(to_text, x, key=lambda piece: piece[1]), len(to_text)):
                c, d, low, high, whole = to_text[i]
                if c >= y:
                    break
                start, end = max(x, c), min(y, d)
                out.append((a + start - x, a + end - x, *((low, high) if whole else (low + start - c, low + end - c)), whole))
    return out


def _mapped(spans: list[Span], to_text: list | None) -> set[Span]:
    return {(*_place(a, b, to_text), kind) for a, b, kind in spans}


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_assign, n_access, n_hex, base (the base spans joined) and spans (all of them)."""
    own = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
                kinds = [s[2] for s in base]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), _joined(base), _joined(find_secrets(text))))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], [id_col, "n_assign", "n_access", "n_hex", "base", "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {own.simpleString()}, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(text: str, mask: str = "[SECRET]") -> str:
    """``text`` with each secret, of whatever layer, replaced by ``mask``; touching secrets become one mask."""
    out, at = [], 0
    for low, high, _ in find_secrets(text):
        if high <= at:
            continue
        if low > at or not out:
            out += [text[at:low], mask]
        at = high
    return "".join(out) + text[at:] if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` masked and ``chars_col``, where there is one, kept true."""

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, at):
            texts = batch.column(at).to_pylist()
            new = [t and redact(t) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            n = batch.schema.get_field_index(chars_col)
            if n >= 0:
                counts = [old if a is b or a == b else len(b) for old, a, b in zip(columns[n].to_pylist(), texts, new)]
                columns[n] = pa.array(counts, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        give_back()

    return docs.mapInArrow(run, docs.schema)
