"""Token ids of whole texts through the tokenizers library.

The word tokenizer lower-cases, drops white space and never joins pieces across runs
of letters, digits and signs, so the ids of a text are those of its runs in order.
Texts are cut into runs and the runs made distinct a chunk at a time, on arrays of
bytes; each distinct run is given to the library's model as long as a bounded cache
doesn't hold it.  The cache keeps two generations, so that frequent runs stay.

This holds for texts of ASCII and the Latin-1 letters and for files whose normalizer and
pre-tokenizer are ``RULES``.  In other texts, words with anything else, or with the marks of
special tokens, go to the library whole; with other files every text does.  ``tests/llm``
holds all three against the library on whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES, CACHE_RUNS, LONGEST_CACHED = 4_000_000, 200_000, 64
_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")
_LETTERS = "a-zà-öø-ÿ"
_PLAIN = re.compile(f"[!-~{_LETTERS}À-ÖØ-Þ]+")
_RUN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
#: The rules of the files that are taken apart here.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each byte; of the rest only C3 and what follows it make letters."""
    kind, lower = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    kind[33:127] = SIGN
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    kind[48:58] = DIGIT
    for a, b in ((65, 91), (97, 123), (0x80, 0xC0)):
        kind[a:b] = LETTER
    kind[0xC3] = LETTER
    lower[65:91] += 32
    lower[0x80:0x9F] += 32
    return kind, lower


KIND, LOWER = byte_tables()


class Aged:
    """A bounded cache: the younger half is kept when it is full."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        x = self.new.get(key)
        if x is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key, x) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = x


def run_starts(data: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of lower-cased plain bytes starts and stops; texts begin at ``begins``."""
    n = len(data)
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[:n] |= kind == DIGIT
    start[begins[begins < n]] = True
    at = np.flatnonzero((data == 39) & start[:n])  # an apostrophe that no sign precedes may begin a contraction
    if len(at):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = padded[at + 1], padded[at + 2]
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, 0)
        size = np.where((two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108), 3, size)
        size[np.searchsorted(begins, at, "right") != np.searchsorted(begins, at + np.maximum(size, 1) - 1, "right")] = 0
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = start[at + size - 1] = False
        start[at + size] = True
    edges = np.flatnonzero(start)
    first, stop = edges[:-1], edges[1:]
    use = kind[first] != SPACE
    return first[use], stop[use]


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.known = all(rules.get(k) == v for k, v in RULES.items())
        self.runs, self.letters = Aged(CACHE_RUNS), byte_letters()

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        if not self.known:
            return self.library(text)
        return b"".join(self.word(w) for w in text.translate(_SPACES).split(" ") if w)

    def word(self, w: str) -> bytes:
        if _PLAIN.fullmatch(w) and "<|" not in w:
            return b"".join(self.run(r.encode()) for r in _RUN.findall(w.lower()))
        return self.library(w)

    def run(self, r: bytes) -> bytes:
        x = self.runs.get(r)
        if x is None:
            found = self.tokenizer.model.tokenize(r.decode() if r.isascii() else r.decode("latin-1").translate(self.letters))
            x = b"".join([t.id.to_bytes(4, "little") for t in found])
            if len(r) <= LONGEST_CACHED:
                self.runs.put(r, x)
        return x

    def documents(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an Arrow array (null: empty), in order, a chunk at a time."""
        if not self.known:
            yield from (self.library(t or "") for t in texts.to_pylist())
            return
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = offsets_of(texts)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            if offsets[at + 1] - offsets[at] > CHUNK_BYTES:
                yield b"".join(x for part in parted(texts[at].as_py()) for x in self.chunk(pa.array([part], pa.large_binary())))
            else:
                yield from self.chunk(texts.slice(at, stop - at))
            at = stop

    def chunk(self, texts: pa.Array) -> list[bytes]:
        """Of texts of bounded size; those that aren't plain go word by word."""
        odd = strange(texts)
        if odd.any():
            plain = iter(self.plain(texts.filter(pa.array(~odd))))
            return [self.encode(t.decode("utf-8", "surrogatepass")) if x else next(plain) for t, x in ((t.as_py() if x else b"", x) for t, x in zip(texts, odd.tolist(), strict=True))]
        return self.plain(texts)

    def plain(self, texts: pa.Array) -> list[bytes]:
        offsets = offsets_of(texts)
        raw, begins = bytes_of(texts), offsets[:-1] - offsets[0]
        if not len(raw):
            return [b""] * len(texts)
        data, kind = LOWER[raw], KIND[raw]
        first, stop = run_starts(data, kind, begins)
        # Between runs there is only white space; without it they lie side by side.
        ends = np.concatenate([[0], np.cumsum(stop - first)]).astype(np.int64)
        runs = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data[kind != SPACE])]).dictionary_encode()
        known = self.runs.new.get
        found = [known(r) or self.run(r) for r in runs.dictionary.to_pylist()]
        n = np.array([len(x) >> 2 for x in found], np.int64)
        ids, where, code = np.frombuffer(b"".join(found), "<u4"), np.cumsum(n) - n, runs.indices.to_numpy()
        m = n[code]
        total = np.concatenate([[0], np.cumsum(m)])
        out = ids[np.repeat(where[code] - total[:-1], m) + np.arange(total[-1])]
        cut = total[np.searchsorted(first, np.append(begins, len(raw)))].tolist()
        return [out[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def offsets_of(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)


def bytes_of(texts: pa.Array) -> np.ndarray:
    """The bytes of a large binary array, one text after the other."""
    a, b = offsets_of(texts)[[0, -1]].tolist()
    return np.frombuffer(texts.buffers()[2], np.uint8, b - a, a) if b > a else np.empty(0, np.uint8)


def strange(texts: pa.Array) -> np.ndarray:
    """Whether each text holds anything but ASCII and Latin-1 letters, or marks of special tokens."""
    raw, offsets = bytes_of(texts), offsets_of(texts)
    at = np.flatnonzero((KIND[raw] == OTHER) | (raw == 0x97) | (raw == 0xB7) | (raw == 60))
    rest = raw[np.minimum(at + 1, len(raw) - 1)] if len(raw) else raw
    at = at[(raw[at] != 60) | (rest == 124)]
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(offsets - offsets[0], at, "right") - 1] = True
    return out


def parted(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end with white space."""
    at, end = 0, re.compile(rb"[\x20\x09-\x0D]")
    while len(text) - at > CHUNK_BYTES:
        m = end.search(text, at + CHUNK_BYTES)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


@functools.cache
def word_ids(path: str) -> WordIds:
    """The worker's own coder, whose cache lives on from task to task."""
    return WordIds(path)


def token_path(name: str) -> str:
    """Where the named public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
