"""Token counts from a tokenizer compiled to a finite-state transducer.

The tokenizer merges neighbouring symbols by score (BPE).  Two facts make that a
finite-state device.  A sequence of pieces is the tokenization of its text if, and only if,
every two neighbours are: merging their joined text gives just these two.  And so the last
piece of a text's tokenization is the one of its suffixes that goes with the last piece of
what is before it.  Which suffixes can be pieces, now or later, is told by the longest one
that begins a piece.

A state therefore is that suffix, and for each place in it the last piece that ends there
and the count up to there, relative to the count now.  An arc reads one symbol and is
annotated with the tokens it emits: the change of the count, which may be negative, as a
symbol may merge pieces.  Symbols are the characters that pieces hold, and for others, which
are spelled in bytes, their number of bytes.  States and arcs are compiled when they are first
met, once for all tasks of a worker, into a hash table over (state, symbol); when it is
full it is begun anew, between batches.

Texts are cut into chunks of fixed length, which run in lockstep, one array operation for
a symbol of all.  A chunk begins in an unknown state, but at a place that no piece spans the
state is the initial one: from its first such place (at a space, mostly) it runs on its own.
What is before, or all of a chunk without such a place, runs from the states in which the
chunk before ends.  Each chunk so gives a state map: for the states on entry the state on
exit and the tokens emitted.  Maps compose associatively; a prefix scan in log-steps gives
the count after every chunk of a text.

Null text is an empty text: no tokens.  Texts of any length are whole.  An empty table gives
an empty result; repeated rows give repeated rows; other columns don't matter.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows_of, texts_of
from .tokens import token_path

SPACE = "▁"
NORMAL, BYTE_KINDS = 1, (2, 3, 6)  # of pieces: what texts give, and unknown, control and byte pieces
#: Symbols of a chunk and of a batch, arcs that are kept, lanes that are worth array operations.
CHUNK, BATCH, MOST_ARCS, FEW = 2048, 3_000_000, 1_000_000, 24
NONE = np.int64(-1)
State = tuple[str, tuple[str | None, ...], tuple[int, ...]]


class Arcs:
    """A hash table from (state, symbol) to the next state and the tokens emitted."""

    def __init__(self):
        self.bits = 16
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.keys = np.full(1 << self.bits, NONE)
        self.to, self.emits = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int16)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or of the empty place where it would be."""
        at = self.slots(keys)
        there = self.keys[at]
        todo = np.flatnonzero((there != keys) & (there != NONE))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[at[todo]]
            todo = todo[(there != keys[todo]) & (there != NONE)]
        return at

    def put(self, keys: np.ndarray, to: np.ndarray, emits: np.ndarray) -> None:
        """New and different keys."""
        if 3 * (self.n + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys != NONE)
            keys, to, emits = (np.concatenate([x[old], y]) for x, y in ((self.keys, keys), (self.to, to), (self.emits, emits)))
            while 3 * len(keys) > 1 << self.bits:
                self.bits += 1
            self.clear()
        rest = np.arange(len(keys))
        while len(rest):  # several may want a place: the last written has it
            at = self.find(keys[rest])
            self.keys[at] = keys[rest]
            won = self.keys[at] == keys[rest]
            self.to[at[won]], self.emits[at[won]] = to[rest[won]], emits[rest[won]]
            rest = rest[~won]
        self.n += len(keys)


class Transducer:
    """Counts tokens of the sentencepiece model (BPE with byte fallback) at ``path``."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and without normalization are compiled")
        if any(p.type not in (NORMAL, *BYTE_KINDS) for p in model.pieces):
            raise ValueError("models with pieces of users' own are not compiled")
        self.prefix = spec.add_dummy_prefix
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.begins = {p[:i] for p in self.rank for i in range(1, len(p))}
        letters = sorted(set("".join(self.rank)) | {SPACE})
        #: Symbols 0 to 3 are characters of one to four bytes that no piece holds.
        self.letters = ["", "", "", "", *letters]
        self.symbol = np.zeros(0x110000, np.uint16)
        self.symbol[0x80:], self.symbol[0x800:], self.symbol[0x10000:] = 1, 2, 3
        self.symbol[[ord(c) for c in letters]] = np.arange(4, 4 + len(letters))
        self.symbol[32] = self.symbol[ord(SPACE)]
        self.width = len(self.letters)
        pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        code = {c: i for i, c in enumerate(self.letters) if c}
        self.joined = np.sort(np.array([code[a] * self.width + code[b] for a, b in pairs], np.int64))
        self.merged = functools.lru_cache(1 << 16)(self._merged)
        self.arcs = Arcs()
        self.restart()

    def restart(self) -> None:
        """No states but the initial one, no arcs; ``start`` follows the space that texts are given."""
        self.arcs.clear()
        self.single: dict[int, tuple[int, int]] = {}
        self.states: list[State] = []
        self.number: dict[State, int] = {}
        self.initial = self.numbered(("", (None,), (0,)))
        self.start = self.step(self.initial, int(self.symbol[32]))[0] if self.prefix else self.initial

    def numbered(self, state: State) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    # --- compilation ---

    def _merged(self, text: str) -> tuple[str, ...]:
        """Best pair first, leftmost on ties, until no pair is a piece."""
        rank, n = self.rank, len(text)
        parts: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, text[i : i + 2]) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(piece + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, piece + parts[k]))
            if (h := before[i]) >= 0 and (r := rank.get(parts[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, parts[h] + piece))
        return tuple(p for p in parts if p is not None)

    def cost(self, piece: str) -> int:
        return 1 if piece in self.rank else len(piece.encode("utf-8", "surrogatepass"))

    def goes(self, last: str | None, piece: str) -> bool:
        """Whether ``piece`` follows ``last``, or nothing, in a tokenization."""
        return self.merged(piece) == (piece,) if last is None else self.merged(last + piece) == (last, piece)

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state after a symbol, and the tokens emitted."""
        c = self.letters[symbol]
        if not c:
            return self.initial, symbol + 1
        window, lasts, counts = self.states[state]
        text = window + c
        for j in range(len(text)):  # the longest first
            piece = text[j:]
            if (len(piece) == 1 or piece in self.rank) and self.goes(lasts[j], piece):
                break
        else:
            raise AssertionError(f"no piece of {text!r} goes on")
        emitted = counts[j] + self.cost(piece)
        lasts, counts = [*lasts, piece], [*(x - emitted for x in counts), 0]
        k = next((k for k in range(len(text)) if text[k:] in self.begins), len(text))
        first = lasts[k]
        if k == len(text) or first is not None and not self.spanned(first[-1], text[k]):
            first = None  # what was before has no say any more
        return self.numbered((text[k:], (first, *lasts[k + 1 :]), tuple(counts[k:]))), emitted

    def spanned(self, a: str, b: str) -> bool:
        key = int(self.symbol[ord(a)]) * self.width + int(self.symbol[ord(b)])
        at = int(np.searchsorted(self.joined, key))
        return at < len(self.joined) and int(self.joined[at]) == key

    # --- running ---

    def compiled(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the arcs of (state, symbol); missing ones are made."""
        at = self.arcs.find(keys)
        missing = self.arcs.keys[at] != keys
        if missing.any():
            new = np.unique(keys[missing])
            made = [self.step(*divmod(k, self.width)) for k in new.tolist()]
            self.arcs.put(new, np.array([x for x, _ in made], np.int32), np.array([n for _, n in made], np.int16))
            at = self.arcs.find(keys)
        return at

    def run(self, symbols: np.ndarray, first: np.ndarray, stop: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and emitted tokens of spans of the symbols, each from a state of its own."""
        order = np.argsort(first - stop, kind="stable")  # the longest first, so that those that run are a prefix
        at, size, now = first[order], (stop - first)[order], state[order].astype(np.int64)
        total = np.zeros(len(order), np.int64)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for k, n in enumerate(live.tolist()):
            if n <= FEW:
                for i in range(n):
                    now[i], more = self.alone(int(now[i]), symbols[at[i] + k : at[i] + size[i]].tolist())
                    total[i] += more
                break
            arc = self.compiled(now[:n] * self.width + symbols[at[:n] + k])
            now[:n] = self.arcs.to[arc]
            total[:n] += self.arcs.emits[arc]
        exits, counts = np.empty_like(now), np.empty_like(total)
        exits[order], counts[order] = now, total
        return exits, counts

    def alone(self, state: int, symbols: list[int]) -> tuple[int, int]:
        """As ``run``, of one span."""
        known, total, width = self.single, 0, self.width
        for s in symbols:
            arc = known.get(state * width + s)
            if arc is None:
                if len(known) >= MOST_ARCS // 4:
                    known.clear()
                arc = known[state * width + s] = self.step(state, s)
            state, more = arc
            total += more
        return state, total

    def alone_from(self, state: int, text: str) -> int:
        """The state after a text."""
        return self.alone(state, self.symbol[[ord(c) for c in text]].tolist())[0]

    def cuts(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether no piece spans the place before each symbol."""
        out = np.ones(len(symbols), bool)
        for a in range(1, len(symbols), 1 << 20):
            b = min(len(symbols), a + (1 << 20))
            keys = symbols[a - 1 : b - 1].astype(np.int64) * self.width + symbols[a:b]
            out[a:b] = self.joined[np.minimum(np.searchsorted(self.joined, keys), len(self.joined) - 1)] != keys
        out[begins[begins < len(symbols)]] = True
        return out

    def count(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        if self.arcs.n > MOST_ARCS or len(self.states) > MOST_ARCS // 2:
            self.restart()
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.symbol[points]
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        chunks = -(-sizes // CHUNK)
        of = np.repeat(np.arange(len(texts)), chunks)
        first_of = np.cumsum(chunks) - chunks
        first = begins[of] + (np.arange(len(of)) - first_of[of]) * CHUNK
        stop = np.minimum(first + CHUNK, begins[of] + sizes[of])
        opens = first == begins[of]
        # Where each chunk can begin on its own: its first place that no piece spans.
        places = np.flatnonzero(self.cuts(symbols, begins))
        own = np.append(places, len(symbols))[np.searchsorted(places, first)] if len(places) else first
        own = np.where(opens, first, np.minimum(own, stop))
        exits, counts = self.run(symbols, own, stop, np.where(opens, self.start, self.initial))
        free = own < stop  # the rest is spanned as a whole: its exit hangs on its entry
        maps: list[dict[int, tuple[int, int]]] = [{self.start: (e, n)} if x else {} for e, n, x in zip(exits.tolist(), counts.tolist(), opens.tolist(), strict=True)]
        ready = np.flatnonzero(~opens & np.concatenate([[False], free[:-1]])) if len(of) else np.empty(0, np.int64)
        while len(ready):
            entry = exits[ready - 1]
            out, n = self.run(symbols, first[ready], own[ready], entry)
            exits[ready] = np.where(free[ready], exits[ready], out)
            for k, e, x, m in zip(ready.tolist(), entry.tolist(), exits[ready].tolist(), (n + np.where(free[ready], counts[ready], 0)).tolist(), strict=True):
                maps[k][e] = (x, m)
            after = ready[~free[ready]] + 1
            after = after[after < len(of)]
            ready = after[~opens[after]]
        found = []
        for i, (a, n) in enumerate(zip(first_of.tolist(), chunks.tolist(), strict=True)):
            opening = 1 if self.prefix and sizes[i] else 0
            found.append(opening + scan(maps[a : a + n])[-1][self.start][1] if n else 0)
        return found


def composed(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The state map of two chunks in a row."""
    return {s: (b[t][0], n + b[t][1]) for s, (t, n) in a.items() if t in b}


def scan(maps: list[dict[int, tuple[int, int]]]) -> list[dict[int, tuple[int, int]]]:
    """Inclusive prefix composition in log-steps."""
    step = 1
    while step < len(maps):
        maps = [*maps[:step], *(composed(maps[k - step], maps[k]) for k in range(step, len(maps)))]
        step *= 2
    return maps


@functools.cache
def transducer(path: str) -> Transducer:
    """The worker's own, whose arcs live on from task to task."""
    return Transducer(path)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text."""

    def count(batches):
        t, held, size = transducer(model), [], 0

        def flushed():
            ids, texts = zip(*held, strict=True)
            sizes = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, sizes, t.count(list(texts)))], names=["doc_id", "n_bytes", "n_tokens"])

        for doc_id, text in rows_of(batches):
            held.append((doc_id, text))
            size += len(text)
            if size >= BATCH:
                yield flushed()
                held, size = [], 0
        if held:
            yield flushed()

    return texts_of(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


MODEL, LIMIT = "piece_bpe_32k.model", 4096


def op7_transducer_counts(spark, sf_dir: str) -> DataFrame:
    df = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), token_path(MODEL))
    return df.withColumn("over_limit", df["n_tokens"] > LIMIT)
