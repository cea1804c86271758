"""Language-model scoring: a gated recurrent network with a class-factored softmax.

Documents whose crc32 remainder says so are held out; all others train.

1. *Chunks.*  A task turns its texts, about ``CHUNK_BYTES`` at a time, into token
   numbers; a chunk is written as its packed documents and a row for each
   distinct token (number, hash, training count).  Texts are read once and never shuffled.
2. *Counts.*  Token rows are summed by hash: corpus counts, their sums by band of
   counts, and the most frequent tokens (the head of the vocabulary).  The counts
   go back to the chunks' token rows; all of this is linear in the chunks' distinct tokens.
3. *Symbols.*  A chunk meets its counts and turns every document into symbols: head
   tokens by rank, other tokens by band; the base score is summed on the way.
4. *Training.*  A fixed number of workers, dealt by a hash of the document and so
   independent of splits, each train a copy of the network on all windows of
   their documents in parallel lanes (truncated backpropagation in numpy, state
   carried from window to window to the document's end).  Documents are dealt to
   rounds, so that all rounds together are one full pass; copies are averaged in
   a fixed order, weighted by their tokens, and the next round starts from the average.
5. *Scoring.*  Whole documents run through the network in parallel lanes, with the
   state carried across windows to the end of the document.

The output softmax is factored: classes of head words, narrow for the most
frequent ones, and one class for each band of rarer tokens, within which a token has its
smoothed share of the corpus counts.  The head grows with the square root of the
corpus, from ``HEAD`` tokens on.  So the model is a distribution over the same events as the base.

Cases: null and empty texts are one end token; a null id has the text ''; with
no training token every band but the unknown one is empty; repeated rows train
as often as they stand there; rows of one id, or of none, are dealt by their
texts too; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import materialize, shuffle_parts

HEAD, BANDS = 1024, 32
SYMBOLS = HEAD + BANDS  # of the least head
HIDDEN, STEPS, LANES = 16, 32, 256
END = b"\n"  # no word holds a line end
CHUNK_BYTES, SEGMENT_BYTES = 32 << 20, 4 << 20
AHEAD = 16  # steps whose shares of the gates are read at once in scoring
WORKER_TOKENS = 4_000_000  # of a worker in a round
SCORED_TOKENS = 3_000_000  # that are scored side by side
NOTHING = -1e9
BLANK = re.compile(rb"[\x20\x09-\x0d]")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def width_of(head: int) -> int:
    """The power of two from the square root on."""
    return 1 << math.ceil(math.log2(head) / 2)


def head_size(size: int) -> int:
    """Head tokens for so many bytes of text."""
    return max(HEAD, math.isqrt(size) // 8 // 64 * 64)


@functools.lru_cache(8)
def class_starts(size: int) -> np.ndarray:
    """First ranks of the head's classes, and the end: classes of 8 and of 32 for the most frequent words, then wide ones."""
    few, some = min(size, 64), min(size, 576)
    wide = 2 * width_of(max(1, size - some))
    return np.unique(np.r_[np.arange(0, few, 8), np.arange(few, some, 32), np.arange(some, size, wide), size])


class Numbering(dict):
    """Words to numbers in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The lower-case words of a text, a segment at a time."""
    low, at = text.lower(), 0
    while at < len(low):
        end = at + SEGMENT_BYTES
        if end < len(low):
            cut = BLANK.search(low, end)
            end = cut.start() if cut else len(low)
        yield low[at:end].split()
        at = end


def numbered_tokens(texts: Iterator[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """(token numbers of every text, the end included; hashes of the numbered tokens)."""
    numbers = Numbering()
    end, docs = np.array([numbers[END]], np.int32), []
    for text in texts:
        docs.append(np.concatenate([*(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in word_lists(text)), end]))
    return docs, np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in numbers), np.uint64, len(numbers))


def band(counts: np.ndarray) -> np.ndarray:
    """0 for unknown tokens, else one more than the binary logarithm of the count."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], BANDS - 1)


# ---- the network


def _exponentials(logits: np.ndarray) -> np.ndarray | float:
    """In place, of columns less their greatest where they are large: float32 overflows at 88; returns what was taken off."""
    off = 0.0
    if logits.size and logits.max() > 60:
        off = logits.max(0)
        logits -= off
    np.exp(logits, out=logits)
    return off


def _log_share(logits: np.ndarray, picked: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Log of the softmax of every column at one row; ``logits`` is used up."""
    chosen = logits[picked, columns]
    chosen = chosen - _exponentials(logits)
    return chosen - np.log(logits.sum(0))


def _softmax_error(logits: np.ndarray, picked: np.ndarray, columns: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of the weighted negative log-likelihood by the logits, in their place."""
    _exponentials(logits)
    logits *= weight / logits.sum(0)
    logits[picked, columns] -= weight
    return logits


class Network:
    """Parameters by name, float32.

    ``x``: a symbol's share of the three gates; ``u``: the state's; ``wc``, ``bc``:
    classes; ``ww``, ``bw``: words of the head, by rank.  Inside, features are rows
    and tokens columns, and large arrays are taken from ``room`` again and again.
    """

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.room: dict[str, np.ndarray] = {}
        self.head = params["ww"].shape[0]
        self.starts = class_starts(self.head)
        self.groups = len(self.starts) - 1
        self.group_of = np.repeat(np.arange(self.groups), np.diff(self.starts))
        # bands without tokens, at the end, need no column
        self.live = int(np.flatnonzero(params["bc"] > NOTHING / 2).max(initial=self.groups - 1)) + 1

    @classmethod
    def new(cls, head: np.ndarray, masses: np.ndarray, seed: int = 7, size: int = HEAD) -> Network:
        """``head``: counts + 0.5 by rank, ``size`` at most; ``masses``: the same summed over each band's other tokens.

        Biases give the unigram distribution, so training starts from the base.
        """
        rng = np.random.default_rng(seed)
        words, starts = np.full(size, 1e-30), class_starts(size)
        words[: len(head)] = head
        classes = np.concatenate([np.add.reduceat(words, starts[:-1]), masses])
        with np.errstate(divide="ignore"):
            bc = np.where(classes > 1e-9, np.log(np.maximum(classes, 1e-30)), NOTHING)
        bw = np.where(words > 1e-9, np.log(words), NOTHING)
        bw -= np.repeat(np.maximum(np.maximum.reduceat(bw, starts[:-1]), -1e8), np.diff(starts))
        p = {
            "x": rng.normal(0, 0.1, (3 * HIDDEN, size + BANDS)),
            "u": rng.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)),
            "wc": np.zeros((len(classes), HIDDEN)),
            "bc": bc - bc.max(),
            "ww": np.zeros((size, HIDDEN)),
            "bw": bw,
        }
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def pack(self) -> bytes:
        return b"".join(self.p[k].tobytes() for k in sorted(self.p))

    @classmethod
    def unpack(cls, raw: bytes, size: int) -> Network:
        classes = len(class_starts(size)) - 1 + BANDS
        shapes = {"x": (3 * HIDDEN, size + BANDS), "u": (3 * HIDDEN, HIDDEN), "wc": (classes, HIDDEN), "bc": (classes,), "ww": (size, HIDDEN), "bw": (size,)}
        flat, at, p = np.frombuffer(raw, np.float32), 0, {}
        for k in sorted(shapes):
            n = int(np.prod(shapes[k]))
            p[k] = flat[at : at + n].reshape(shapes[k]).copy()
            at += n
        return cls(p)

    def _empty(self, name: str, *shape: int) -> np.ndarray:
        """An array for this call only; its memory is used again by the next one."""
        n, kind = math.prod(shape), self.p["u"].dtype
        flat = self.room.get(name)
        if flat is None or len(flat) < n or flat.dtype != kind:
            flat = self.room[name] = np.empty(n, kind)
        return flat[:n].reshape(shape)

    def _forward(self, h: np.ndarray, x: np.ndarray, gates: np.ndarray, n: np.ndarray, hn: np.ndarray, out: np.ndarray) -> None:
        """One step: the new state from state ``h`` and the symbols' shares ``x``; all (features, lanes)."""
        hu = np.matmul(self.p["u"], h, out=self._empty("hu", 3 * HIDDEN, h.shape[1]))
        np.add(x[: 2 * HIDDEN], hu[: 2 * HIDDEN], out=gates)
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        hn[...] = hu[2 * HIDDEN :]
        np.multiply(gates[HIDDEN:], hn, out=n)
        n += x[2 * HIDDEN :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= gates[:HIDDEN]
        out += n

    def shares(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols' shares of the gates (features, symbols); good until the next call."""
        return np.take(self.p["x"], symbols, axis=1, out=self._empty("x1", 3 * HIDDEN, len(symbols)), mode="clip")

    def step(self, h: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
        """The state (features, lanes) behind one symbol a lane, from the symbols' shares."""
        k = h.shape[1]
        self._forward(h, x, self._empty("zr1", 2 * HIDDEN, k), self._empty("n1", HIDDEN, k), self._empty("hn1", HIDDEN, k), out)

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.head, self.group_of[np.minimum(symbols, self.head - 1)], self.groups + symbols - self.head)

    def _by_class(self, mine: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """(part of the tokens, sorted by class; their words) of every class of ``mine``."""
        if len(mine):
            cuts = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), len(mine)]
            for a, b in zip(cuts, cuts[1:]):
                yield slice(a, b), slice(int(self.starts[mine[a]]), int(self.starts[mine[a] + 1]))

    def log_probs(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of class times word probability behind states (features, tokens); within bands only the class."""
        p, live = self.p, self.live
        at, cls = np.arange(len(symbols)), self.class_of(symbols)
        logits = np.matmul(p["wc"][:live], h, out=self._empty("d", live, len(symbols)))
        logits += p["bc"][:live, None]
        out = _log_share(logits, np.minimum(cls, live - 1), at)
        if len(cls) and cls.max() >= live:
            out[cls >= live] = NOTHING
        head = np.flatnonzero(symbols < self.head)
        order = head[np.argsort(cls[head], kind="stable")]
        picked, words = np.take(h, order, axis=1), symbols[order]
        for part, rows in self._by_class(cls[order]):
            logits = p["ww"][rows] @ picked[:, part]
            logits += p["bw"][rows, None]
            out[order[part]] += _log_share(logits, words[part] - rows.start, at[: part.stop - part.start])
        return out

    def gradients(self, before: np.ndarray, symbols: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss over one window (lanes x steps), and the states behind it, a row a lane."""
        p, live, (lanes, steps) = self.p, self.live, symbols.shape
        n_all, kind = lanes * steps, before.dtype
        seq = np.ascontiguousarray(symbols.T).ravel()  # step by step
        x = np.take(p["x"], seq, axis=1, out=self._empty("x", 3 * HIDDEN, n_all), mode="clip")
        states, gates = self._empty("states", steps + 1, HIDDEN, lanes), self._empty("zr", steps, 2 * HIDDEN, lanes)
        inner, back_in = self._empty("n", steps, HIDDEN, lanes), self._empty("hn", steps, HIDDEN, lanes)
        states[0] = before.T
        for t in range(steps):
            self._forward(states[t], x[:, t * lanes : (t + 1) * lanes], gates[t], inner[t], back_in[t], states[t + 1])
        hs, h0 = self._empty("hs", HIDDEN, steps, lanes), self._empty("h0", HIDDEN, steps, lanes)
        hs[...], h0[...] = states[1:].transpose(1, 0, 2), states[:-1].transpose(1, 0, 2)
        hs, h0 = hs.reshape(HIDDEN, n_all), h0.reshape(HIDDEN, n_all)
        flat, weight = np.ascontiguousarray(targets.T).ravel(), (mask.T / max(1.0, mask.sum())).ravel().astype(kind)
        cls, at = self.class_of(flat), np.arange(n_all)
        d = np.matmul(p["wc"][:live], hs, out=self._empty("d", live, n_all))
        d += p["bc"][:live, None]
        _softmax_error(d, cls, at, weight)
        g = {k: self._empty(f"g_{k}", *v.shape) for k, v in p.items()}
        for k in ("wc", "bc", "ww", "bw"):
            g[k].fill(0)
        g["wc"][:live], g["bc"][:live] = d @ hs.T, d.sum(1)
        dh_out = np.matmul(p["wc"][:live].T, d, out=self._empty("dh", HIDDEN, n_all))
        head = np.flatnonzero((flat < self.head) & (weight > 0))
        order = head[np.argsort(cls[head], kind="stable")]
        picked = np.take(hs, order, axis=1, out=self._empty("picked", HIDDEN, len(order)), mode="clip")
        heavy, words, back = weight[order], flat[order], self._empty("back", HIDDEN, len(order))
        for part, rows in self._by_class(cls[order]):
            mine, ww = picked[:, part], p["ww"][rows]
            d = ww @ mine
            d += p["bw"][rows, None]
            _softmax_error(d, words[part] - rows.start, at[: part.stop - part.start], heavy[part])
            np.matmul(d, mine.T, out=g["ww"][rows])
            d.sum(1, out=g["bw"][rows])
            back[:, part] = ww.T @ d
        for row, more in zip(dh_out, back):
            row[order] += more
        gx, rn_all = self._empty("gx", 3 * HIDDEN, n_all), self._empty("rn", HIDDEN, n_all)
        du, kz, turned = self._empty("du", 3 * HIDDEN, lanes), self._empty("kz", HIDDEN, lanes), np.ascontiguousarray(p["u"].T)
        dh = np.zeros((HIDDEN, lanes), kind)
        for t in range(steps - 1, -1, -1):
            here = slice(t * lanes, (t + 1) * lanes)
            z, r, n = gates[t, :HIDDEN], gates[t, HIDDEN:], inner[t]
            dh += dh_out[:, here]
            np.multiply(dh, z, out=kz)
            dn = (dh - kz) * (1 - n * n)
            dz, dr, rn = du[:HIDDEN], du[HIDDEN : 2 * HIDDEN], du[2 * HIDDEN :]
            np.subtract(states[t], n, out=dz)
            dz *= kz
            dz *= 1 - z
            np.multiply(dn, r, out=rn)
            np.multiply(rn, back_in[t], out=dr)
            dr *= 1 - r
            gx[: 2 * HIDDEN, here], gx[2 * HIDDEN :, here], rn_all[:, here] = du[: 2 * HIDDEN], dn, rn
            np.matmul(turned, du, out=dh)
            dh += kz
        g["u"][: 2 * HIDDEN], g["u"][2 * HIDDEN :] = gx[: 2 * HIDDEN] @ h0.T, rn_all @ h0.T
        for row, share in zip(g["x"], gx):
            row[...] = np.bincount(seq, share, len(row))
        return g, np.ascontiguousarray(states[-1].T)


class Adam:
    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
        # what has no probability keeps none
        self.moves = {k: (net.p[k] > NOTHING / 2).astype(np.float32) for k in ("bc", "bw")}

    def apply(self, g: dict[str, np.ndarray]) -> None:
        """``g`` is used up."""
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-12)))
        warm = np.float32(self.rate * min(1.0, self.t / 20) * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += x * (np.float32(0.1) * scale)
            v *= np.float32(0.999)
            x *= x
            x *= np.float32(0.001) * scale * scale
            v += x
            np.sqrt(v, out=x)
            x += np.float32(1e-8)
            np.divide(m, x, out=x)
            x *= warm
            if k in self.moves:
                x *= self.moves[k]
            self.net.p[k] -= x


class Windows:
    """Windows of all symbols of documents, in parallel lanes; a lane carries one document to its end."""

    def __init__(self, docs: Iterator[np.ndarray], lanes: int):
        self.docs, self.lanes = docs, lanes
        self.open: list[list] = []  # [the document behind its end symbol, place]
        self.state = np.zeros((0, HIDDEN), np.float32)

    def fill(self) -> bool:
        """Replace finished documents; False when none is left."""
        stay = [i for i, (full, at) in enumerate(self.open) if at < len(full) - 1]
        self.open, state = [self.open[i] for i in stay], [self.state[stay]]
        while len(self.open) < self.lanes and (symbols := next(self.docs, None)) is not None:
            self.open.append([np.concatenate([symbols[-1:], symbols]), 0])  # a document starts behind an end
            state.append(np.zeros((1, HIDDEN), np.float32))
        self.state = np.concatenate(state)
        return bool(self.open)

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        """The next (lanes x ``STEPS`` + 1) symbols, and which targets are real."""
        batch = np.zeros((len(self.open), STEPS + 1), np.int32)
        mask = np.zeros((len(self.open), STEPS), bool)
        for i, lane in enumerate(self.open):
            part = lane[0][lane[1] : lane[1] + STEPS + 1]
            batch[i, : len(part)] = part
            mask[i, : len(part) - 1] = True
            lane[1] += STEPS
        return batch, mask


def train(net: Network, docs: Iterator[np.ndarray], lanes: int = LANES, rate: float = 0.01) -> int:
    """Train in place on every symbol of ``docs`` once; returns the number of trained tokens."""
    adam, windows, tokens = Adam(net, rate), Windows(iter(docs), lanes), 0
    summed, weight = {}, 0
    while windows.fill():
        batch, mask = windows.window()
        g, windows.state = net.gradients(windows.state, batch[:, :-1], batch[:, 1:], mask)
        n = int(mask.sum())
        tokens += n
        # the last long documents leave few lanes: their windows share a step
        if weight or n < lanes * STEPS // 8:
            summed = {k: summed[k] + x * np.float32(n) if weight else x * np.float32(n) for k, x in g.items()}
            weight += n
            if weight < lanes * STEPS // 8:
                continue
            g, weight = {k: x / np.float32(weight) for k, x in summed.items()}, 0
        adam.apply(g)
    if weight:
        adam.apply({k: x / np.float32(weight) for k, x in summed.items()})
    return tokens


def score(net: Network, docs: list[np.ndarray], lanes: int = 256, steps: int = 64) -> np.ndarray:
    """Natural log-likelihood of whole documents; within bands only the class."""
    out = np.zeros(len(docs))
    lanes = min(lanes, len(docs))
    if not lanes:
        return out
    # the longest document first to the shortest lane
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    load, queue = [0] * lanes, [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for i in order:
        n, k = heapq.heappop(heap)
        queue[k].append(i)
        load[k] = n + len(docs[i])
        heapq.heappush(heap, (load[k], k))
    length = max(load)
    symbols = np.zeros((lanes, length), np.int32)
    before = np.zeros((lanes, length), np.int32)
    owner = np.full((lanes, length), -1, np.int32)
    fresh = np.zeros((lanes, length), bool)
    for k, mine in enumerate(queue):
        at = 0
        for i in mine:
            n = len(docs[i])
            symbols[k, at : at + n] = docs[i]
            before[k, at] = docs[i][-1]
            before[k, at + 1 : at + n] = docs[i][:-1]
            owner[k, at : at + n] = i
            fresh[k, at] = True
            at += n
    # longest lanes first, so that finished ones drop off the end
    by_load = np.argsort([-x for x in load], kind="stable")
    symbols, before, owner, fresh = (a[by_load] for a in (symbols, before, owner, fresh))
    load = np.array(load)[by_load]
    starts = fresh.any(axis=0).tolist()
    h = np.zeros((HIDDEN, lanes), np.float32)
    for a in range(0, length, steps):
        live = int((load > a).sum())
        h = np.ascontiguousarray(h[:, :live])
        b = min(a + steps, length)
        states = np.empty((b - a, HIDDEN, live), np.float32)
        for t in range(a, b):
            if (t - a) % AHEAD == 0:
                x = net.shares(before[:live, t : min(t + AHEAD, b)].T.ravel())
            if starts[t]:
                h = np.where(fresh[:live, t], np.float32(0), h)
            at = (t - a) % AHEAD * live
            net.step(h, x[:, at : at + live], states[t - a])
            h = states[t - a]
        h, states = h.copy(), states.transpose(1, 0, 2)
        who = owner[:live, a:b].T.ravel()
        real = np.flatnonzero(who >= 0)
        value = net.log_probs(np.take(states.reshape(HIDDEN, -1), real, axis=1), symbols[:live, a:b].T.ravel()[real])
        out += np.bincount(who[real], value, len(docs))
    return out


# ---- Spark stages


def _squeezed(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)
    return zstandard.ZstdCompressor(level=1).compress(planes.T.tobytes())


def _unsqueezed(blob: bytes, kind: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


TOKEN, DOCUMENTS = 0, 1
_CHUNK = "kind int, b long, num int, h long, c long, blob binary"
_CHUNK_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
_CHUNK_NAMES = ["kind", "b", "num", "h", "c", "blob"]


def _pack_documents(ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    parts = [
        len(docs).to_bytes(8, "little"),
        np.array([i is None for i in ids], np.uint8).tobytes(),
        np.array([i or 0 for i in ids], np.int64).tobytes(),
        np.array([len(d) for d in docs], np.int64).tobytes(),
        np.concatenate(docs).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(),
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack_documents(blob: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    null = np.frombuffer(raw, np.uint8, n, 8).tolist()
    ids, lens = (np.frombuffer(raw, np.int64, n, at) for at in (8 + n, 8 + 9 * n))
    numbers = np.ascontiguousarray(np.frombuffer(raw, np.uint8, -1, 8 + 17 * n).reshape(4, -1).T).view(np.uint32).ravel()
    return [None if k else i for k, i in zip(null, ids.tolist())], np.split(numbers, np.cumsum(lens)[:-1])


def _chunks(chunk_bytes: int):
    """Step 1: rows of (TOKEN, chunk, number, hash, training count) and one of (DOCUMENTS, chunk, packed documents)."""

    def flush(ids: list[int | None], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        chunk = int.from_bytes(os.urandom(8), "little") >> 1  # any name that no other chunk has
        docs, hashes = numbered_tokens(texts)
        trains = [d for i, d in zip(ids, docs) if not held_out(i)]
        counts = np.bincount(np.concatenate(trains) if trains else np.empty(0, np.int32), minlength=len(hashes))
        n = len(hashes)
        tokens = [np.full(n, TOKEN, np.int32), np.full(n, chunk, np.int64), np.arange(n, dtype=np.int32), hashes.view(np.int64), counts.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, tokens), pa.nulls(n, pa.binary())], names=_CHUNK_NAMES)
        row = (DOCUMENTS, chunk, 0, 0, 0, _pack_documents(ids, docs))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _CHUNK_TYPES)], names=_CHUNK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text")):
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1]) + 1
                if size >= chunk_bytes:
                    yield from flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from flush(ids, texts)

    return run


_ROW = ("id", "held_out", "n_tokens", "n_known", "base", "banded", "symbols")
_ROW_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
_ROW_SCHEMA = "id long, held_out boolean, n_tokens long, n_known long, base double, banded double, symbols binary"


def _batch(rows: list[tuple], names: tuple[str, ...], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


def _symbols(size: int, head_hashes: np.ndarray, masses: np.ndarray, total: float, types: int):
    """Step 3: symbols, base scores, and the logs of shares within bands; a chunk's token rows stand before its documents."""
    order = np.argsort(head_hashes)
    by_hash = head_hashes[order]

    def chunk(found: list[tuple[np.ndarray, ...]], blob: bytes) -> Iterator[pa.RecordBatch]:
        number, hashes, count = (np.concatenate(c) for c in zip(*found))
        counts, distinct = np.empty(len(number)), np.empty(len(number), np.uint64)
        counts[number], distinct[number] = count, hashes.view(np.uint64)
        base = np.log10((counts + 0.5) / (total + 0.5 * (types + 1)))
        symbols = size + band(counts)
        share = np.log((counts + 0.5) / masses[symbols - size])
        if len(by_hash):
            place = np.minimum(np.searchsorted(by_hash, distinct), len(by_hash) - 1)
            head = by_hash[place] == distinct
            symbols[head], share[head] = order[place[head]], 0.0
        out = []
        for i, mine in zip(*_unpack_documents(blob)):
            out.append((i, held_out(i), len(mine), int((counts[mine] > 0).sum()), float(base[mine].sum()), float(share[mine].sum()), _squeezed(symbols[mine].astype("u4"))))
            if len(out) == 2000:
                yield _batch(out, _ROW, _ROW_TYPES)
                out = []
        yield _batch(out, _ROW, _ROW_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in ("num", "h", "c")]
            at = 0
            for row in np.flatnonzero(b.column("kind").to_numpy() == DOCUMENTS).tolist():
                found.append(tuple(c[at:row] for c in columns))
                yield from chunk(found, b.column("blob")[row].as_py())
                found, at = [], row + 1
            found.append(tuple(c[at:].copy() for c in columns))

    return run


_COPY = "slot int, worker long, tokens long, params binary"
_COPY_NAMES, _COPY_TYPES = ("slot", "worker", "tokens", "params"), [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
SLOTS = 32


def _trained(start: bytes, size: int, phase: int, lanes: int):
    """Step 4: tokens and parameters of every worker, over rows sorted by worker; later rounds take smaller steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((w, x) for b in batches for w, x in zip(b.column("worker").to_pylist(), b.column("symbols")))
        for worker, mine in itertools.groupby(rows, key=lambda r: r[0]):
            net = Network.unpack(start, size)
            tokens = train(net, (_unsqueezed(x.as_py(), "u4").astype(np.int32) for _, x in mine), lanes, rate=0.01 / (1 + 2 * phase))
            yield _batch([(worker % SLOTS, worker, tokens, net.pack())], _COPY_NAMES, _COPY_TYPES)

    return run


def _averaged(whole: bool):
    """Weighted means of the rows of each slot, or of all, in the order they stand in; one at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column("slot").to_pylist(), b.column("tokens").to_pylist(), b.column("params")))
        for slot, mine in itertools.groupby(rows, key=lambda r: 0 if whole else r[0]):
            total, weight = None, 0
            for _, tokens, raw in mine:
                part = np.frombuffer(raw.as_py(), np.float32).astype(np.float64) * tokens
                total = part if total is None else total + part
                weight += tokens
            yield _batch([(slot, slot, weight, (total / weight).astype(np.float32).tobytes())], _COPY_NAMES, _COPY_TYPES)

    return run


def _scored(params: bytes, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, held, waiting = Network.unpack(params, size), [], 0

        def work() -> pa.RecordBatch:
            docs = [_unsqueezed(r[6], "u4").astype(np.int32) for r in held]
            logs = score(net, docs)
            return _batch([(*r[:5], (x + r[5]) / np.log(10)) for r, x in zip(held, logs.tolist())], (*_ROW[:5], "score"), [*_ROW_TYPES[:5], pa.float64()])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _ROW)):
                held.append(row)
                waiting += row[2]
                if waiting >= SCORED_TOKENS:
                    yield work()
                    held, waiting = [], 0
        if held:
            yield work()

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``rounds``: each training document is trained on in one of them, from its
    first symbol to its last.
    """
    parts = shuffle_parts(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    words = head_size(size)
    chunks = materialize(source.mapInArrow(_chunks(chunk_bytes), _CHUNK))
    tokens = chunks.where(F.col("kind") == TOKEN).select("b", "num", "h", "c")
    counts = materialize(tokens.groupBy("h").agg(F.sum("c").alias("c")))

    # a row a band, and the head; a band is the number of binary digits
    known = counts.where("c > 0")
    sums = known.groupBy(F.least(F.length(F.bin("c")), F.lit(BANDS - 1)).alias("band")).agg(F.count("*").alias("types"), F.sum("c").alias("tokens")).collect()
    types, total = sum(r.types for r in sums), sum(r.tokens for r in sums)
    head = known.orderBy(F.desc("c"), "h").limit(words).collect()
    head_hashes = np.array([r.h for r in head], np.int64).view(np.uint64)
    head_counts = np.array([r.c for r in head], np.float64)
    masses = np.zeros(BANDS)
    masses[0] = 0.5
    for r in sums:
        masses[r.band] += r.tokens + 0.5 * r.types
    if len(head_counts):
        masses -= np.bincount(band(head_counts), head_counts + 0.5, BANDS)
    masses = np.where(masses < 0.25, 0.0, masses)

    counted = tokens.drop("c").join(counts, "h").select(F.lit(TOKEN).alias("kind"), "b", "num", "h", "c", F.lit(None).cast("binary").alias("blob"))
    rows = counted.unionByName(chunks.where(F.col("kind") == DOCUMENTS)).repartition(parts, "b").sortWithinPartitions("b", "kind")
    table = materialize(rows.mapInArrow(_symbols(words, head_hashes, np.maximum(masses, 1e-9), float(total), types), _ROW_SCHEMA))

    params = Network.new(head_counts + 0.5, masses, size=words).pack()
    workers = max(1, -(-int(total) // (rounds * WORKER_TOKENS)))
    lanes = min(LANES, max(32, int(total) // (rounds * workers * STEPS * 64)))
    deal = F.xxhash64("id", "symbols")  # of the document alone
    trains = table.where(~F.col("held_out")).select("symbols", deal.alias("deal"), F.pmod(deal, F.lit(rounds)).alias("round"), F.pmod(F.shiftright(deal, 16), F.lit(workers)).alias("worker"))
    for k in range(rounds if total else 0):
        mine = trains.where(F.col("round") == k).repartition(workers, "worker").sortWithinPartitions("worker", "deal")
        copies = mine.select("worker", "symbols").mapInArrow(_trained(params, words, k, lanes), _COPY)
        means = copies.repartition(SLOTS, "slot").sortWithinPartitions("slot", "worker").mapInArrow(_averaged(False), _COPY)
        found = means.repartition(1).sortWithinPartitions("slot").mapInArrow(_averaged(True), _COPY).collect()  # one row
        if found:
            params = bytes(found[0].params)
    out = table.mapInArrow(_scored(params, words), "id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
