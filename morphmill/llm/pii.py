"""Personal data by a character-level bidirectional LSTM with CRF transitions, in numpy.

The model is trained on the driver from labelled spans: windows of a bounded
sample of texts, with spans that the base rules find, spans of generated personal
data put between words, in more forms than the base rules know, and generated
strings that only look like it. On the executors each whole text is cut into
overlapping windows, and the LSTM runs over thousands of windows at a time. The
windows of a text are then reconciled globally: each character's tag scores are
those of the window in which it is farthest from an edge, and the CRF finds the
best tags of the whole text from all scores together, so that no span is cut
where two windows meet. Spans that the base rules find always stay; a decoded
span is added if it touches none of them, its score is above that of no
span, and its digits are as many as its kind's and pass its check digit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphmill.llm._text import slices

KINDS = ["email", "ip", "card", "phone"]
TAGS = len(KINDS) + 1
#: Characters of a window, and that neighbouring windows share.
WINDOW, OVERLAP = 192, 32
#: Symbols: padding, the ASCII characters, all others as one.
SYMBOLS = 130
HIDDEN = 8
#: Texts that the model is trained from, at most, and windows of each.
TRAIN_TEXTS, WINDOWS_PER_TEXT = 400, 5
#: How much better, in log units, an added span must be than none in its place.
MARGIN = 1.0
#: Letters and digits that an added span may be widened by, to either side, and its longest length in all.
WIDEN, LONGEST = 64, 160
#: Windows worked on at a time.
BATCH = 2048

# ---- base rules ---------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number's digits are taken whole, so a match can only start where a run of digits does
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _card(s: str) -> bool:
    digits = _digits(s)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start: leftmost, non-overlapping per kind; failing matches are dropped."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _card(m[0])]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- the model ----------------------------------------------------------------------------------


def symbols(text: str) -> np.ndarray:
    """A symbol per character, from 1 on."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (np.minimum(points, 128) + 1).astype(np.uint8)


def _squash(z: np.ndarray) -> np.ndarray:
    """To -1..1 by softsign, a sixth of the work of a hyperbolic tangent; its slope is (1 - |y|) squared."""
    return z / (1 + np.abs(z))


def _slope(y: np.ndarray) -> np.ndarray:
    return (1 - np.abs(y)) ** 2


class Tagger:
    """Parameters by name; per direction d in "fb": E (4H, symbols), U (4H, H), W (tags, H); bias and transitions."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h, self.p = hidden, {}
        for d in "fb":
            e = rng.normal(0, 0.5, (4 * hidden, SYMBOLS))
            e[hidden : 2 * hidden] += 1.0  # forget gates start open
            self.p |= {f"E{d}": e, f"U{d}": rng.normal(0, 0.5 / np.sqrt(hidden), (4 * hidden, hidden)), f"W{d}": rng.normal(0, 0.3, (TAGS, hidden))}
        self.p |= {"bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, d: str) -> dict:
        """States of one direction over x (time, batch), kept for the way back."""
        steps, n = x.shape
        h, out = self.h, {"a": np.empty((steps, 4 * self.h, n), np.float32), "c": np.empty((steps + 1, self.h, n), np.float32), "h": np.empty((steps + 1, self.h, n), np.float32)}
        out["c"][0] = out["h"][0] = 0
        for t in range(steps):
            z = self.p[f"E{d}"][:, x[t]] + self.p[f"U{d}"] @ out["h"][t]
            a = out["a"][t]
            a[:] = _squash(z)
            a[: 3 * h] = 0.5 * a[: 3 * h] + 0.5
            out["c"][t + 1] = a[h : 2 * h] * out["c"][t] + a[:h] * a[3 * h :]
            out["h"][t + 1] = a[2 * h : 3 * h] * _squash(out["c"][t + 1])
        return out

    def _back(self, x: np.ndarray, run: dict, dh: np.ndarray, d: str, grad: dict) -> None:
        """Gradients of one direction, given those of its outputs."""
        steps, n = x.shape
        h, dc, carry = self.h, np.zeros((self.h, n), np.float32), np.zeros((self.h, n), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g = (run["a"][t][k * h : (k + 1) * h] for k in range(4))
            tc = _squash(run["c"][t + 1])
            total = dh[t] + carry
            dc = dc + total * o * _slope(tc)
            gates = [dc * g * _slope(2 * i - 1), dc * run["c"][t] * _slope(2 * f - 1), total * tc * _slope(2 * o - 1)]
            dz = np.concatenate([*(0.5 * x for x in gates), dc * i * _slope(g)])
            grad[f"U{d}"] += dz @ run["h"][t].T
            np.add.at(grad[f"E{d}"].T, x[t], dz.T)
            carry = self.p[f"U{d}"].T @ dz
            dc = dc * f

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tags y for x, both (time, batch), and its gradients."""
        steps, n = x.shape
        runs = {"f": self._run(x, "f"), "b": self._run(x[::-1], "b")}
        hidden = {"f": runs["f"]["h"][1:], "b": runs["b"]["h"][1:][::-1]}
        emit = self.p["bias"][None, :, None] + sum(np.einsum("kh,thn->tkn", self.p[f"W{d}"], hidden[d]) for d in "fb")
        move = self.p["move"][:, :, None]
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0]
        for t in range(1, steps):
            s = ahead[t - 1][:, None] + move
            m = s.max(axis=0)
            ahead[t] = m + np.log(np.exp(s - m).sum(axis=0)) + emit[t]
        for t in range(steps - 2, -1, -1):
            s = move + (emit[t + 1] + behind[t + 1])[None]
            m = s.max(axis=1)
            behind[t] = m + np.log(np.exp(s - m[:, None]).sum(axis=1))
        m = ahead[-1].max(axis=0)
        z = m + np.log(np.exp(ahead[-1] - m).sum(axis=0))
        gold = np.take_along_axis(emit, y[:, None, :], axis=1).sum(axis=(0, 1)) + self.p["move"][y[:-1], y[1:]].sum(axis=0)
        demit = np.exp(ahead + behind - z)
        np.put_along_axis(demit, y[:, None, :], np.take_along_axis(demit, y[:, None, :], axis=1) - 1, axis=1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps):
            grad["move"] += np.exp(ahead[t - 1][:, None] + move + (emit[t] + behind[t])[None] - z).sum(axis=2)
        np.add.at(grad["move"], (y[:-1].ravel(), y[1:].ravel()), -1)
        grad["bias"] += demit.sum(axis=(0, 2))
        for d in "fb":
            grad[f"W{d}"] += np.einsum("tkn,thn->kh", demit, hidden[d])
            dh = np.einsum("kh,tkn->thn", self.p[f"W{d}"], demit)
            self._back(x if d == "f" else x[::-1], runs[d], dh if d == "f" else dh[::-1], d, grad)
        return float((z - gold).mean()), {k: v / n for k, v in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 3) -> None:
        """Adam over windows (window, time)."""
        rng = np.random.default_rng(seed)
        first, second, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                own = order[i : i + batch]
                _, grad = self.loss(np.ascontiguousarray(x[own].T), np.ascontiguousarray(y[own].T))
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                now = rate * (1 - 0.9 * step / total)
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def emissions(self, x: np.ndarray, gain: np.ndarray | None = None) -> np.ndarray:
        """Tag scores (time, tags, batch) of windows x (time, batch), without keeping the states.

        ``gain`` (time, batch) gets the best other tag's score over that of tag 0, step by step while they are at hand.
        """
        steps, n = x.shape
        h = self.h
        out = np.empty((steps, TAGS, n), np.float32)
        out[:] = self.p["bias"][None, :, None]
        z, cell, state = np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32), np.empty((h, n), np.float32)
        more, part = np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32)
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            e, u, w = self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"W{d}"]
            cell[:] = state[:] = 0
            for t in order:
                np.take(e, x[t], axis=1, out=z, mode="clip")
                np.matmul(u, state, out=more)
                z += more
                np.abs(z, out=more)
                more += 1
                z /= more
                gates = z[: 3 * h]
                gates *= 0.5
                gates += 0.5
                cell *= z[h : 2 * h]
                np.multiply(z[:h], z[3 * h :], out=part)
                cell += part
                np.abs(cell, out=part)
                part += 1
                np.divide(cell, part, out=state)
                state *= z[2 * h : 3 * h]
                out[t] += w @ state
                if gain is not None and d == "b":
                    np.maximum(out[t, 1], out[t, 2], out=gain[t])
                    for k in range(3, TAGS):
                        np.maximum(gain[t], out[t, k], out=gain[t])
                    gain[t] -= out[t, 0]
        return out

    def may_leave(self, gain: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Whether a place may have another tag than 0, given every place's gain; texts are from base[k] to base[k + 1] - 1.

        A stretch of other tags on the best path scores no less than tag 0 in its
        place. The most that a stretch can score is the sum of its gains, of the
        best moves inside it and of those into and out of it, which a stretch at
        an end of its text doesn't need. A place that no stretch of such a sum of
        0 or more goes over has tag 0. All stretches are tried at once by sums from
        the left: the least before a place and the greatest from it on.
        """
        move = self.p["move"].astype(np.float64)
        inside, enter, leave = (float(m.max() - move[0, 0]) for m in (move[1:, 1:], move[0, 1:], move[1:, 0]))
        worth = gain.astype(np.float64) + inside
        starts, ends = base[:-1], base[1:] - 1
        some = starts < ends
        worth[starts[some]] -= enter
        worth[ends[some] - 1] -= leave
        worth[ends] = -1e6  # places between texts
        upto = np.cumsum(worth)
        before = np.minimum.accumulate(upto - worth)
        after = np.maximum.accumulate(upto[::-1])[::-1]
        may = after - before - inside + enter + leave >= -1e-2  # room for rounding
        may[ends] = False
        return may

    def best_tags(self, emit: np.ndarray, first: np.ndarray, size: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """The best tags of runs of characters, given scores (character, tag); runs are at ``first`` and of ``size``.

        Before a run stands tag 0, unless it opens its text, and after it too,
        unless it closes it. Runs of similar sizes go step by step together.
        """
        move, tags = self.p["move"], np.zeros(len(emit), np.int8)
        order = np.argsort(-size, kind="stable")
        at = 0
        while at < len(order):
            n = int(size[order[at]])
            own = order[at : at + max(1, int(np.searchsorted(-size[order[at:]], -(n // 2), "left")))]
            at += len(own)
            starts, sizes = first[own], size[own]
            back = np.zeros((n, TAGS, len(own)), np.int8)
            score = emit[starts].T + np.where(opens[own], 0, move[0][:, None])
            active = np.searchsorted(-sizes, -np.arange(n), "left")
            for t in range(1, n):
                k = active[t]
                s = score[:, None, :k] + move[:, :, None]
                back[t, :, :k] = s.argmax(axis=0)
                score[:, :k] = s.max(axis=0) + emit[starts[:k] + t].T
            best = (score + np.where(closes[own], 0, move[:, 0][:, None])).argmax(axis=0)
            for t in range(n - 1, -1, -1):
                k = active[t]
                tags[starts[:k] + t] = best[:k]
                if t:
                    best[:k] = back[t][best[:k], np.arange(k)]
        return tags


# ---- windows ------------------------------------------------------------------------------------


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n characters: one at least."""
    return list(range(0, max(n - OVERLAP, 1), WINDOW - OVERLAP))


def tagged_spans(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(tag, start, end, margin) of each text's decoded spans; ``margin`` is their score over that of tag 0 in their place.

    First it is found out where a stretch of other tags can pay at all: most
    characters have tag 0 on every best path. The others come in short runs, for
    which the path is worked out.
    """
    edge, stride = OVERLAP // 2, WINDOW - OVERLAP
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(lengths + 1)))  # a place between texts parts them
    flat = symbols("\0".join([*texts, ""])) if texts else np.zeros(0, np.uint8)
    windows = -(-np.maximum(lengths - OVERLAP, 1) // stride)  # as by window_starts
    before = np.concatenate(([0], np.cumsum(windows)))
    of = np.repeat(np.arange(len(texts)), windows)
    offset = (np.arange(len(of)) - before[of]) * stride
    gain, scores = np.zeros(len(flat), np.float32), []
    for i in range(0, len(of), BATCH):
        own, start = of[i : i + BATCH], offset[i : i + BATCH]
        size = lengths[own] - start
        step = np.arange(WINDOW)[:, None]
        place = np.minimum(step + (base[own] + start), len(flat) - 1)
        x = flat[place]
        x[step >= size] = 0
        best = np.empty((WINDOW, len(own)), np.float32)
        scores.append(model.emissions(x, best))
        # of two windows, a character is farther from the edges in the one whose half of the overlap it is in
        held = (step >= np.where(start == 0, 0, edge)) & (step < np.where(size <= WINDOW, size, WINDOW - edge))
        gain[place[held]] = best[held]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    where = np.flatnonzero(model.may_leave(gain, base)) if texts else np.zeros(0, np.int64)
    if not len(where):
        return out
    text = np.searchsorted(base, where, "right") - 1
    own = where - base[text]
    window = np.clip((own - edge) // stride, 0, windows[text] - 1)
    step, row = own - window * stride, before[text] + window
    parts = np.searchsorted(row, np.arange(len(scores) + 1) * BATCH)
    emit = np.concatenate([s[step[a:b], :, row[a:b] - k * BATCH] for k, (s, a, b) in enumerate(zip(scores, parts[:-1], parts[1:], strict=True))])
    del scores
    first = np.flatnonzero(np.diff(where, prepend=where[0] - 2) != 1)
    size = np.diff(np.append(first, len(where)))
    opens = where[first] == base[text[first]]
    last = first + size - 1
    closes = where[last] == base[text[last] + 1] - 2
    tags = model.best_tags(emit, first, size, opens, closes)
    # of neighbouring places with the same tag the first and last
    turn = np.flatnonzero((np.diff(tags, prepend=0) != 0) | (np.diff(where, prepend=-2) != 1))
    ends = np.append(turn[1:], len(tags))
    move = model.p["move"]
    over = np.concatenate(([0.0], np.cumsum(np.take_along_axis(emit, tags[:, None].astype(np.int64), axis=1)[:, 0].astype(np.float64) - emit[:, 0])))
    for a, b in zip(turn.tolist(), ends.tolist(), strict=True):
        tag = int(tags[a])
        if tag:
            n = b - a
            moves = (n - 1) * float(move[tag, tag] - move[0, 0]) + float(move[0, tag] + move[tag, 0] - 2 * move[0, 0])
            k = int(text[a])
            start = int(where[a] - base[k])
            out[k].append((tag, start, start + n, float(over[b] - over[a]) + moves))
    return out


def _valid(kind: str, s: str) -> bool:
    """Whether a span's digits can be of its kind; nothing is asked of addresses of mail."""
    if kind == "email":
        return any(c.isalpha() for c in s)
    if any(c.isalpha() for c in s):
        return False
    if kind == "card":
        return _card(s)
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 9 <= len(_digits(s)) <= 15


def added_spans(text: str, found: list[tuple[int, int, int, float]], base: list[tuple[str, int, int]], margin: float = MARGIN) -> list[tuple[str, int, int]]:
    """Of decoded spans those to add, from and to the ends of words without marks around them.

    A word that goes on for more than ``WIDEN`` letters and digits beyond a span
    has none, and none is longer than ``LONGEST``. The work is linear in the text
    and the number of spans.
    """
    if not found:
        return []
    taken = np.zeros(len(text), bool)
    for _, a, b in base:
        taken[a:b] = True
    out: list[tuple[str, int, int]] = []
    for tag, a, b, over in found:
        if over < margin:
            continue
        while a < b and not (text[a].isalnum() or text[a] == "("):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] in "])"):
            b -= 1
        if a == b:
            continue
        lo, hi = max(0, a - WIDEN), min(len(text), b + WIDEN)
        while a > lo and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        while b < hi and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        whole = not (a == lo and a > 0 and text[a - 1].isalnum()) and not (b == hi and b < len(text) and text[b].isalnum())
        if whole and b - a <= LONGEST and (not out or a >= out[-1][2]) and not taken[a:b].any() and _valid(KINDS[tag - 1], text[a:b]):
            out.append((KINDS[tag - 1], a, b))
    return out


# ---- training data ------------------------------------------------------------------------------


def generated(rng: np.random.Generator) -> tuple[str, str]:
    """(kind, text) of invented personal data."""
    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))

    kind = KINDS[rng.integers(len(KINDS))]
    if kind == "email":
        at, dot = [("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", ".")][rng.integers(5)]
        return kind, f"{word()}{['.', '_', '', '+'][rng.integers(4)]}{word()}{at}{word()}{dot}{['com', 'org', 'net', 'example'][rng.integers(4)]}"
    if kind == "ip":
        return kind, [".", ".", "[.]"][rng.integers(3)].join(map(str, rng.integers(0, 256, 4)))
    if kind == "card":
        gap = ["", " ", "-", ".", "  "][rng.integers(5)]
        return kind, gap.join(digits(4) for _ in range(4))
    form = ["+{1} ({3}) {3}-{4}", "({3}) {3}-{4}", "{3}-{3}-{4}", "{3}.{3}.{4}", "+{2} {3} {3} {4}"][rng.integers(5)]
    return kind, re.sub(r"\{([0-9])\}", lambda m: digits(int(m[1])), form)


def lookalike(rng: np.random.Generator) -> str:
    """A string that isn't personal data: hexadecimal keys, versions, dates, times, sums and other numbers, marks."""
    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    kind = rng.integers(8)
    if kind < 3:
        return ["", '"', "token = ", "key="][rng.integers(4)] + "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, rng.integers(6, 48)))
    if kind == 3:
        return ["v", ""][rng.integers(2)] + ".".join(digits(1) for _ in range(rng.integers(2, 4)))
    if kind == 4:
        return ["{4}-{2}-{2}", "{2}.{2}.{4}", "{2}/{2}/{4}", "{2}:{2}:{2}"][rng.integers(4)].replace("{4}", digits(4)).replace("{2}", digits(2))
    if kind == 5:
        return ["$", "", "#"][rng.integers(3)] + f"{digits(rng.integers(1, 4))}{[',', '.', ''][rng.integers(3)]}{digits(rng.integers(2, 4))}"
    if kind == 6:
        return "".join("#*$%&|<>@+()[]-_"[i] for i in rng.integers(0, 16, rng.integers(2, 9)))
    return ["(at)", "[at]", "at", "dot", "@", "e.g.", "(see)", "www.page.com", "file_name.txt"][rng.integers(9)]


def training_windows(pieces: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of pieces of texts, most of them with generated spans or lookalikes put in between words."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for piece in pieces:
        kind, put, draw = None, "", rng.random()
        if draw < 0.55:
            kind, put = generated(rng)
        elif draw < 0.85:
            put = lookalike(rng)
        at = 0
        if put:
            gaps = [i for i, c in enumerate(piece) if c == " "] or [0]
            at = gaps[rng.integers(len(gaps))]
            piece = f"{piece[:at]} {put}{piece[at:]}"[:WINDOW]
        piece = piece[:WINDOW]
        tags = np.zeros(len(piece), np.int64)
        if kind:
            tags[at + 1 : at + 1 + len(put)] = KINDS.index(kind) + 1
        for other, a, b in base_spans(piece):
            tags[a:b] = KINDS.index(other) + 1
        for m in re.finditer(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])", piece):  # a card in form; whether it is one, the check digit says later
            tags[m.start() : m.end()] = KINDS.index("card") + 1
        x, y = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int64)
        x[: len(piece)], y[: len(piece)] = symbols(piece), tags
        xs.append(x)
        ys.append(y)
    return np.array(xs), np.array(ys)


#: For a corpus without any text to learn from.
_SPARE = ["The words of a text without personal data stand here, so that there is something between the spans. " * 3]


def train(pieces: list[str], epochs: int = 8, rounds: int = 2) -> Tagger:
    """A model fitted on windows of texts, in rounds.

    The texts' own personal data of forms that no base rule knows has no labels
    and would be learnt as none. So after a round the windows in which the model
    finds something that touches no base span are left out of the next.
    """
    given = [t for t in pieces if t.strip()] or _SPARE * 200
    model, sure = Tagger(), given
    for k in range(rounds):
        model.fit(*training_windows(sure, seed=11 + k), epochs=epochs if k == rounds - 1 else epochs // 2, seed=3 + k)
        if k < rounds - 1:
            base = map(base_spans, given)
            found = tagged_spans(model, given)
            sure = [t for t, own, f in zip(given, base, found, strict=True) if all(any(x < b and a < y for _, x, y in own) for _, a, b, _ in f)] or given
    return model


# ---- the operator -------------------------------------------------------------------------------


def _span_texts(model: Tagger, texts: list[str], margin: float) -> Iterator[list[tuple[str, int, int]]]:
    for text, found in zip(texts, tagged_spans(model, texts), strict=True):
        base = base_spans(text)
        yield base, sorted(base + added_spans(text, found, base, margin), key=lambda x: (KINDS.index(x[0]), x[1]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_texts: int = TRAIN_TEXTS, windows_per_text: int = WINDOWS_PER_TEXT, margin: float = MARGIN) -> DataFrame:
    """Per row of docs: its id, ``n_<kind>`` and ``base_sha256`` of the base spans, ``spans`` (all) and ``n_added``.

    The model is fitted on ``windows_per_text`` windows, at hashed places of the
    whole text, of ``train_texts`` different texts at most, those first in the
    order of their hash; it is then run over all characters of all texts. An
    added span's score is ``margin`` over that of none. Offsets are in code
    points, ends exclusive. A null text is empty and has no spans. Null ids and
    repeated rows are returned as they are; other columns are not. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the hashes first, so that a task sends a few numbers and not texts; equal texts are one
    hashed = docs.select(text.alias("t"), F.xxhash64(text).alias("h"))
    first = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(train_texts).collect()]
    place = f"cast(pmod(xxhash64(h, i), greatest(char_length(t) - {WINDOW} + 1, 1)) as int) + 1"
    cut = F.expr(f"transform(sequence(1, {max(1, windows_per_text)}), i -> substring(t, {place}, {WINDOW}))")
    drawn = hashed.where(F.col("h") <= (first[-1] if first else 0)).select("h", cut.alias("pieces")).groupBy("h").agg(F.min("pieces").alias("pieces"))
    sample = sorted(drawn.collect())
    # a short text's windows are all the same one
    pieces = [p for r in sample for p in dict.fromkeys(r["pieces"])]
    held = spark.sparkContext.broadcast(train(pieces).p)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger()
        model.p = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
            for i, j in slices(ends):
                counts, digests, spans, added = [[] for _ in KINDS], [], [], []
                for base, every in _span_texts(model, texts[i:j], margin):
                    for k, kind in enumerate(KINDS):
                        counts[k].append(sum(s[0] == kind for s in base))
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(every))
                    added.append(len(every) - len(base))
                arrays = [batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    schema = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
