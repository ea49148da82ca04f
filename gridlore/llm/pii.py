"""Personal data: base rules, and a character-level bidirectional LSTM with CRF transitions that adds spans which the rules don't cover.

Base rules (email, ip, card, phone; leftmost matches of each kind, not overlapping, those that fail their check dropped) are written so that their time grows with the text alone.
The network learns the look of the four kinds from labelled windows: windows of a bounded sample of documents with the rules' matches as labels, and the same windows with generated data in
other ways of writing (brackets for @ and dots, points or slashes between groups of digits, numbers without a plus) and with numbers that are no personal data. It is trained in numpy on
the driver: forward and backward through time and through the CRF's sums, Adam steps.

A span must hold a trigger (a digit, an @ or a bracketed "at"), so windows lie around triggers; a stretch without one can't hold a span. Windows overlap by half. Each is decoded by Viterbi; for a
whole text, pieces of a kind that windows cut are merged, spans grow to whole numbers and words, those that fail the kind's check or meet a base span go, and of the rest the set of non-overlapping ones
with the largest sum of scores stays (weighted interval scheduling).

Defined results: a null text is empty; empty texts and texts without triggers have no spans; positions are code points, ends exclusive; repeated rows and null ids are rows like any other; with no documents, or none
with a trigger, the network learns from generated data alone; an empty table gives no rows; other columns pass through, those of the output's names are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its start only: from within it can't match if it doesn't from there.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[\d@＠]|[\[({]\s?(?:at|AT)\s?[\])}]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)  # a local part can't hold this @
        at = text.find("@", at + 1)


def base_spans(text: str, checked: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind. Unchecked: whatever has the look."""
    out = [(s, e, 0) for s, e in _emails(text)]
    out += [(*m.span(), 1) for m in IP.finditer(text) if not checked or _octets(m[0].split("."))]
    out += [(*m.span(), 2) for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and (not checked or luhn(d))]
    out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


_NO = str.maketrans("", "", " .-/_–()")
_AT, _DOT = re.compile(r"\s*(?:[\[({]\s?(?:at|AT)\s?[\])}]|@)\s*"), re.compile(r"\s*[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s*|\s+dot\s+")
_PLAIN = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def holds(kind: int, s: str) -> bool:
    """Whether a span in any way of writing passes its kind's check."""
    if kind == 0:
        return len(s) <= 200 and bool(_PLAIN.fullmatch(_DOT.sub(".", _AT.sub("@", s))))
    if kind == 1:
        parts = re.split(r"\s*(?:[\[({]\.[\])}]|\.|,)\s*", s)
        return len(s) <= 60 and len(parts) == 4 and all(p and _digits(p) == p for p in parts) and _octets(parts)
    d, rest = _digits(s), s.lstrip("+").translate(_NO)
    if rest != d or len(s) > 2 * len(d) + 6:
        return False
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 and (len(s) > len(d) or d.startswith("00"))


@dataclass(frozen=True)
class Settings:
    width: int = 96  # characters in a window; half of them are shared with the next
    embed: int = 12
    hidden: int = 16
    sample_docs: int = 2_000  # at most so many documents give windows, those of the smallest hashed id ...
    windows_each: int = 3  # ... and at most so many windows each
    windows: int = 2_400  # learnt from, generated ones included
    epochs: int = 5
    batch: int = 48
    rate: float = 0.012
    seed: int = 42


#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
BARRED = -1e4


def _character(c: str) -> int:
    o = ord(c)
    if "0" <= c <= "9":
        return 2
    if 32 <= o < 127:
        return o - 28
    return 1 if c.isspace() else 3 if c.isdigit() else 100 if c.isalpha() else 101


_ASCII = np.array([_character(chr(o)) for o in range(128)], np.int16)
CHARACTERS = 102


def encoded(text: str) -> np.ndarray:
    o = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = _ASCII[np.minimum(o, 127)]
    for i in np.flatnonzero(o >= 127):
        ids[i] = _character(text[i])
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    """The network; p holds its parameters: two LSTMs over one table of characters, a linear layer, transitions and starts."""

    def __init__(self, s: Settings):
        r, h, self.s = np.random.default_rng(s.seed), s.hidden, s
        normal = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"table": normal(CHARACTERS, s.embed) * 3, "out": normal(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            b = np.zeros(4 * h, np.float32)
            b[h : 2 * h] = 1  # remember at first
            self.p |= {f"x{d}": normal(s.embed, 4 * h), f"h{d}": normal(h, 4 * h), f"b{d}": b}
        follows = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            follows[:, 2 + 2 * k] = BARRED
            follows[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.follows, self.starts = follows, np.where(np.arange(TAGS) % 2 * (np.arange(TAGS) > 0) + (np.arange(TAGS) == 0) > 0, 0, BARRED).astype(np.float32)

    def _pass(self, x, mask, d, keep=None):
        h = self.s.hidden
        rows = self.p["table"] @ self.p[f"x{d}"] + self.p[f"b{d}"]
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        state, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        for t in order:
            z = rows[x[t]] + state @ self.p[f"h{d}"]
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before = state, cell
            cell = (gates[:, h : 2 * h] * cell + gates[:, :h] * g) * mask[t]
            squashed = np.tanh(cell)
            out[t] = state = gates[:, 2 * h :] * squashed * mask[t]
            if keep is not None:
                keep[t] = *before, gates, g, squashed
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of each tag, (T, B, TAGS); x: character classes (T, B), mask: (T, B, 1), 0 behind a window's end."""
        both = np.concatenate([self._pass(x, mask, d, None if keep is None else keep.setdefault(d, {})) for d in "fb"], axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["out"] + self.p["bias"]

    def loss(self, x, mask, tags):
        """Mean negative log-likelihood of a window's tags, and its gradients."""
        keep, n = {}, x.shape[1]
        e = self.scores(x, mask, keep).astype(np.float64)
        step, first = (self.p["step"] + self.follows).astype(np.float64), (self.p["first"] + self.starts).astype(np.float64)
        alpha = [first + e[0]]
        for t in range(1, len(x)):
            alpha.append(np.where(mask[t] > 0, _sum_exp(alpha[-1][:, :, None] + step, 1) + e[t], alpha[-1]))
        log_z = _sum_exp(alpha[-1], 1)
        beta, de, dstep = np.zeros((n, TAGS)), np.zeros_like(e), np.zeros((TAGS, TAGS))
        gold = (first[tags[0]] + np.take_along_axis(e[0], tags[0][:, None], 1)[:, 0]).copy()
        every = np.arange(n)
        for t in range(len(x) - 1, -1, -1):
            de[t] = np.exp(alpha[t] + beta - log_z[:, None]) * mask[t]
            de[t][every, tags[t]] -= mask[t][:, 0]
            if t:
                m = mask[t][:, 0]
                ahead = e[t] + beta
                dstep += np.einsum("bij,b->ij", np.exp(alpha[t - 1][:, :, None] + step + ahead[:, None, :] - log_z[:, None, None]), m)
                np.add.at(dstep, (tags[t - 1], tags[t]), -m)
                gold += m * (step[tags[t - 1], tags[t]] + e[t][every, tags[t]])
                beta = np.where(mask[t] > 0, _sum_exp(step + ahead[:, None, :], 2), beta)
        d = (de / n).astype(np.float32)
        grads = {"step": (dstep / n).astype(np.float32), "first": d[0].sum(0), "bias": d.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", keep["both"], d), "table": np.zeros_like(self.p["table"])}
        dboth = d @ self.p["out"].T
        for i, k in enumerate("fb"):
            self._back(x, mask, k, dboth[:, :, i * self.s.hidden : (i + 1) * self.s.hidden], keep[k], grads)
        return float((log_z - gold).mean()), grads

    def _back(self, x, mask, d, dout, kept, grads):
        h, w = self.s.hidden, self.p[f"h{d}"]
        dstate, dcell, dw = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32), np.zeros_like(w)
        drows = np.zeros((CHARACTERS, 4 * h), np.float32)
        for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
            state, cell, gates, g, squashed = kept[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            ds = (dstate + dout[t]) * mask[t]
            dc = (dcell + ds * o * (1 - squashed**2)) * mask[t]
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dw += state.T @ dz
            np.add.at(drows, x[t], dz)
            dstate, dcell = dz @ w.T, dc * f
        grads |= {f"h{d}": dw, f"b{d}": drows.sum(0), f"x{d}": self.p["table"].T @ drows}
        grads["table"] += drows @ self.p[f"x{d}"].T

    def fit(self, windows: list[tuple[str, list[tuple[int, int, int]]]]) -> Tagger:
        """windows: (text, spans (start, end, kind)), texts of ``width`` characters at most."""
        r, s = np.random.default_rng(self.s.seed), self.s
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        n, total = 0, s.epochs * -(-len(windows) // s.batch)
        for _ in range(s.epochs):
            order = r.permutation(len(windows))
            for lo in range(0, len(order), s.batch):
                some = [windows[i] for i in order[lo : lo + s.batch]]
                x, mask = packed([encoded(t) for t, _ in some])
                tags = np.zeros(x.shape, np.int64)
                for b, (_, spans) in enumerate(some):
                    for start, end, kind in spans:
                        tags[start + 1 : end, b], tags[start, b] = 2 + 2 * kind, 1 + 2 * kind
                _, grads = self.loss(x, mask, tags)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                n += 1
                rate = s.rate * (1 - (n - 1) / total)
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    m, v = moments[k]
                    m[:] = 0.9 * m + 0.1 * g
                    v[:] = 0.99 * v + 0.01 * g * g
                    self.p[k] -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, windows: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """Viterbi: (start, end, kind, score) of each window's spans; score: how far its tags' scores are above those of O."""
        x, mask = packed(windows)
        e = self.scores(x, mask)
        step, best, back = self.p["step"] + self.follows, self.p["first"] + self.starts + e[0], []
        for t in range(1, len(x)):
            ways = best[:, :, None] + step
            back.append(np.where(mask[t] > 0, ways.argmax(1), np.arange(TAGS)))
            best = np.where(mask[t] > 0, ways.max(1) + e[t], best)
        tags = np.empty(x.shape, np.int64)
        tags[-1] = best.argmax(1)
        for t in range(len(x) - 1, 0, -1):
            tags[t - 1] = np.take_along_axis(back[t - 1], tags[t][:, None], 1)[:, 0]
        gain = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        out = []
        for b, w in enumerate(windows):
            row, spans = tags[: len(w), b], []
            for i in np.flatnonzero(row % 2 == 1):
                j = i + 1
                while j < len(row) and row[j] == row[i] + 1:
                    j += 1
                spans.append((int(i), int(j), int(row[i] - 1) // 2, float(gain[i:j, b].sum())))
            out.append(spans)
        return out


def packed(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Time first, filled up behind the ends."""
    x = np.zeros((max(map(len, windows)), len(windows)), np.int16)
    mask = np.zeros((*x.shape, 1), np.float32)
    for b, w in enumerate(windows):
        x[: len(w), b], mask[: len(w), b] = w, 1
    return x, mask


def window_starts(text: str, width: int) -> list[int]:
    """Starts of windows that hold every trigger with at least a quarter of the width on both sides, where the text goes on; neighbours share half."""
    out, until = [], -1
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - width // 4), min(len(text), m.end() + width // 4)
        if lo > until:
            out.append(lo)
            until = lo + width
        while hi > until:
            lo = out[-1] + width // 2
            out.append(lo)
            until = lo + width
    return out


def _whole(text: str, start: int, end: int, kind: int) -> tuple[int, int]:
    """Grown to the whole number or word it lies in, white space at the ends gone."""
    grows = str.isdigit if kind else LOCAL.__contains__
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    while start > 0 and grows(text[start - 1]):
        start -= 1
    while end < len(text) and grows(text[end]):
        end += 1
    if kind == 0:
        while end > start and text[end - 1] in ".%+-_":
            end -= 1
    if kind == 3 and start > 0 and text[start - 1] == "(" and ")" in text[start:end]:
        start -= 1
    return start, end


def _apart(text: str, start: int, end: int) -> bool:
    """No letter or digit touches the span, and no more digits follow behind one sign."""
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    return not (before[-1:].isalnum() or after[:1].isalnum() or (len(before) == 2 and text[start].isdigit() and before[0].isdigit() and before[1] in " .-/,") or (len(after) == 2 and after[1].isdigit() and after[0] in " .-/,"))


def reconciled(text: str, found: list[tuple[int, int, int, float, bool]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """found: (start, end, kind, score, cut by its window) over the whole text -> the spans to add."""
    pieces, merged = sorted(x for x in found if x[4]), []
    for s, e, k, score, _ in sorted(pieces, key=lambda x: (x[2], x[0])):
        if merged and merged[-1][2] == k and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]), k, max(score, merged[-1][3]))
        else:
            merged.append((s, e, k, score))
    best = {}
    for s, e, k, score in [x[:4] for x in found if not x[4]] + merged:
        s, e = _whole(text, s, e, k)
        if s < e and holds(k, text[s:e]) and _apart(text, s, e):
            best[s, e, k] = max(score, best.get((s, e, k), score))
    ends = np.maximum.accumulate([e for _, e, _ in base]) if base else []
    starts = [s for s, _, _ in base]
    free = [x for x in best if not (i := bisect_right(starts, x[1] - 1)) or ends[i - 1] <= x[0]]
    free.sort(key=lambda x: (x[1], x[0], x[2]))
    upto, stops = [(0.0, ())], [e for _, e, _ in free]
    for i, x in enumerate(free):
        sum_, chain = upto[bisect_right(stops, x[0], 0, i)]
        taken = (sum_ + max(best[x], 1e-3), (x, chain))
        upto.append(max(upto[-1], taken, key=lambda y: y[0]))
    out, chain = [], upto[-1][1]
    while chain:
        x, chain = chain
        out.append(x)
    return out[::-1]


WINDOWS_AT_ONCE = 1024


def spans_of(texts: list[str], tagger: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base and added spans of each text."""
    width = tagger.s.width
    base, found, todo = [base_spans(t) for t in texts], [[] for _ in texts], []

    def run():
        for (i, lo, ids), spans in zip(todo, tagger.decode([w[2] for w in todo])):
            n = len(texts[i])
            found[i] += [(lo + s, lo + e, k, score, (s == 0 and lo > 0) or (e == len(ids) and lo + e < n)) for s, e, k, score in spans]
        todo.clear()

    for i, t in enumerate(texts):
        for lo in window_starts(t, width):
            todo.append((i, lo, encoded(t[lo : lo + width])))
            if len(todo) == WINDOWS_AT_ONCE:
                run()
    if todo:
        run()
    return [(b, reconciled(t, f, b) if f else []) for t, f, b in zip(texts, found, base)]


def _written(r: random.Random, kind: int) -> str:
    """Generated personal data of a kind, often in a way that the base rules don't cover."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randrange(3, 9)))
    if kind == 0:
        at = r.choice(["@", "@", " @ ", " [at] ", "(at)", " (at) ", "[at]", " {at} "])
        dot = r.choice([".", ".", " [dot] ", "(dot)", " dot ", "[.]"]) if at != "@" else r.choice([".", "[.]", " dot "])
        return word() + r.choice(["", "." + word(), n(2), "." + n(2)]) + at + dot.join([word() + r.choice(["", n(1)]), r.choice(["com", "org", "net", "example" + dot + "com"])])
    if kind == 1:
        return r.choice([".", ".", "[.]", " . ", "(.)"]).join(str(r.randrange(1, 256)) for _ in range(4))
    if kind == 2:
        d = n(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice(["", " ", "-", ".", "/", " - ", "_", "  "]).join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = n(3), n(3), n(4)
    return r.choice([f"+1 ({a}) {b}-{c}", f"+{n(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"00{n(2)} {a} {b}{c}", f"{a}/{b}-{c}"])


def _number(r: random.Random) -> str:
    """A number that is no personal data."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    return r.choice([f"20{n(2)}-0{r.randrange(1, 10)}-1{n(1)}", f"{n(2)}:{n(2)}:{n(2)}", f"${n(1)},{n(3)}.{n(2)}", f"v{n(1)}.{n(2)}.{n(1)}", "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(16, 41))), n(r.randrange(1, 9)), f"{n(5)}-{n(4)}", f"No. {n(6)}", f"({n(4)})", f"{n(2)}.{n(2)}", n(r.randrange(20, 30)), f"@{n(1)} pm", "(at) last", f"{n(3)}, {n(3)}, {n(3)}"])


def lessons(windows: list[str], s: Settings) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """At most ``s.windows`` labelled windows: the sample's own, and the same with generated data put in."""
    r, out = random.Random(s.seed), []
    mine = [(w, base_spans(w, checked=False)) for w in windows[: s.windows // 3]]
    for w, spans in mine:
        flat, until = [], 0
        for x in spans:  # tags don't overlap
            if x[0] >= until:
                flat.append(x)
                until = x[1]
        out.append((w, flat))
    carriers = [re.sub(r"[0-9@+]", "", w) for w in windows] or ["the words of a text that says little, and then some more of them"]
    while len(out) < s.windows:
        text, spans = r.choice(carriers)[: s.width // 2], []
        for _ in range(r.choice([0, 1, 1, 1, 2])):
            cuts = [0, len(text), *(m.end() for m in re.finditer(r"\s", text))]
            at = max([e for _, e, _ in spans], default=0)
            at = r.choice([c for c in cuts if c >= at])
            kind = r.randrange(-1, len(KINDS))
            piece = _number(r) if kind < 0 else _written(r, kind)
            lead, trail = ("" if at == 0 or text[at - 1].isspace() else " "), r.choice(["", " ", " ", ". ", ", ", "$$$ ", "!! "])
            text = text[:at] + lead + piece + trail + text[at:]
            if kind >= 0:
                spans.append((at + len(lead), at + len(lead) + len(piece), kind))
        spans = [x for x in spans if x[1] <= s.width]
        out.append((text[: s.width] if not spans or len(text) <= s.width else text[: max(s.width, spans[-1][1])], spans))
    return out


def train(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Learn from windows of at most ``s.sample_docs`` documents; no more than their windows come to the driver."""
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(s.seed))
    chosen = docs.select(order.alias("_h")).distinct().orderBy("_h").limit(s.sample_docs)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for h, t in zip(f["_h"], f["_t"]):
                starts = window_starts(t, s.width)[: s.windows_each - 1] + [0]
                yield pd.DataFrame({"_h": h, "w": [t[a : a + s.width] for a in starts]})

    rows = docs.select(order.alias("_h"), F.col(text_col).cast("string").alias("_t")).where("_t <> ''").join(F.broadcast(chosen), "_h")
    windows = rows.mapInPandas(cut, "_h long, w string").orderBy("_h", "w").limit(s.sample_docs * s.windows_each).select("w").toPandas()["w"].tolist()
    windows = list(dict.fromkeys(windows))
    random.Random(s.seed).shuffle(windows)
    return Tagger(s).fit(lessons(windows, s))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end by start, then kind) and n_added; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # some 10,000 numbers
    kinds = ", ".join(f"n_{k} long" for k in KINDS)

    @F.pandas_udf(f"{kinds}, base_sha256 string, spans string, n_added long")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for base, added in spans_of([t or "" for t in texts], shared.value):
            every = sorted(base + added, key=lambda x: (x[0], x[2], x[1]))
            rows.append([*(sum(k == i for _, _, k in base) for i in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(added)])
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    name = f"_found_{uuid.uuid4().hex[:8]}"
    out = docs.withColumn(name, of(F.col(text_col).cast("string")))
    columns = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    return out.withColumns({c: F.col(f"{name}.{c}") for c in columns}).drop(name)
