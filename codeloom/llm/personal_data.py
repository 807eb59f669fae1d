"""Personal data (9): exact patterns, and a character BiLSTM with CRF transitions trained in numpy.

Patterns give the base spans. The network learns from labelled spans: the base ones, the same written
otherwise (a phone without its ``+``, ``name [at] host``, ...; see ``rewritten``), and credentials that
stand beside a telling name (``password=...``) or have a known shape. An added span holds a digit, an ``@`` or
a written ``at``. The network reads every window of every text that such a span can touch (windows overlap by half), and finds
such forms also where no pattern or name tells them. Windows are decoded alone; their spans are
reconciled over the whole text: those cut by a window's edge give way to the neighbour that sees them whole
or are joined with the neighbour's piece, and of overlapping ones the surest stays. Spans that
the network finds beside the base ones are added.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fields, map_rows
from codeloom.session import staged

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")  # the last one has no pattern: only the network finds it

# The patterns and limits of the base spans.
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
_NOT_DIGIT = re.compile("[^0-9]")
# Credentials to learn from: the value beside a telling name, and access keys of a known shape.
_SECRET = re.compile(r"""(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*["']?([^\s"']{8,})"""
                     r"|\b(AKIA[0-9A-Z]{16})\b", re.I)

_CREDENTIAL = re.compile("[A-Za-z0-9+/_-]")
_TELLS = re.compile(r"[0-9@]|[\[( ]at[\]) ]")  # what an added span holds, as each kind does

WINDOW, STRIDE = 96, 48
HIDDEN, EMBEDDING = 24, 12
LABELS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
SAMPLE = 2_500  # windows the network is trained on: those with the lowest hash of their content
STEPS, BATCH, RATE = 600, 64, 0.025
SURE = 0.8  # probability of each character's label from which a span is added
LEAST = 6  # characters of an added span

# Character classes: 0 pads, 1 is any other character.
_CLASSES = np.ones(128, np.uint8)
for _letters, _class in ((string.ascii_lowercase, 2), (string.ascii_uppercase, 3), (string.digits, 4)):
    for _c in _letters:
        _CLASSES[ord(_c)] = _class
for _i, _c in enumerate("@.-+() \n_%=\"':/,;#"):
    _CLASSES[ord(_c)] = 5 + _i
N_CLASSES = 5 + 18 + 1
_FOREIGN = 23  # letters beyond ASCII


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans ``(start, kind, end)`` that pass, and matches that fail their check, both sorted."""
    found, failed = [], []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            before = text[done:at]
            start = done + len(before.rstrip(_LOCAL))
            m = _DOMAIN.match(text, at) if start < at else None
            if m:
                found.append((start, 0, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if _MARK.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            for m in pattern.finditer(text):
                body = m.group()
                if kind == 1:
                    good = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in body.split("."))
                else:
                    digits = _NOT_DIGIT.sub("", body)
                    good = 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15
                (found if good else failed).append((m.start(), kind, m.end()))
    return sorted(found), sorted(failed)


# Beside its class a character has the shape of its token (a run without white space): which of digits, lower
# and upper case letters it holds, and how long it is. Both are packed into one number, the class in the low bits.
CLASS_BITS = 5
_CLASS = (1 << CLASS_BITS) - 1
_LENGTHS = np.array([4, 8, 12, 16, 20, 30])  # first lengths of the classes of length but the first
N_SHAPES = 8 * (len(_LENGTHS) + 1)


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(points), 1, np.uint16)
    plain = points < 128
    out[plain] = _CLASSES[points[plain]]
    out[points >= 0xC0] = _FOREIGN
    blank = (points <= 0x20).astype(np.int64)
    token = np.cumsum(blank)  # a token and the blank before it have one number
    size = np.bincount(token, 1 - blank)
    shape = np.searchsorted(_LENGTHS, size, "right")
    for bit, one in ((1, 4), (2, 2), (4, 3)):
        shape = shape + np.where(np.bincount(token, out == one) > 0, bit * (len(_LENGTHS) + 1), 0)
    return out | np.where(blank > 0, 0, shape[token] << CLASS_BITS).astype(np.uint16)


_WRITTEN_AT = re.compile(r"[\[( ]at[\]) ]")
_IN_CREDENTIAL = np.isin(np.arange(_CLASS + 1), [2, 3, 4, *(_CLASSES[ord(c)] for c in "+/_-")])


def marked_windows(classes: np.ndarray, text: str | None = None) -> np.ndarray:
    """Starts of the windows, on a grid of ``STRIDE``, that hold a digit or an ``@``.

    With the ``text``, all windows from which a span can be added: also those that hold an ``at`` between blanks or brackets,
    or a part of a credential with a digit further on, to which a span would be drawn out.
    """
    plain = classes & _CLASS
    marks = np.flatnonzero((plain == 4) | (plain == 5))
    if text is not None:
        written = [m.start() for m in _WRITTEN_AT.finditer(text)]
        inside = _IN_CREDENTIAL[plain]
        run = np.cumsum(~inside)  # a run has the number of the character before it
        far = inside & (np.bincount(run, plain == 4) > 0)[run] if len(run) else inside
        marks = np.unique(np.concatenate((marks, np.array([i for w in written for i in (w, w + 3)], np.int64), np.flatnonzero(far))))
    if not len(marks):
        return marks
    block = np.unique(marks // STRIDE)
    starts = np.unique(np.concatenate((block, np.maximum(block - 1, 0)))) * STRIDE
    return starts


def cut(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate((classes, np.zeros(WINDOW, classes.dtype)))
    return padded[starts[:, None] + np.arange(WINDOW)[None, :]]


@dataclass
class Tagger:
    """Weights by name; ``emissions`` and ``backward`` are the network, the rest is the CRF."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 7) -> Tagger:
        rnd = np.random.default_rng(seed)
        w = {"embed": rnd.normal(0, 0.3, (N_CLASSES, EMBEDDING)), "shape": rnd.normal(0, 0.3, (N_SHAPES, EMBEDDING)), "out": rnd.normal(0, 0.2, (2 * HIDDEN, LABELS)),
             "bias": np.zeros(LABELS), "trans": np.zeros((LABELS, LABELS))}
        for side in "fb":
            w[f"x{side}"] = rnd.normal(0, 0.25, (EMBEDDING, 4 * HIDDEN))
            w[f"h{side}"] = rnd.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            w[f"c{side}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        return Tagger({k: v.astype(np.float32) for k, v in w.items()})

    def _lstm(self, x: np.ndarray, keep: list | None) -> np.ndarray:
        """States of both directions, which run side by side: the second over the reversed texts."""
        n, t, _ = x.shape
        z_all = np.stack([x @ self.w["xf"] + self.w["cf"], (x @ self.w["xb"] + self.w["cb"])[:, ::-1]]).transpose(2, 0, 1, 3)
        # Of the gates a sigmoid is wanted, of the rest a hyperbolic tangent: one is the other, scaled.
        half = np.r_[np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(x.dtype)
        z_all, step = z_all * half, np.stack([self.w["hf"], self.w["hb"]]) * half
        h = c = np.zeros((2, n, HIDDEN), x.dtype)
        out = np.empty((t, 2, n, HIDDEN), x.dtype)
        for s in range(t):
            a = np.tanh(z_all[s] + h @ step)
            gates, g = a[..., :3 * HIDDEN] * 0.5 + 0.5, a[..., 3 * HIDDEN:]
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN:2 * HIDDEN], gates[..., 2 * HIDDEN:]
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[s] = h
            if keep is not None:
                keep.append((i, f, o, g, before, c_before, tc))
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2)

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x = self.w["embed"][ids & _CLASS] + self.w["shape"][ids >> CLASS_BITS]
        states: list | None = [] if keep is not None else None
        hidden = self._lstm(x, states)
        if keep is not None:
            keep.update(x=x, hidden=hidden, states=states)
        e = hidden @ self.w["out"] + self.w["bias"]
        return e + np.where((ids == 0)[:, :, None] & (np.arange(LABELS) > 0), np.float32(-1e4), np.float32(0))

    def _passes(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums of the CRF, and the log of the total."""
        t, trans = e.shape[1], self.w["trans"]
        weight = np.exp(trans - trans.max())

        def add(v: np.ndarray, matrix: np.ndarray) -> np.ndarray:
            top = v.max(axis=1, keepdims=True)
            return np.log(np.exp(v - top) @ matrix + 1e-30) + top + trans.max()

        ahead, back = np.empty_like(e), np.empty_like(e)
        ahead[:, 0] = e[:, 0]
        back[:, -1] = 0
        for s in range(1, t):
            ahead[:, s] = add(ahead[:, s - 1], weight) + e[:, s]
        for s in range(t - 2, -1, -1):
            back[:, s] = add(back[:, s + 1] + e[:, s + 1], weight.T)
        top = ahead[:, -1].max(axis=1, keepdims=True)
        total = np.log(np.exp(ahead[:, -1] - top).sum(axis=1)) + top[:, 0]
        return ahead, back, total

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels by Viterbi, and the probability of each of them at its place."""
        e = self.emissions(ids)
        ahead, back, total = self._passes(e)
        n, t, _ = e.shape
        value, prior = e[:, 0], np.empty((n, t, LABELS), np.int8)
        for s in range(1, t):
            both = value[:, :, None] + self.w["trans"][None]
            prior[:, s] = both.argmax(axis=1)
            value = both.max(axis=1) + e[:, s]
        labels = np.empty((n, t), np.int64)
        labels[:, -1] = value.argmax(axis=1)
        rows = np.arange(n)
        for s in range(t - 1, 0, -1):
            labels[:, s - 1] = prior[rows, s, labels[:, s]]
        log = (ahead + back)[rows[:, None], np.arange(t)[None, :], labels] - total[:, None]
        return labels, np.exp(np.minimum(log, 0))

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of ``gold``."""
        keep: dict = {}
        e = self.emissions(ids, keep)
        ahead, back, total = self._passes(e)
        n, t, _ = e.shape
        unary = np.exp(np.minimum(ahead + back - total[:, None, None], 0))
        unary[np.arange(n)[:, None], np.arange(t)[None, :], gold] -= 1
        d_e = (unary / n).astype(np.float32)
        d_e[ids == 0] = 0
        trans = self.w["trans"]
        d_trans = np.zeros_like(trans)
        for s in range(1, t):
            joint = ahead[:, s - 1, :, None] + trans + (e[:, s] + back[:, s])[:, None, :] - total[:, None, None]
            d_trans += np.exp(np.minimum(joint, 0)).sum(axis=0)
        np.subtract.at(d_trans, (gold[:, :-1], gold[:, 1:]), 1)
        grads = {"trans": d_trans / n, "bias": d_e.sum(axis=(0, 1)),
                 "out": np.tensordot(keep["hidden"], d_e, axes=((0, 1), (0, 1)))}
        d_hidden = d_e @ self.w["out"].T
        d_out = np.stack([d_hidden[:, :, :HIDDEN], d_hidden[:, ::-1, HIDDEN:]]).transpose(2, 0, 1, 3)
        back_step = np.stack([self.w["hf"].T, self.w["hb"].T])
        d_h = d_c = np.zeros((2, n, HIDDEN), d_e.dtype)
        d_step, d_z_all = np.zeros((2, HIDDEN, 4 * HIDDEN), d_e.dtype), np.empty((t, 2, n, 4 * HIDDEN), d_e.dtype)
        for s in range(t - 1, -1, -1):
            i, f, o, g, before, c_before, tc = keep["states"][s]
            d_h = d_h + d_out[s]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z = np.concatenate((d_c * g * i * (1 - i), d_c * c_before * f * (1 - f),
                                  d_h * tc * o * (1 - o), d_c * i * (1 - g * g)), axis=2)
            d_z_all[s] = d_z
            d_step += before.transpose(0, 2, 1) @ d_z
            d_h, d_c = d_z @ back_step, d_c * f
        d_x = np.zeros_like(keep["x"])
        for k, side in enumerate("fb"):
            d_z = d_z_all[::-1 if k else 1, k].transpose(1, 0, 2)
            grads[f"h{side}"] = d_step[k]
            grads[f"c{side}"] = d_z.sum(axis=(0, 1))
            grads[f"x{side}"] = np.tensordot(keep["x"], d_z, axes=((0, 1), (0, 1)))
            d_x += d_z @ self.w[f"x{side}"].T
        for name, at in (("embed", ids & _CLASS), ("shape", ids >> CLASS_BITS)):
            grads[name] = np.zeros_like(self.w[name])
            np.add.at(grads[name], at, d_x)
        return grads

    def fit(self, ids: np.ndarray, gold: np.ndarray) -> Tagger:
        """``STEPS`` steps of Adam on batches in a fixed order, with a falling rate."""
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        rnd, order = np.random.default_rng(11), np.zeros(0, np.int64)
        for step in range(1, STEPS + 1):
            if len(order) < min(BATCH, len(ids)):
                order = rnd.permutation(len(ids))
            batch, order = order[:BATCH], order[BATCH:]
            rate = RATE * (1 - step / (STEPS + 1))
            for k, g in self.gradients(ids[batch], gold[batch]).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def gold_labels(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """One label per character; where kinds overlap the one listed first stays."""
    out = np.zeros(n, np.uint8)
    for start, kind, end in sorted(spans, key=lambda s: -s[1]):
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def labelled_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans to learn from: base spans, numbers that only lack a card's check digit (their shape is the
    same; where they are found the check bars them), and credentials."""
    found, failed = base_spans(text)
    cards = [(s, k, e) for s, k, e in failed if k == 2 and 12 <= len(_NOT_DIGIT.sub("", text[s:e])) <= 19]
    secrets = [(*m.span(1 if m[1] else 2), m) for m in _SECRET.finditer(text)]
    more = cards + [(s, 4, e) for s, e, _ in secrets]
    return sorted(found + [(s, k, e) for s, k, e in more if all(e <= a or s >= b for a, _, b in found)])


def _otherwise(piece: str, kind: int, form: int) -> str:
    """A span's text as people write it to avoid a pattern, or by habit."""
    if kind == 0:
        name, _, host = piece.partition("@")
        at, dot = ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."))[form % 3]
        return name + at + host.replace(".", dot)
    if kind == 1:
        return piece.replace(".", ("[.]", "-", " . ")[form % 3])
    if kind == 2:
        digits = _NOT_DIGIT.sub("", piece)
        return (".", "/", "  ")[form % 3].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        local = piece.lstrip("+").partition(" ")[2] or piece.lstrip("+")
        return (piece.lstrip("+"), local, "-".join(re.findall("[0-9]+", local)))[form % 3]
    # Another credential of the same make.
    noise = hashlib.sha512(f"{form}:{piece}".encode("utf-8", "surrogatepass")).digest()
    if piece.upper() == piece:
        return "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[b % 32] for b in noise[:len(piece)])
    return noise.hex()[:max(12, len(piece) + form % 9 - 4)]


def rewritten(text: str, spans: list[tuple[int, int, int]], salt: int = 0) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with every span written otherwise, in a form that the span's own text and ``salt`` decide, and
    the new spans."""
    out, found, done, size = [], [], 0, 0
    for s, kind, e in spans:
        if s < done:
            continue
        piece = _otherwise(text[s:e], kind, crc32(text[s:e].encode("utf-8", "surrogatepass")) + salt)
        out += [text[done:s], piece]
        size += s - done
        found.append((size, kind, size + len(piece)))
        done, size = e, size + len(piece)
    return "".join([*out, text[done:]]), found


def joined_pieces(pieces: list[tuple[int, int, int, bool, bool, float]]) -> list[tuple[float, int, int, int]]:
    """Spans ``(-probability, start, kind, end)`` of pieces ``(start, kind, end, goes on before, goes on
    after, probability)`` that windows cut: overlapping ones of a kind are one, if it ends on both sides."""
    out: list[tuple[float, int, int, int]] = []
    for kind in range(len(KINDS)):
        own = sorted(p for p in pieces if p[1] == kind)
        while own:
            start, _, end, before, after, p = own.pop(0)
            while own and own[0][0] < end:
                s, _, e, b, a, q = own.pop(0)
                before = before and (b or s > start)
                after = a if e > end else after and (a or e < end)
                end, p = max(end, e), min(p, q)
            if not before and not after and end - start >= LEAST:
                out.append((-p, start, kind, end))
    return out


def read_windows(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The network's sure spans ``(start, kind, end)`` of each text, reconciled over its windows."""
    classes = [classes_of(t) for t in texts]
    starts = [marked_windows(c, t) for c, t in zip(classes, texts)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owners = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    if not len(owners):
        return found
    begins = np.concatenate(starts)
    spans: dict[int, list[tuple[float, int, int, int]]] = {}
    pieces: dict[int, list[tuple[int, int, int, bool, bool, float]]] = {}
    read = set(zip(owners.tolist(), begins.tolist()))
    while len(owners):
        wanted: set[tuple[int, int]] = set()
        for at in range(0, len(owners), 2048):  # windows whose states are held at a time
            part = slice(at, at + 2048)
            ids = np.concatenate([cut(classes[o], begins[part][owners[part] == o]) for o in np.unique(owners[part])])
            labels, sure = tagger.decode(ids)
            for w in np.flatnonzero((labels > 0).any(axis=1)).tolist():
                o, begin, own = int(owners[at + w]), int(begins[at + w]), labels[w]
                heads = np.flatnonzero((own > 0) & (np.r_[0, own[:-1]] != own) & ((own % 2 == 1) | (np.r_[0, (own[:-1] + 1) // 2] != (own + 1) // 2)))
                for s in heads.tolist():
                    kind = int(own[s] - 1) // 2
                    e = s + 1
                    while e < WINDOW and own[e] == 2 + 2 * kind:
                        e += 1
                    if (p := float(sure[w, s:e].min())) < SURE:
                        continue
                    before, after = s == 0 and begin > 0, e == WINDOW and begin + e < len(classes[o])
                    if before or after:
                        pieces.setdefault(o, []).append((begin + s, kind, begin + e, before, after, p))
                        wanted |= {(o, begin - STRIDE)} if before else set()
                        wanted |= {(o, begin + STRIDE)} if after else set()
                    elif e - s >= LEAST:
                        spans.setdefault(o, []).append((-p, begin + s, kind, begin + e))
        # Windows without a mark into which a piece goes on are read too.
        more = sorted(wanted - read)
        read |= wanted
        owners, begins = np.array([o for o, _ in more], np.int64), np.array([b for _, b in more], np.int64)
    for o, own in pieces.items():
        spans.setdefault(o, []).extend(joined_pieces(own))
    for o, own in spans.items():
        taken: list[tuple[int, int, int]] = []
        for _, s, kind, e in sorted(own):
            if all(e <= a or s >= b for a, _, b in taken):
                taken.append((s, kind, e))
        found[o] = sorted(taken)
    return found


def whole_credentials(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of kind ``secret`` drawn out to the whole run of letters, digits and ``+/_-`` that they stand in, once each."""
    out = []
    for s, kind, e in spans:
        if KINDS[kind] == "secret":
            while s and _CREDENTIAL.match(text[s - 1]):
                s -= 1
            while e < len(text) and _CREDENTIAL.match(text[e]):
                e += 1
        if not out or s >= out[-1][2]:
            out.append((s, kind, e))
    return out


def find_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """Base and all spans of each text. What the network adds overlaps no base span, and no match
    of its own kind that failed the kind's check."""
    out = []
    for text, (base, failed), more in zip(texts, map(base_spans, texts), read_windows(tagger, texts)):
        more = whole_credentials(text, more)
        added = [(s, kind, e) for s, kind, e in more if all(e <= a or s >= b for a, _, b in base) and all(
            e <= a or s >= b for a, k, b in failed if k == kind) and _TELLS.search(text, s, e)]
        out.append((base, sorted(base + added)))
    return out


def train(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Tagger:
    """Train on the ``sample`` different marked windows with the lowest hash of their content.

    All rows compete, copies of a window as one, each as it stands and with its spans rewritten; at
    most ``sample`` windows reach the driver. The fit is deterministic. Null and empty texts teach
    nothing; long texts are read whole; without any window the network stays as it begins.
    """

    def windows(texts: list) -> list | None:
        out: list[list] = [[], [], []]
        for body in texts:
            spans = labelled_spans(body)
            for words, own in [(body, spans)] + [rewritten(body, spans, salt) for salt in range(3) if spans]:
                classes = classes_of(words)
                starts = marked_windows(classes)
                if not len(starts):
                    continue
                gold = cut(gold_labels(len(classes), own), starts)
                for ids, labels in zip(cut(classes, starts), gold):
                    out[0].append(hashlib.blake2b(ids.tobytes() + labels.tobytes(), digest_size=8).digest())
                    out[1].append(ids.tobytes())
                    out[2].append(labels.tobytes())
        return out if out[0] else None

    rows = df.filter(F.col(text).rlike("[0-9@]")).select(text)
    marked = map_rows(rows, windows, fields("hash binary, ids binary, labels binary"))
    # Written first: so each task's lowest windows meet in a task and not on the driver.
    found = staged(marked.distinct().orderBy("hash", "ids").limit(sample), "windows").collect()
    found.sort(key=lambda r: (r["hash"], r["ids"]))
    tagger = Tagger.fresh()
    if not found:
        return tagger
    ids = np.stack([np.frombuffer(r["ids"], np.uint16) for r in found]).astype(np.int64)
    gold = np.stack([np.frombuffer(r["labels"], np.uint8) for r in found]).astype(np.int64)
    # A window that begins inside a span starts as one.
    gold[:, 0] = np.where((gold[:, 0] > 0) & (gold[:, 0] % 2 == 0), gold[:, 0] - 1, gold[:, 0])
    return tagger.fit(ids, gold)


_SPANS = "array<struct<start: int, kind: string, end: int>>"


def _named(spans: list) -> list[dict]:
    return [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]


def find(df: DataFrame, tagger: Tagger, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``(key, base, spans)``, one for each row of ``df``, in place.

    ``base`` are the patterns' spans, ``spans`` all of them, by start and then kind, in code points
    with the end exclusive. Kind ``secret`` (credentials) is among the added ones only. Null and empty texts have none; long texts are read whole; repeated rows and null keys give a row
    each; an empty table gives an empty result; other columns are not read. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    def kernel(keys: list, texts: list) -> list:
        found = find_spans(shared.value, [t or "" for t in texts])
        return [keys, [_named(b) for b, _ in found], [_named(a) for _, a in found]]

    return map_rows(df.select(key, text), kernel, fields(f"`{key}` {kind}, base {_SPANS}, spans {_SPANS}"))


def redact(df: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """``df`` with each span of ``text`` replaced by its kind in square brackets; null stays null.

    Overlapping spans become one, named after the first. All columns and rows stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    at = df.columns.index(text)

    def hidden(body: str, spans: list) -> str:
        out, done = [], 0
        for s, kind, e in spans:
            if s >= done:
                out += [body[done:s], f"[{KINDS[kind].upper()}]"]
            done = max(done, e)
        return "".join([*out, body[done:]])

    def kernel(*columns: list) -> list:
        bodies = columns[at]
        found = find_spans(shared.value, [t or "" for t in bodies])
        new = [None if t is None else hidden(t, spans) for t, (_, spans) in zip(bodies, found)]
        return [*columns[:at], new, *columns[at + 1:]]

    return map_rows(df, kernel, df.schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
