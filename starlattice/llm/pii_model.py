"""Boosted trees for candidates of personal data: labelled sentences, fitting, calibration.

Sentences are written around a thing that is known to be personal or not (a private number, an order number, a
version, a digest ...). The label says what was written, not how it looks: the same digits stand in both classes, some
contexts are left out and some mislead, so the trees learn how far shape and context can be trusted. Everything runs on
the driver over a fixed number of sentences; what it gives is a list of small trees and a threshold for each kind.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Base kinds in their fixed order, then what only the method adds.
KINDS = ("email", "ip", "card", "phone", "secret")
FEATURES = (
    "kind", "digits", "letters", "length", "luhn", "plus", "paren", "dots", "dashes", "blanks", "groups", "longest", "octets", "variety", "spelled",
    "said_phone", "said_card", "said_mail", "said_net", "said_secret", "said_other", "assigned", "glued",
)
# What the text before a candidate may say, as pattern alternatives shared with the SQL form.
SAID = {
    "said_phone": r"\b(?:phone|call|tel|telephone|mobile|cell|fax|whatsapp|sms|text|ring|dial)\b",
    "said_card": r"\b(?:card|visa|mastercard|amex|credit|debit|cc|payment|pan)\b",
    "said_mail": r"\b(?:e-?mail|mail|contact|write|reach)\b",
    "said_net": r"\b(?:ip|host|server|address|from|login|client|ping)\b",
    "said_secret": r"(?:token|secret|password|passwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|bearer|credential)",
    "said_other": r"\b(?:isbn|order|invoice|version|v|ticket|serial|sku|id|no|nr|ref|tracking|commit|sha|md5|hash|checksum|build|release|section|page|lot)\b",
}
SENTENCES, ROUNDS, DEPTH, RATE, PRECISION, WINDOW = 8000, 40, 4, 0.3, 0.96, 24


@dataclass
class Ensemble:
    start: float
    trees: list
    thresholds: dict[str, float]

    def score(self, x: dict[str, float]) -> float:
        total = self.start
        for node in self.trees:
            while not isinstance(node, float):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            total += node
        return total


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return bool(digits) and total % 10 == 0


def describe(kind: str, text: str, start: int, end: int) -> dict[str, float]:
    """The features of a candidate, as the SQL expressions give them."""
    span, before, after = text[start:end], text[max(0, start - WINDOW) : start], text[end : end + 4]
    digits = re.sub("[^0-9]", "", span)
    groups = [g for g in re.split("[^0-9]+", span) if g]
    out = {
        "kind": KINDS.index(kind) + 1.0, "digits": float(min(len(digits), 99)), "letters": float(min(len(re.sub("[^A-Za-z]", "", span)), 99)), "length": float(min(len(span), 99)),
        "luhn": float(len(digits) <= 19 and luhn(digits)), "plus": float(span.startswith("+")), "paren": float("(" in span),
        "dots": float(min(span.count("."), 9)), "dashes": float(min(span.count("-"), 9)), "blanks": float(min(span.count(" "), 9)),
        "groups": float(min(len(groups), 9)), "longest": float(min(max(map(len, groups), default=0), 99)),
        "octets": float(len(groups) == 4 and all(int(g) <= 255 for g in groups)), "variety": float(min(len(set(span.lower())), 40)),
        "spelled": float(bool(re.search(r"(?i)[\[({] ?at ?[\])}]", span))),
    }
    for name, words in SAID.items():
        out[name] = float(bool(re.search(f"(?i){words}[^0-9]{{0,12}}$", before)))
    out["assigned"] = float(bool(re.search(r"[=:] ?[\"']?$", before)))
    out["glued"] = float(bool(re.search(r"[A-Za-z0-9_/]$", before) or re.search(r"^[A-Za-z0-9_/]", after)))
    return out


# What personal things and look-alikes are introduced with in the sentences.
_PERSONAL = {"phone": ("phone", "call", "tel:", "mobile", "fax", "text me at"), "card": ("card", "visa", "credit card", "payment"), "email": ("email", "contact", "write"), "ip": ("ip", "login from", "host", "client"), "secret": ("token =", "api_key:", "password=", "secret =")}
_OTHER = {"phone": ("order", "invoice", "isbn", "serial", "sku"), "card": ("tracking", "serial", "ticket", "id"), "email": ("see", "notation", "meet"), "ip": ("version", "section", "release", "build"), "secret": ("commit", "sha", "checksum", "md5", "lot")}
_PLAIN = ("then", "the", "about", "over", "with", "and", "some", "was")


def sentences(count: int = SENTENCES, seed: int = 17) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, start, end, personal?) with a fixed seed."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    token = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))

    def thing(kind: str, personal: bool) -> str:
        if kind == "phone":
            if personal or rng.random() < 0.3:
                form = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "{}{}{}", "1-{}-{}-{}"])
                return form.format(number(3), number(3), number(4))
            return rng.choice([number(rng.randint(9, 15)), "-".join(number(rng.randint(1, 5)) for _ in range(4)), f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"20{number(2)}-0{rng.randint(1, 9)}-{number(2)} {number(2)}.{number(2)}"])
        if kind == "card":
            sep = rng.choice(["", " ", "-", "."])
            raw = number(16 if personal or rng.random() < 0.4 else rng.randint(12, 19))
            return sep.join(raw[i : i + 4] for i in range(0, len(raw), 4))
        if kind == "email":
            at, dot = rng.choice(["[at]", "(at)", " [at] ", " (at) ", "{at}"]), rng.choice([".", " [dot] ", "(dot)"])
            return f"{token(rng.randint(2, 9), 'abcdefghij')}{at}{token(rng.randint(2, 9), 'klmnopqr')}{dot}{rng.choice(['org', 'com', 'net']) if personal else number(2)}"
        if kind == "ip":
            sep = rng.choice([".", "[.]", "(.)", " . "]) if personal else rng.choice(["[.]", " . ", "(.)"])
            return sep.join(str(rng.randint(0, 255) if personal or rng.random() < 0.5 else rng.randint(0, 999)) for _ in range(4))
        size = rng.choice([24, 32, 40, 48])
        return token(size, rng.choice(["0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]))

    out = []
    for _ in range(count):
        kind, personal = rng.choice(KINDS), rng.random() < 0.5
        pick = rng.random()
        own, foreign = (_PERSONAL, _OTHER) if personal else (_OTHER, _PERSONAL)
        lead = rng.choice(own[kind]) if pick < 0.6 else rng.choice(foreign[kind]) if pick < 0.61 else rng.choice(_PLAIN)
        joint = rng.choice([" ", " ", ": ", ' "']) if rng.random() < (0.96 if personal else 0.75) else rng.choice(["/", "_", "x"])
        body = thing(kind, personal)
        if kind in ("card", "phone") and not personal and rng.random() < 0.35:  # digits of the other kind, also proposed as this one
            other = "phone" if kind == "card" else "card"
            lead, body = rng.choice(_PERSONAL[other] + _PLAIN), thing(other, True)
        text = f"{rng.choice(_PLAIN)} {lead}{joint}"
        out.append((kind, text + body + rng.choice([" ", ".", ", "]) + rng.choice(_PLAIN), len(text), len(text) + len(body), int(personal)))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients and curvatures; leaves are damped Newton steps."""
    value = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 40:
        return value * RATE
    best, gain = None, 1e-3
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, gs, hs = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        a = gs[at] ** 2 / (hs[at] + 1.0)
        b = (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1.0)
        top = int(np.argmax(a + b))
        if a[top] + b[top] - whole > gain:
            best, gain = (k, float(v[at[top]])), a[top] + b[top] - whole
    if best is None:
        return value * RATE
    k, cut = best
    low = x[:, k] <= cut
    return (FEATURES[k], cut, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _walk(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    low = x[:, FEATURES.index(node[0])] <= node[1]
    return np.where(low, _walk(node[2], x), _walk(node[3], x))


def fitted() -> Ensemble:
    """Fit on half of the sentences; each kind's threshold is the lowest at which the other half reaches PRECISION."""
    data = sentences()
    x = np.array([[d[f] for f in FEATURES] for d in (describe(*s[:4]) for s in data)])
    y, kinds = np.array([s[4] for s in data], float), np.array([KINDS.index(s[0]) for s in data])
    half = np.arange(len(y)) % 2 == 0
    model = Ensemble(float(math.log(y[half].mean() / (1 - y[half].mean()))), [], {})
    margin = np.full(len(y), model.start)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin[half]))
        tree = _grow(x[half], y[half] - p, p * (1 - p), DEPTH)
        model.trees.append(tree)
        margin += _walk(tree, x)
    for k, name in enumerate(KINDS):
        own = ~half & (kinds == k)
        order = np.argsort(-margin[own], kind="stable")
        scores, hits = margin[own][order], np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        ends = np.flatnonzero(np.append(scores[1:] < scores[:-1], True))  # equal scores stand or fall together
        good = ends[hits[ends] >= PRECISION]
        model.thresholds[name] = float(scores[good[-1]]) - 1e-9 if len(good) else math.inf
    return model


def measured(model: Ensemble, count: int = 3000, seed: int = 99) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind on fresh sentences."""
    tally: Counter = Counter()
    for kind, text, start, end, personal in sentences(count, seed):
        said = model.score(describe(kind, text, start, end)) >= model.thresholds[kind]
        tally[kind, bool(personal), said] += 1
    share = lambda a, b: a / (a + b) if a + b else 1.0
    return {k: (share(tally[k, True, True], tally[k, False, True]), share(tally[k, True, True], tally[k, True, False])) for k in KINDS}
