"""Secret scan: fixed patterns, and a character convolutional network over every other candidate and its context."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, prepare, text_or_empty

# The base patterns, their shortest findings and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "cnn"]
KEYWORDS = ("passw", "secret", "token", "api")
#: A run of these, this long, is a candidate if it has a digit or changes case at least twice.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")

#: A part of a candidate between separators that is long enough to be a key.
PART = re.compile(r"[A-Za-z0-9]{16,}")

#: Characters of context before and after a candidate, and of the candidate itself, that the network sees.
BEFORE, INSIDE, AFTER = 24, 40, 8
LENGTH = BEFORE + INSIDE + AFTER
VOCABULARY = 98  # pad, other, and the 96 characters from space on
WIDTH, EMBED, FILTERS, HIDDEN = 5, 12, 32, 24
#: Labelled findings that are made for training and calibration, and the recall their threshold must keep.
TRAINING, CALIBRATION, RECALL, EPOCHS = 4000, 1500, 0.97, 6


def _encode(text: str, start: int, end: int) -> list[int]:
    code = lambda s: [min(max(ord(c) - 30, 1), VOCABULARY - 1) if " " <= c <= "\x7f" else 1 for c in s]
    before, inside, after = code(text[max(0, start - BEFORE) : start]), code(text[start : min(end, start + INSIDE)]), code(text[end : end + AFTER])
    return [0] * (BEFORE - len(before)) + before + inside + [0] * (INSIDE - len(inside)) + after + [0] * (AFTER - len(after))


def _varied(s: str) -> bool:
    """Whether s has a digit, or letters only that change case at least twice."""
    if s.isalpha():
        return sum(a.isupper() != b.isupper() for a, b in zip(s, s[1:])) >= 2
    return any(c.isdigit() for c in s)


def windows(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What the network sees of a candidate: its beginning, overlapping windows up to its end, and its parts between separators."""
    out = [(start, end)]
    if end - start > INSIDE:
        out += [(a, a + INSIDE) for a in range(start + INSIDE // 2, end - INSIDE, INSIDE // 2)] + [(end - INSIDE, end)]
    parts = [(start + m.start(), start + m.end()) for m in PART.finditer(text[start:end])]
    return out + [(a, b) for a, b in parts if (a, b) != (start, end) and _varied(text[a:b])]


@dataclass
class Network:
    """Embedding, one convolution, maxima over context and candidate, one hidden layer, calibrated output."""

    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def new(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls({"e": r.standard_normal((VOCABULARY, EMBED)).astype(np.float32) * 0.3, "c": n(WIDTH * EMBED, FILTERS), "cb": np.zeros(FILTERS, np.float32), "h": n(3 * FILTERS, HIDDEN), "hb": np.zeros(HIDDEN, np.float32), "o": n(HIDDEN, 1), "ob": np.zeros(1, np.float32)})

    def _forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        e = p["e"][x]
        w = np.concatenate([e[:, i : LENGTH - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)
        z = w @ p["c"] + p["cb"]
        a = np.maximum(z, 0)
        cut, stop = BEFORE - WIDTH // 2, BEFORE + INSIDE - WIDTH // 2
        arg = [a[:, :cut].argmax(axis=1), a[:, cut:stop].argmax(axis=1) + cut]
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        real = (x[:, BEFORE : BEFORE + INSIDE] > 0).sum(axis=1, keepdims=True)
        mean = a[:, cut:stop].sum(axis=1) / real
        f = np.concatenate([a[rows, arg[0], cols], a[rows, arg[1], cols], mean], axis=1)
        h = np.maximum(f @ p["h"] + p["hb"], 0)
        return {"x": x, "w": w, "z": z, "arg": arg, "f": f, "h": h, "real": real, "y": (h @ p["o"] + p["ob"])[:, 0]}

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])["y"] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.float32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))

    def _gradient(self, s: dict, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        d = ((1 / (1 + np.exp(-s["y"])) - y) / n)[:, None].astype(np.float32)
        g = {"o": s["h"].T @ d, "ob": d.sum(0)}
        dh = (d @ p["o"].T) * (s["h"] > 0)
        g |= {"h": s["f"].T @ dh, "hb": dh.sum(0)}
        df = dh @ p["h"].T
        da = np.zeros_like(s["z"])
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None]
        da[rows, s["arg"][0], cols] += df[:, :FILTERS]
        da[rows, s["arg"][1], cols] += df[:, FILTERS : 2 * FILTERS]
        da[:, BEFORE - WIDTH // 2 : BEFORE + INSIDE - WIDTH // 2] += (df[:, 2 * FILTERS :] / s["real"])[:, None]
        dz = da * (s["z"] > 0)
        g |= {"c": s["w"].reshape(-1, WIDTH * EMBED).T @ dz.reshape(-1, FILTERS), "cb": dz.sum((0, 1))}
        dw = dz @ p["c"].T
        de = np.zeros((n, LENGTH, EMBED), np.float32)
        for i in range(WIDTH):
            de[:, i : LENGTH - WIDTH + 1 + i] += dw[:, :, i * EMBED : (i + 1) * EMBED]
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], s["x"], de)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> None:
        """Adam on batches of 128."""
        r, t = np.random.default_rng(seed), 0
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 128):
                b = order[i : i + 128]
                t += 1
                for k, g in self._gradient(self._forward(x[b]), y[b]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then the highest threshold up to 0.9 that keeps `recall` of the labelled secrets."""
        s, a, b = self.raw(x).astype(np.float64), 1.0, 0.0
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w, e = q * (1 - q) + 1e-6, q - y
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, [(e * s).sum(), e.sum()])
            a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        own = np.sort(self.probability(x[y == 1]))
        self.threshold = float(min(own[int((1 - recall) * len(own))], 0.9)) if len(own) else 0.5


def labelled(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """n labelled findings (text, start, end, secret 0/1), half of them secrets, made from a seed."""
    r = random.Random(seed)
    letters, digits = string.ascii_letters, string.digits
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    syllables = ["the", "ing", "tion", "er", "an", "re", "on", "en", "at", "ti", "ou", "es", "le", "que", "sch", "ung", "der", "ción", "ado", "ment", "ly", "st", "ed", "or"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    plain = lambda: "".join(r.choice([x for x in syllables if x.isascii()]) for _ in range(r.randint(1, 4)))
    secrets = [
        lambda: pick(letters + digits, r.randint(20, 64)),
        lambda: pick(letters + digits + "+/", r.randint(24, 60)) + "=" * r.randint(0, 2),
        lambda: pick(letters + digits + "_-", r.randint(22, 48)),
        lambda: r.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "AIza", "npm_", "hf_"]) + pick(letters + digits, r.randint(20, 40)),
        lambda: "eyJ" + pick(letters + digits + "_-", r.randint(30, 80)),
        lambda: pick("0123456789abcdef", r.randint(32, 64)),
        lambda: pick(string.ascii_uppercase + digits, r.randint(20, 32)),
    ]
    harmless = [
        lambda: "".join(plain() for _ in range(6))[: r.randint(16, 40)].ljust(16, "e") + r.choice(["", "1", "2", "24"]),
        lambda: "_".join(plain() for _ in range(r.randint(4, 7))) + r.choice(["", "_1", "_v2", "_2024"]),
        lambda: "".join(plain().capitalize() for _ in range(r.randint(3, 6))).ljust(16, "e"),
        lambda: "-".join(plain() for _ in range(r.randint(4, 7))) + r.choice(["", "-2023", "-10"]),
        lambda: "/" + "/".join(plain() for _ in range(r.randint(4, 7))) + r.choice(["", "/2024/05", "/index2"]),
        lambda: pick(digits, r.randint(16, 30)),
        lambda: "-".join([pick("0123456789abcdef", k)[:k] for k in (8, 4, 4, 4, 12)]),
        lambda: "-".join(pick(digits, r.randint(3, 5)) for _ in range(r.randint(4, 6))),
        lambda: r.choice("=-_+/") * r.randint(16, 60) + r.choice(["", "1"]),
        lambda: f"20{pick(digits, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T{pick(digits, 6)}-{plain()}",
        lambda: ("".join(plain() for _ in range(6))).upper()[:30].ljust(16, "E") + r.choice(["", "1"]),
        lambda: (plain() + pick(digits, r.randint(1, 3))) * r.randint(4, 6),
        lambda: r.choice(["ab", "xy1", "abc123", "test"]) * 8,
    ]
    hints = ["key", "auth", "bearer", "Authorization: Bearer", "client", "access", "credential", "private", "signature", "export KEY"]
    out = []
    for k in range(n):
        secret = k % 2
        body = r.choice(secrets if secret else harmless)()
        lead = " ".join(word() for _ in range(r.randint(0, 6)))
        # either kind stands with and without a hint, so the network can't go by the hint alone
        hint = f" {r.choice(hints)}{r.choice([':', '=', ' ', ' = '])}" if r.random() < (0.5 if secret else 0.2) else " "
        q = r.choice(["", "", '"', "'"])
        left = lead + hint + q
        out.append((left + body + q + r.choice([" ", ".", ",", "\n"]) + " ".join(word() for _ in range(3)), len(left), len(left) + len(body), secret))
    return out


def labelled_in_paths(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """n labelled windows (text, start, end, secret 0/1) of long paths, half of them on a key at the path's end."""
    r = random.Random(seed)
    syllables = ["the", "ing", "tion", "er", "an", "re", "on", "en", "at", "ti", "pro", "ject", "web", "hook", "ver", "cus", "ment", "ly", "st", "ed", "or"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    out = []
    for k in range(n):
        secret = k % 2
        path = "com/" + "/".join(r.choice(["", "v1/", "v2/"]) + r.choice("-_").join(word() for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 8)))
        tail = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(20, 48))) if secret else r.choice([word(), word() + "2024", word() + "-v2", "20240517"])
        left = f"{word()} example."
        text = f"{left}{path}/{tail} {word()} {word()}"
        end = len(left) + len(path) + 1 + len(tail)
        if secret:
            start = r.choice([end - len(tail), end - INSIDE])
        else:
            start, end = r.choice(windows(text, len(left), end))
        out.append((text, start, end, secret))
    return out


def encoded(rows: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([_encode(t, a, b) for t, a, b, _ in rows], np.int16).reshape(-1, LENGTH), np.array([y for *_, y in rows], np.float32)


@lru_cache(maxsize=2)
def trained(seed: int = 11) -> Network:
    """The network, trained and calibrated on separate labelled findings; the same for the same seed."""
    net = Network.new(seed)
    net.train(*encoded(labelled(TRAINING, seed) + labelled_in_paths(TRAINING // 2, seed + 2)), EPOCHS, seed)
    net.calibrate(*encoded(labelled(CALIBRATION, seed + 1) + labelled_in_paths(CALIBRATION // 2, seed + 3)), RECALL)
    return net


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' findings, sorted; kind counts in KINDS."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):  # the pattern is slow, and no match is without one of them
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        if _varied(m.group()):
            out.append(m.span())
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_cnn of each row of docs, whole texts.

    The base patterns' findings always stand. The network scores every candidate
    by the highest of its windows; it adds those at or over its threshold that no base finding overlaps, as kind cnn.
    Places are code points, ends exclusive. A null or empty text has no findings
    (base_sha256 is that of the empty string). Rows are scanned one by one: repeated
    rows and null doc_ids come back as they are; other columns are left out; no rows
    give none.
    """
    prepare(docs.sparkSession)
    net = network or trained()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, places, seen = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                base.append(base_spans(text))
                for s, e in candidates(text):
                    parts = windows(text, s, e)
                    places.append((i, s, e, len(seen)))
                    seen += [_encode(text, *x) for x in parts]
            more: list[list[tuple[int, int, int]]] = [[] for _ in base]
            score = net.probability(np.array(seen, np.int16).reshape(-1, LENGTH))
            best = np.maximum.reduceat(score, [x[3] for x in places]) if places else []
            for (i, s, e, _), p in zip(places, best):
                if p >= net.threshold and not any(s < end and start < e for start, _, end in base[i]):
                    more[i].append((s, 3, e))
            count = lambda k: pa.array([sum(x[1] == k for x in y) for y in base], pa.int64())
            sha = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]
            spans = [_joined(sorted(x + y)) for x, y in zip(base, more)]
            cols = [b.column(0), count(0), count(1), count(2), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array([len(x) for x in more], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = only(docs, ["doc_id", "text"]).select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long")
