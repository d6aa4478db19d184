"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

The patterns (assign, access, hex) always stand. A candidate is every other token of 12 or more characters of secrets,
plain words too; the network reads it with the characters around it and says how likely it is a secret. It is trained
here, in numpy, on labelled findings (``findings()``: a seeded list of secrets and look-alikes in several languages and
code, of a stated size, or the caller's own), calibrated on findings that it was not trained on, and cuts each kind of
candidate (letters of one case, letters, letters and digits, any) at the highest probability that still finds ``RECALL``
of the secrets of that kind in a third set, or lower where ``FALSE`` of its look-alikes at most get there. The training set does not depend on the corpus, so verdicts are alike at
every size.

Defined cases: a null or empty text has no spans. A candidate of more than CANDIDATE characters is read in tiles of
that length, each with the same context; the likeliest tile counts. A candidate that touches a pattern's span is left
to the pattern. Spans are in code points, end exclusive. Repeated rows get equal spans; an empty table gives no rows. Texts
are read whole, in time that grows with their length. Other columns pass through ``mask_secrets`` whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, map_texts, parts, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{12,}")
ORDER = {"assign": 0, "access": 1, "hex": 2, "network": 3}
BEFORE, CANDIDATE, AFTER = 24, 48, 8
LENGTH = BEFORE + CANDIDATE + AFTER
#: Findings to train on, to calibrate on and to cut by.
TRAIN, CALIBRATE, CUT, SEED, RECALL, FALSE = 12_000, 3000, 8000, 7, 0.98, 0.002

Span = tuple[str, int, int]

# --- patterns and candidates


def base_spans(text: str) -> list[Span]:
    """By start, then in the patterns' order."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """(start, end) of every token that touches none of ``taken``, which come by start."""
    out, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        start = m.start()
        end = start + len(m.group().rstrip("."))
        if end - start < 12:
            continue
        while at < len(taken) and taken[at][1] < end:
            reach, at = max(reach, taken[at][2]), at + 1
        if reach <= start:
            out.append((start, end))
    return out


KINDS = ("one case", "letters", "letters and digits", "any")


def kind(word: str) -> int:
    if word.isalpha():
        return 0 if word[1:].islower() or word.isupper() else 1
    return 2 if word.isalnum() else 3


# --- the network

_CODES = np.full(128, 1, np.int64)  # 0: beyond the text, 1: any other character
for _i, _c in enumerate(string.ascii_letters + string.digits + " \n\"'`:=+/_.-,;(){}[]<>@#$%&*!?|\\~^"):
    _CODES[ord(_c)] = _i + 2
ALPHABET = int(_CODES.max()) + 1


def windows(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(characters, where the candidate's tile begins, its length) for each tile."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    out = []
    for at in range(start, end, CANDIDATE):
        tile = text[at : min(end, at + CANDIDATE)]
        out.append((before + tile + text[end : end + AFTER], BEFORE, len(tile)))
    return out


def encode(tiles: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, LENGTH) and 1 where the candidate is."""
    x, inside = np.zeros((len(tiles), LENGTH), np.int64), np.zeros((len(tiles), LENGTH), np.float32)
    for i, (chars, at, n) in enumerate(tiles):
        points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        x[i, : len(points)] = np.where(points == 0, 0, np.where(points < 128, _CODES[np.minimum(points, 127)], 1))
        inside[i, at : at + n] = 1
    return x, inside


class Network:
    """Embedding, convolution of WIDTH characters, ReLU, maxima over candidate and context and a mean, one logit."""

    DIM, WIDTH, FILTERS = 8, 5, 32

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        normal = lambda *s, by: r.normal(0, by, s).astype(np.float32)
        self.p = {
            "E": normal(ALPHABET, self.DIM, by=0.5),
            "W": normal(self.WIDTH * (self.DIM + 1), self.FILTERS, by=0.2),
            "b": np.zeros(self.FILTERS, np.float32),
            "v": normal(3 * self.FILTERS, by=0.1),
            "c": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.thresholds = 1.0, 0.0, np.full(len(KINDS), 0.5)

    def _forward(self, x: np.ndarray, inside: np.ndarray):
        p, n = self.p, len(x)
        z = np.concatenate((p["E"][x], inside[:, :, None]), axis=2)
        z = np.pad(z, ((0, 0), (self.WIDTH // 2, self.WIDTH // 2), (0, 0)))
        cols = np.concatenate([z[:, k : k + LENGTH] for k in range(self.WIDTH)], axis=2).reshape(n * LENGTH, -1)
        h = np.maximum(cols @ p["W"] + p["b"], 0).reshape(n, LENGTH, self.FILTERS)
        mask = inside[:, :, None]
        top_in, top_out = (h * mask).argmax(1), (h * (1 - mask)).argmax(1)
        size = np.maximum(inside.sum(1), 1)[:, None]
        pooled = np.concatenate((np.take_along_axis(h * mask, top_in[:, None], 1)[:, 0], np.take_along_axis(h * (1 - mask), top_out[:, None], 1)[:, 0], (h * mask).sum(1) / size), axis=1)
        return pooled @ p["v"] + p["c"], (cols, h, mask, top_in, top_out, size, pooled)

    def logits(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 256], inside[i : i + 256])[0] for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probability(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x, inside) + self.shift, -50, 50)))

    def _gradient(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out, (cols, h, mask, top_in, top_out, size, pooled) = self._forward(x, inside)
        p, n, f = self.p, len(x), self.FILTERS
        d = ((1 / (1 + np.exp(-out)) - y) / n).astype(np.float32)
        g = {"v": pooled.T @ d, "c": d.sum(keepdims=True)}
        dp = d[:, None] * p["v"]
        dh = mask * (dp[:, 2 * f :] / size)[:, None]
        i, j = np.arange(n)[:, None], np.arange(f)
        dh[i, top_in, j] += dp[:, :f] * mask[i, top_in, 0]
        dh[i, top_out, j] += dp[:, f : 2 * f] * (1 - mask[i, top_out, 0])
        dh = (dh * (h > 0)).reshape(n * LENGTH, f)
        g["W"], g["b"] = cols.T @ dh, dh.sum(0)
        dc = (dh @ p["W"].T).reshape(n, LENGTH, self.WIDTH, self.DIM + 1)[..., : self.DIM]
        dz = np.zeros((n, LENGTH + self.WIDTH - 1, self.DIM), np.float32)
        for k in range(self.WIDTH):
            dz[:, k : k + LENGTH] += dc[:, :, k]
        dz = dz[:, self.WIDTH // 2 : self.WIDTH // 2 + LENGTH].reshape(-1, self.DIM)
        g["E"] = np.stack([np.bincount(x.ravel(), dz[:, k], ALPHABET) for k in range(self.DIM)], axis=1).astype(np.float32)
        g["E"][0] = 0
        return g

    def fit(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 96, rate: float = 5e-3, seed: int = SEED) -> None:
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                pick, step = order[i : i + batch], step + 1
                for k, g in self._gradient(x[pick], inside[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps."""
        s, w = self.logits(x, inside).astype(np.float64), np.array([1.0, 0.0])
        a = np.stack((s, np.ones_like(s)), axis=1)
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
            w -= np.linalg.solve((a * (q * (1 - q) + 1e-6)[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (q - y) + 1e-3 * (w - [1, 0]))
        self.scale, self.shift = float(w[0]), float(w[1])

    def cut(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray, kinds: np.ndarray, recall: float) -> None:
        """For each kind the highest threshold with that recall, or a lower one, 0.5 at least, if no more than FALSE of the
        kind's look-alikes reach it; 0.5 where there is no secret of the kind."""
        q = self.probability(x, inside)
        for k in range(len(KINDS)):
            hits, rest = (np.sort(q[(y == label) & (kinds == k)]) for label in (1, 0))
            if len(hits):
                clear = np.nextafter(rest[max(0, len(rest) - 1 - int(FALSE * len(rest)))], 2) if len(rest) else 0.5
                self.thresholds[k] = min(hits[int((1 - recall) * len(hits))], max(0.5, clear))


# --- labelled findings

Finding = tuple[str, int, int, int]


def findings(n: int, seed: int) -> list[Finding]:
    """(text, start, end, label): half secrets, half look-alikes, with prose or code around them."""
    r = random.Random(seed)
    pick = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alnum, b64, hexa = low + up + dig, low + up + dig + "+/", "0123456789abcdef"
    sample = lambda text: r.choice(text.split())
    starts = "b br c ch cl d dr f fl fr g gr h j k kl l m n p pf pl pr qu r s sch sh sp st str t th tr v w wh z _ _ _".replace("_", "").split(" ")
    middles, ends = "a e i o u ai au ea ee ei eu ie io ou ui á é è ê ó ö ü ä y", "_ _ _ n r s t l m nd nt ng st rt ch ss x th ß"
    common = "the and tion ing ent ion her ver ein ich sch eit lich keit ung der die und que les des eau ment aux elle los ado ción mente as os er on en th wh ha ly ed re an in of to is".split()
    syllable = lambda: r.choice(common) if r.random() < 0.6 else r.choice(starts) + sample(middles) + sample(ends).replace("_", "")
    word = lambda a=1, b=4: "".join(syllable() for _ in range(r.randint(a, b)))
    words = lambda k: " ".join(word() for _ in range(k))
    secret = [
        lambda: pick(alnum, 16, 64),
        lambda: pick(alnum, 16, 32),
        lambda: pick(low, 16, 40),
        lambda: pick(up, 16, 40),
        lambda: pick(low + up, 16, 40),
        lambda: pick(low + dig, 16, 40),
        lambda: pick(up + dig, 16, 40),
        lambda: pick(b64, 24, 88) + r.choice(["", "=", "=="]),
        lambda: pick(hexa.upper(), 24, 64),
        lambda: r.choice(["sk_live_", "sk-", "ghp_", "gho_", "github_pat_", "xoxb-", "glpat-", "npm_", "pk_", "SG.", "hf_", word(1, 1) + "_"]) + pick(alnum, 20, 40),
        lambda: "eyJ" + pick(alnum + "_-", 15, 40) + "." + pick(alnum + "_-", 20, 60) + "." + pick(alnum + "_-", 20, 43),
        lambda: pick(alnum + "_-", 20, 48),
        lambda: "AIza" + pick(alnum + "_-", 35, 35),
    ]
    plain = [
        lambda: word(5, 9),
        lambda: word(5, 9),
        lambda: word(5, 9).capitalize(),
        lambda: word(5, 9).upper(),
        lambda: word(2, 5) + word(1, 4).capitalize(),
        lambda: pick(dig, 12, 30),
        lambda: "-".join(pick(hexa, k, k) for k in (8, 4, 4, 4, 12)),
        lambda: ".".join(pick(dig, 1, 3) for _ in range(4)) + "." + pick(dig, 1, 4),
        lambda: pick(dig, 12, 15),
        lambda: "-".join(pick(dig, 3, 4) for _ in range(r.randint(3, 4))),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" + r.choice(["", "T12", f"T{r.randint(0, 23):02}.{pick(dig, 2, 4)}"]) + "-" + word(),
        lambda: f"{r.choice(['www', 'mail2', 'blog', word()])}.{word(2, 4)}{r.choice(['', '-' + word(), pick(dig, 1, 3)])}.{r.choice(['example.com', 'example.org', 'net', 'de'])}",
        lambda: "/".join(word(1, 3) + r.choice(["", "", pick(dig, 1, 4)]) for _ in range(r.randint(2, 6))) + r.choice(["", ".html", ".py", ".txt"]),
        lambda: "_".join(word(1, 2) for _ in range(r.randint(2, 5))) + r.choice(["", "_" + pick(dig, 1, 2)]),
        lambda: "-".join(word(1, 3) for _ in range(r.randint(2, 5))),
        lambda: "".join(word(1, 2).capitalize() for _ in range(r.randint(2, 5))) + r.choice(["", pick(dig, 1, 2)]),
        lambda: word(3, 5) + r.choice([".", "-", "/", "="]) + word(2, 4),
        lambda: r.choice("=-_.") * r.randint(12, 60),
        lambda: r.choice([low, up, dig])[r.randint(0, 9)] * r.randint(12, 40),
        lambda: f"v{pick(dig, 1, 2)}.{pick(dig, 1, 2)}.{pick(dig, 1, 3)}-{word(1, 2)}.{pick(dig, 1, 3)}",
    ]
    lead = ["", "", "", "auth = ", "Bearer ", "Authorization: Basic ", "key: ", "client_id='", 'credential="', "pwd ", "private_key=", "export KEY=", '"sig": "', "see ", "file ", "id: ", "commit ", "version ", "http://", "path="]
    out: list[Finding] = []
    while len(out) < n:
        label = len(out) % 2
        value = r.choice(secret if label else plain)()
        if not label and r.random() < 0.1:
            value = value.upper()
        before = words(r.randint(0, 6)) + r.choice([" ", "\n", ". ", ", ", ""]) + r.choice(lead if r.random() < 0.5 else [""])
        if before and before[-1] not in " \n\"'=:/":
            before += " "
        after = r.choice(["", " ", " ", '" ', "'\n", ". ", ", ", "!!", "%%% ", "### "]) + words(r.randint(0, 4))
        # as a scan sees it: the longest token of the value, with all that stands around it
        found = [(a, b) for a, b in candidates(before + value + after, []) if a < len(before) + len(value) and b > len(before)]
        if found:
            out.append((before + value + after, *max(found, key=lambda f: f[1] - f[0]), label))
    return out


def train(labelled: list[Finding], calibration: list[Finding], held: list[Finding], recall: float = RECALL, seed: int = SEED) -> Network:
    """Fits on the first list, calibrates on the second, cuts by the third; lists of a bounded, stated size."""
    net = Network(seed)
    for k, part in enumerate((labelled, calibration, held)):
        x, inside = encode([windows(t, s, e)[0] for t, s, e, _ in part])
        y = np.array([label for *_, label in part], np.float32)
        if k == 2:
            net.cut(x, inside, y, np.array([kind(t[s:e]) for t, s, e, _ in part]), recall)
        else:
            (net.calibrate if k else net.fit)(x, inside, y)
    return net


@lru_cache(maxsize=1)
def default_network() -> Network:
    return train(findings(TRAIN, SEED), findings(CALIBRATE, SEED + 1), findings(CUT, SEED + 2))


def scan(texts: list[str], net: Network) -> list[list[Span]]:
    """All spans of each text, by start and kind; one pass of the network for the whole slice."""
    spans = [base_spans(t) for t in texts]
    found, tiles, owner = [], [], []
    for i, text in enumerate(texts):
        for start, end in candidates(text, spans[i]):
            new = windows(text, start, end)
            owner += [len(found)] * len(new)
            found.append((i, start, end))
            tiles += new
    best = np.zeros(len(found))
    for at in range(0, len(tiles), 4096):
        np.maximum.at(best, owner[at : at + 4096], net.probability(*encode(tiles[at : at + 4096])))
    for (i, start, end), q in zip(found, best):
        if q >= net.thresholds[kind(texts[i][start:end])]:
            spans[i].append(("network", start, end))
    return [sorted(s, key=lambda x: (x[1], ORDER[x[0]])) for s in spans]


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_network bigint"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = default_network()

    def kernel(cols: list[list]) -> dict[str, list]:
        out: dict[str, list] = {f.split(" ")[0]: [] for f in SCHEMA.split(", ")}
        for doc_id, spans in zip(cols[0], scan(cols[1], net)):
            n = {k: sum(s[0] == k for s in spans) for k in ORDER}
            base = joined([s for s in spans if s[0] != "network"])
            for col, x in zip(out.values(), (doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), joined(spans), n["network"])):
                col.append(x)
        return out

    return map_texts(table(spark, sf_dir, "documents"), ["doc_id"], "text", kernel, SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each stretch of overlapping spans replaced by a mark that names the first span's kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind} secret>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of every text masked; texts without one stay as they are. n_chars follows the text.

    Further columns pass through untouched, whatever their names.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    net, names = default_network(), docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, at):
            text = part.column(at).to_pylist()
            chars = part.column(size).to_pylist() if size is not None else []
            for k, spans in enumerate(scan([t or "" for t in text], net)):
                if spans:
                    text[k] = masked(text[k], spans)
                    if size is not None:
                        chars[k] = len(text[k])
            cols = list(part.columns)
            cols[at] = pa.array(text, cols[at].type)
            if size is not None:
                cols[size] = pa.array(chars, cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return map_rows(docs, run)
