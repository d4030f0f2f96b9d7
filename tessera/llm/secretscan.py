"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

The patterns give the base findings, which always stay. Candidates are all runs of 10 or more characters of tokens and
passwords that mix letters with digits, change case again and again or are 24 letters long, unless a base span holds them
whole. The network (embedding, one convolution, maximum over positions, logistic output; numpy only) is trained on the driver
on labelled findings that a seeded generator writes: keys and passwords of known shapes against addresses, identifiers, file
names, numbers of people and prose, each in its context. A candidate longer than one window is scored window by window and
counts by its best. Scores are calibrated on findings left aside, and the threshold is the highest that keeps the stated
recall there, where a secret that is no candidate counts as missed.

Defined results. Null or empty text: no findings. Empty table: empty result. Texts of any length are read whole. Offsets
count code points. Added spans are of kind "model"; one may hold a base span, when the token around it is longer. Spans that
start at the same place stand by kind and end. Repeated rows and null ids get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "model")

LEAST, LETTERS = 10, 24
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~!@$%^&*?#-]{10,}")
LEFT, BODY, RIGHT = 20, 40, 12
WIDTH = LEFT + BODY + RIGHT
EMBED, KERNEL, FILTERS = 10, 5, 24
RECALL = 0.98


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def candidate(run: str) -> tuple[int, int]:
    """Where the candidate in a run of CANDIDATE begins and ends; equal where it is none."""
    core = run.lstrip(".!?/*#-=").rstrip(".!?*#/-")
    start = run.find(core)
    letters = sum(map(str.isalpha, core))
    varied = (letters and any(map(str.isdigit, core))) or len(re.findall("[a-z][A-Z]", core)) > 2 or letters >= LETTERS
    return (start, start + len(core)) if len(core) >= LEAST and varied else (0, 0)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = (m.start() + x for x in candidate(m[0]))
        if a < b and not any(s <= a and b <= e for s, e, _ in taken):
            out.append((a, b))
    return out


def _classes() -> np.ndarray:
    """Character classes by code point below 128: letters and digits apart, the rest in groups; 0 is padding, 1 other."""
    out = np.ones(129, dtype=np.int64)
    for i, c in enumerate(string.ascii_letters + string.digits + "+/_=-.:@\"' \n~!$%^&*?#,;()", 2):
        out[ord(c)] = i
    out[0] = 0
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate in its context, cut to windows of one width; later windows have no left context."""
    out = []
    for at in range(start, end, BODY):
        left = text[max(0, start - LEFT) : start] if at == start else ""
        out.append(left.rjust(LEFT, "\0") + text[at : min(at + BODY, end)].ljust(BODY, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0"))
    return out


def encode(cut: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(cut), WIDTH)
    return CLASSES[np.minimum(points, 128)]


class CharNet:
    """A one-layer character convolutional network with calibrated output."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.3, (N_CLASSES, EMBED)),
            "conv": r.normal(0, (2 / (KERNEL * EMBED)) ** 0.5, (KERNEL * EMBED, FILTERS)),
            "cb": np.zeros(FILTERS),
            "out": r.normal(0, 0.2, 2 * FILTERS),
            "ob": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        e = self.p["emb"][x]
        cols = np.concatenate([e[:, k : WIDTH - KERNEL + 1 + k] for k in range(KERNEL)], axis=2)
        a = np.maximum(cols @ self.p["conv"] + self.p["cb"], 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(1)], axis=1)
        return pooled @ self.p["out"] + self.p["ob"][0], (cols, a, top, pooled)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.004, seed: int = 5) -> None:
        r, m1, m2, step = np.random.default_rng(seed), {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        spots = WIDTH - KERNEL + 1
        for _ in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(y), batch):
                own = order[k : k + batch]
                z, (cols, a, top, pooled) = self.forward(x[own])
                e = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[own]) / len(own)
                da = np.broadcast_to((e[:, None] * self.p["out"][FILTERS:])[:, None, :] / spots, a.shape).copy()
                np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + (e[:, None] * self.p["out"][:FILTERS])[:, None, :], 1)
                da *= a > 0
                dcols = da @ self.p["conv"].T
                de = np.zeros((len(own), WIDTH, EMBED))
                for j in range(KERNEL):
                    de[:, j : j + spots] += dcols[:, :, j * EMBED : (j + 1) * EMBED]
                demb = np.zeros_like(self.p["emb"])
                np.add.at(demb, x[own], de)
                grads = {"emb": demb, "conv": np.tensordot(cols, da, ([0, 1], [0, 1])), "cb": da.sum((0, 1)), "out": pooled.T @ e, "ob": np.array([e.sum()])}
                step += 1
                for n, g in grads.items():
                    g = g + 1e-5 * self.p[n]
                    m1[n] = 0.9 * m1[n] + 0.1 * g
                    m2[n] = 0.999 * m2[n] + 0.001 * g * g
                    self.p[n] = self.p[n] - rate * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, cuts: list[list[str]], y: np.ndarray, recall: float = RECALL) -> None:
        """Logit scale and shift by Newton steps, then the highest threshold that still finds the stated share of findings.

        cuts has the windows of each finding; none where a finding is no candidate, and so is missed.
        """
        held = np.array([len(c) > 0 for c in cuts])
        z, p = self.logits([c for c in cuts if c]), np.array([1.0, 0.0])
        own = y[held]
        cols = np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(cols @ p, -35, 35)))
            p = p - np.linalg.solve((cols * (q * (1 - q))[:, None]).T @ cols + np.eye(2), cols.T @ (q - own) + (p - [1.0, 0.0]))
        self.scale, self.shift = float(max(p[0], 0.05)), float(p[1])
        found = np.sort(self._out(z)[own == 1])[::-1]
        self.threshold = float(found[min(len(found), int(np.ceil(recall * (y == 1).sum()))) - 1])

    def logits(self, cuts: list[list[str]]) -> np.ndarray:
        """The best logit of the windows of each candidate."""
        flat = [w for c in cuts for w in c]
        z = np.concatenate([self.forward(encode(flat[k : k + 512]))[0] for k in range(0, len(flat), 512)]) if flat else np.zeros(0)
        return np.maximum.reduceat(z, np.cumsum([0, *map(len, cuts)])[:-1]) if cuts else z

    def _out(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -35, 35)))

    def scores(self, cuts: list[list[str]]) -> np.ndarray:
        return self._out(self.logits(cuts))


def labelled_findings(n: int, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """n texts with a candidate's place and its label, half of them secrets."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = ("er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve tion ment que los der sch ung lich aux eau").split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 5)))
    alnum, b64, up = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    symbols = "~!@$%^&*?#-_+="
    mixed = lambda k: "".join(r.sample(pick(string.ascii_lowercase, k) + pick(string.ascii_uppercase, 2) + pick(string.digits, 2) + pick(symbols, r.randint(0, 3)), k))
    secrets = (
        lambda: pick(alnum, r.randint(20, 44)),
        lambda: pick(b64, r.choice((22, 32, 40, 43))) + r.choice(("", "=", "==")),
        lambda: pick("0123456789ABCDEF", r.choice((32, 40, 64))),
        lambda: r.choice(("ghp_", "gho_", "sk_live_", "pk_test_", "xoxb-", "glpat-", "AIza", "eyJ")) + pick(alnum, r.randint(24, 40)),
        lambda: r.choice(("ASIA", "AROA", "AIDA")) + pick(up, 16),
        lambda: "-".join(pick(alnum, 8) for _ in range(3)),
        lambda: pick(alnum + "_-", r.randint(16, 64)),
        lambda: pick(string.ascii_letters, r.randint(24, 40)),
        lambda: "eyJ" + ".".join(pick(alnum + "_-", k) for k in (r.randint(16, 30), r.randint(24, 60), 43)),
        lambda: pick(string.ascii_letters, r.randint(4, 9)) + pick("0123456789abcdef", r.randint(16, 24)),
        lambda: mixed(r.randint(12, 15)),
        lambda: pick(alnum + symbols, r.randint(16, 30)),
    )
    many = lambda a, b, join="": join.join(word() for _ in range(r.randint(a, b)))
    plain = (
        lambda: many(3, 6, "-") + "-" + pick(string.digits, r.randint(1, 4)),
        lambda: many(3, 5, "_") + str(r.randint(0, 99)),
        lambda: many(3, 6, "/") + "/" + pick(string.digits, 4),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-00Z",
        lambda: many(4, 9)[:40].ljust(16, "e") + str(r.randint(0, 9)),
        lambda: "".join(word().capitalize() for _ in range(r.randint(4, 7))).ljust(16, "e") + str(r.randint(1, 99)),
        lambda: "=" * r.randint(10, 20) + word() + str(r.randint(1, 9)) + "=" * r.randint(10, 20),
        lambda: pick(string.digits, r.randint(3, 8)) + "-" + pick(string.digits, r.randint(4, 8)) + "-" + pick(string.digits, 4) + word(),
        lambda: (word() * 8)[: r.randint(16, 60)] + str(r.randint(1, 9)) * r.randint(1, 3),
        lambda: word() + r.choice((".", "_", "")) + word() + str(r.randint(1, 999)) + "@" + many(1, 3) + r.choice((".com", ".org", ".net", ".example.com", ".de")),
        lambda: pick(string.ascii_lowercase, r.randint(2, 9)) + r.choice((".", "_", "-", "+")) + pick(alnum.lower(), r.randint(1, 6)) + "@" + word() + pick(string.digits, r.randint(0, 2)) + "." + word() + r.choice((".com", ".org", ".net", ".de")),
        lambda: "www." + many(1, 3) + ".com/" + many(1, 4, "-") + "/" + str(r.randint(1, 99999)) + r.choice(("", ".html", "?page=2", "#top")),
        lambda: many(1, 3) + f"-{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}" + r.choice((".tar.gz", ".zip", "-rc1", "")),
        lambda: r.choice("DE FR ES GB IT".split()) + pick(string.digits, r.randint(18, 22)),
        lambda: word().capitalize() + r.choice((" ", "-")).strip() + pick(string.digits, r.randint(6, 10)),
        lambda: many(8, 12).ljust(24, "e"),
        lambda: "".join(word().capitalize() for _ in range(r.randint(4, 7))).ljust(12, "e"),
        lambda: many(2, 3) + "!" * r.randint(1, 3) + str(r.randint(1, 99)) + many(1, 2),
        lambda: r.choice(("IMG", "DSC", "doc", "scan")) + "_" + pick(string.digits, 8) + "_" + pick(string.digits, 6) + r.choice((".jpg", ".pdf", "")),
    )
    lead = ("key", "api key", "credential", "auth", "bearer", "access", "private_key", "client_id", "login", "PASS", "pwd")
    out = []
    while len(out) < n:
        secret = len(out) % 2
        body = r.choice(secrets if secret else plain)()
        if not secret and candidate(body) == (0, 0):
            continue  # the scan passes over it anyway, while a secret that it passes over is a miss
        before = prose() + " "
        if r.random() < (0.6 if secret else 0.15):
            before += r.choice(lead) + r.choice((": ", "=", " = ", ' "', " '", " "))
        after = r.choice((" ", ".", '"', "\n", ", ", "'")) + prose()
        out.append((before + body + after, len(before), len(before) + len(body), secret))
    return out


def finding_windows(text: str, start: int, end: int) -> list[str]:
    """The windows of the candidates that touch a finding; none where it is passed over."""
    return [w for a, b in candidates(text, []) if a < end and start < b for w in windows(text, a, b)]


def trained(n: int = 10_000, seed: int = 3) -> CharNet:
    """A network fitted to four fifths of n labelled findings and calibrated on the rest."""
    rows = labelled_findings(n, seed)
    cuts = [finding_windows(t, a, b) for t, a, b, _ in rows]
    y = np.array([r[3] for r in rows], dtype=float)
    aside = np.arange(n) % 10 >= 8
    net = CharNet()
    fitted = [k for k in np.flatnonzero(~aside) if cuts[k]]
    net.fit(encode([cuts[k][0] for k in fitted]), y[fitted])
    net.calibrate([cuts[k] for k in np.flatnonzero(aside)], y[aside])
    return net


def scan_secrets(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """doc_id, the base counts and digest, all spans, and what the network added and scored best."""
    net = net or trained()

    def scanned(batches):
        import pyarrow as pa

        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            base = [base_findings(x) for x in texts]
            places = [(k, s, e) for k, (x, own) in enumerate(zip(texts, base, strict=True)) for s, e in candidates(x, own)]
            added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            best = [0.0] * len(texts)
            for (k, s, e), p in zip(places, net.scores([windows(texts[k], s, e) for k, s, e in places]).tolist(), strict=True):
                best[k] = max(best[k], p)
                if p >= net.threshold:
                    added[k].append((s, e, 3))
            tell = lambda rows: ",".join(f"{KINDS[kind]}:{s}:{e}" for s, e, kind in rows)
            cols = [
                b.column(0),
                *[pa.array([sum(x[2] == kind for x in own) for own in base], pa.int64()) for kind in range(3)],
                pa.array([hashlib.sha256(tell(own).encode()).hexdigest() for own in base]),
                pa.array([tell(sorted(own + more, key=lambda x: (x[0], x[2], x[1]))) for own, more in zip(base, added, strict=True)]),
                pa.array([len(x) for x in added], pa.int64()),
                pa.array(best, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "best_score"])

    return docs.select("doc_id", "text").mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, best_score double")
