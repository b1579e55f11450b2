"""Secrets in text: a character convolutional network over every candidate and its surroundings."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import integer_id, table
from .textbytes import as_bytes, slices

#: Bound of the corpus texts from which surroundings for the labelled findings are taken, and of the findings.
CONTEXT_DOCS = 400
FINDINGS = 6000
#: Share of the held-out secrets of either kind, with digits and without, that its threshold must find.
RECALL = 0.99

LEFT, BODY, RIGHT = 28, 64, 12
_LENGTH = LEFT + BODY + RIGHT
_STRIDE = 32
WIDTH, FILTERS, HIDDEN = 5, 24, 16

#: Values after names that ask for a secret, and runs of token characters that are no plain word: with a digit, with a
#: capital after a small letter, or longer than all but a few words. All are candidates.
KEYED = re.compile(
    rb"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
    rb"[\w-]{0,40}[\"']?\s{0,8}(?:[:=]|=>|\s)\s{0,8}[\"']?([^\s\"',;<>|]{4,})"
)
TOKEN = re.compile(rb"[A-Za-z0-9_+/~-][A-Za-z0-9_+/.~-]{6,}[A-Za-z0-9_+/~-]=*")
_NO_WORD = re.compile(rb"\d|[a-z][A-Z]|[A-Za-z0-9_+/.~=-]{20}")


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the candidates of a text, in order and without overlap; values after a name take precedence."""
    spans = [m.span(1) for m in KEYED.finditer(text) if b":" in m.group() or b"=" in m.group() or b" " in m.group()]
    taken = sorted(spans)
    out = list(taken)
    j = 0
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while j < len(taken) and taken[j][1] <= s:
            j += 1
        if (j == len(taken) or taken[j][0] >= e) and _NO_WORD.search(text, s, e):
            out.append((s, e))
    return sorted(set(out))


def digitless(text: bytes, start: int, end: int) -> bool:
    """Whether a candidate has no digit."""
    return not any(48 <= c <= 57 for c in text[start:end])


def _symbols() -> np.ndarray:
    """Byte to one of 64 symbols: letters by themselves and by case, digits, signs one by one or in groups."""
    lut = np.full(256, 62, np.uint8)
    for i, c in enumerate(string.ascii_lowercase):
        lut[ord(c)] = 1 + i
        lut[ord(c.upper())] = 27 + i % 13
    for c in string.digits:
        lut[ord(c)] = 40
    for i, c in enumerate("-_=+/.:@\"'()[]{}<>,;# \n"):
        lut[ord(c)] = 41 + min(i, 20)
    lut[128:] = 63
    return lut


_LUT = _symbols()


def windows(text: bytes, start: int, end: int) -> np.ndarray:
    """Symbol numbers of a candidate with what is around it; a long candidate gives several windows that cover it."""
    rows = []
    at = start
    while True:
        body = text[at : min(end, at + BODY)]
        row = np.zeros(_LENGTH, np.int64)
        left = text[max(0, start - LEFT) : start]
        right = text[end : end + RIGHT]
        for place, part, region in ((LEFT - len(left), left, 0), (LEFT, body, 1), (LEFT + BODY, right, 2)):
            row[place : place + len(part)] = _LUT[np.frombuffer(part, np.uint8)] + 64 * region
        rows.append(row)
        if at + BODY >= end:
            return np.stack(rows)
        at = min(at + _STRIDE, end - BODY)


@dataclass
class Network:
    """Filters by offset and symbol, dense layers, calibration of the logit, and a threshold for values with and without digits."""

    filters: np.ndarray
    offset: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float] = (0.5, 0.5)

    def secret(self, p: np.ndarray, digitless: np.ndarray) -> np.ndarray:
        """Whether candidates of these probabilities, with digits or without, are secrets."""
        return p >= np.where(digitless, self.thresholds[1], self.thresholds[0])

    def pools(self) -> list[tuple[int, int]]:
        return [(0, LEFT), (LEFT, LEFT + BODY - WIDTH + 1), (LEFT + BODY - WIDTH + 1, _LENGTH - WIDTH + 1)]

    def forward(self, x: np.ndarray) -> tuple:
        conv = self.offset[None, None] + sum(self.filters[o][x[:, o : _LENGTH - WIDTH + 1 + o]] for o in range(WIDTH))
        best = [conv[:, a:b].argmax(axis=1) + a for a, b in self.pools()]
        pooled = np.concatenate([np.take_along_axis(conv, i[:, None], 1)[:, 0] for i in best], axis=1)
        active = np.maximum(pooled, 0)
        size = (x[:, LEFT : LEFT + BODY] > 0).sum(axis=1, keepdims=True) / BODY
        digits = (x[:, LEFT : LEFT + BODY] == 64 + 40).sum(axis=1, keepdims=True) / BODY
        features = np.concatenate([active, size, digits / np.maximum(size, 1e-6)], axis=1)
        hidden = np.maximum(features @ self.dense + self.dense_bias, 0)
        return hidden @ self.out + self.out_bias, hidden, features, active, best

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of each window."""
        parts = [self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def labelled_findings(contexts: list[bytes], n: int = FINDINGS, seed: int = 11) -> tuple[list[tuple[bytes, int, int]], np.ndarray]:
    """(text, start, end) of ``n`` findings and whether each is a secret.

    Values of publicly documented formats, and of harmless things that look alike, are placed by a seeded generator
    into surroundings taken from the corpus, in the notations in which each is found.
    """
    rng = np.random.default_rng(seed)
    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    hexes, alnum = "0123456789abcdef", low + up + digits

    def draw(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    def pick(*options):
        return options[rng.integers(len(options))]

    words = sorted({w.decode() for c in contexts for w in re.findall(rb"\b[a-z]{4,12}\b", c)}) or ["value", "user", "name", "index", "other", "count"]

    def word() -> str:
        return words[rng.integers(len(words))]

    def secret() -> tuple[str, str]:
        name = pick("token", "password", "passwd", "secret", "api_key", "apikey", "access_token", "auth_token", "client_secret", "SECRET_KEY", "API_KEY", "private_key", "pwd", "Token", "PASSWORD", "db_password", "AWS_SECRET_ACCESS_KEY")
        notation = pick('{n} = "{v}"', "{n}={v}", "{n}: {v}", "{n} = {v}", '"{n}": "{v}"', "{n}='{v}'", '{n}="{v}"')
        kind = rng.integers(14)
        if kind > 11:
            return pick("{v}", "key {v}", "value {v}"), draw(low + up + pick("", "+/"), int(rng.integers(20, 64)))
        if kind < 7:
            value = pick(
                draw(hexes, 40), draw(hexes, 32), draw(hexes, int(rng.integers(12, 65))), draw(alnum, int(rng.integers(10, 44))),
                draw(alnum + "+/", 40), draw(alnum + "!#%_-", int(rng.integers(8, 20))), draw(low, 6) + draw(digits, 3), draw(hexes, 18),
                draw(low + up, int(rng.integers(20, 44))), draw(low + up, int(rng.integers(10, 20))),
            )
            return notation.replace("{n}", name), value
        value = pick(
            "AKIA" + draw(up + digits, 16), "ghp_" + draw(alnum, 36), "sk_live_" + draw(alnum, 24), "xoxb-" + draw(digits, 12) + "-" + draw(alnum, 24),
            "AIza" + draw(alnum + "_-", 35), "glpat-" + draw(alnum, 20), "npm_" + draw(alnum, 36), "SG." + draw(alnum, 22) + "." + draw(alnum, 43),
            "eyJ" + draw(alnum, 20) + ".eyJ" + draw(alnum, 40) + "." + draw(alnum + "_-", 43),
        )
        return pick("{v}", notation.replace("{n}", name), "Authorization: Bearer {v}", "key {v}"), value

    def harmless() -> tuple[str, str]:
        octets = ".".join(str(v) for v in rng.integers(0, 256, 4))
        uuid = "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12))
        name = pick("token", "password", "secret", "api_key", "pwd", "auth", "Password", "access key")
        return pick(
            ("{v}", draw(digits, 16)), ("{v}", draw(digits, 16)), ("{v}", octets), ("{v}", octets),
            ("+1 (" + draw(digits, 3) + ") {v}", "555-" + draw(digits, 4)), ("{v}", "+" + draw(digits, 11)),
            (draw(low, 6) + ".{v}.com", draw(digits, 2)  + "@mail" + draw(digits, 1) + ".example"), ("x.{v}", draw(digits, 2) + "mail" + draw(digits, 1) + ".example.com"),
            ("id {v}", uuid), ("request {v} done", uuid), ("commit {v}", draw(hexes, 40)), ("commit {v}", draw(hexes, int(rng.integers(8, 13)))), ("sha256: {v}", draw(hexes, 64)), ("md5 {v}", draw(hexes, 32)), ("checksum={v}", draw(hexes, 32)),
            ("version {v}", f"v{draw(digits, 1)}.{draw(digits, 2)}.{draw(digits, 1)}-beta"), ("on {v}", f"20{draw(digits, 2)}-0{draw(digits, 1)}-1{draw(digits, 1)}"), ("at {v}", f"20{draw(digits, 2)}-01-02T0{draw(digits, 1)}"),
            ("see https://{v}", draw(low, 7) + ".com/" + draw(low, 5) + "/" + draw(digits, 4)), ("file {v}", "src/" + draw(low, 6) + "/" + draw(low, 5) + draw(digits, 2) + ".py"), ("ISBN {v}", "978-" + draw(digits, 1) + "-" + draw(digits, 4) + "-" + draw(digits, 4)),
            ("order {v}", draw(up, 2) + "-" + draw(digits, 8)), ("{v}", draw(low, int(rng.integers(6, 14))) + draw(digits, int(rng.integers(1, 3)))), ("{v}", draw(up, 3) + draw(digits, 5)), ("total {v}", draw(digits, 8)), ("{v}", draw(low, 4) + "_" + draw(low, 5) + "_" + draw(digits, 1)),
            ("{v}", word() + "".join(word().title() for _ in range(rng.integers(1, 5)))), ("{v}", "".join(word().title() for _ in range(rng.integers(2, 5)))), ("{v}", (word() + word() + word() + word())[:40]), ("{v}", "/".join(word() for _ in range(rng.integers(3, 6)))), ("{v}", "-".join(word() for _ in range(rng.integers(3, 6)))), ("{v}", "_".join(word() for _ in range(rng.integers(3, 6))).upper()),
            (name + ": {v}", pick("required", "changeme", "none", "null", "true", "false", "hidden", "string", "example", "optional")), (name + " = {v}", pick("None", "null", "os.environ", "getenv", "input()", "config.get", "args.token", "settings")), (name + "={v}", pick("${PASSWORD}", "xxxxxxxx", "********", "<token>", "your_token_here", "placeholder")), ("the " + name + " {v}", pick("that", "field", "must", "which", "should", "is", "reset", "policy", "ring", "economy") + draw(low, int(rng.integers(0, 6)))),
        )

    out, labels = [], []
    for i in range(n):
        real = i % 2 == 0
        shape, value = secret() if real else harmless()
        before, after = shape.split("{v}")
        context = contexts[rng.integers(len(contexts))] if contexts else b""
        place = int(rng.integers(0, len(context) + 1))
        near = context[max(0, place - 60) : place] + pick(b" ", b"\n", b" ") if context else b""
        near += before.encode()
        text = near + value.encode() + after.encode() + pick(b" ", b"\n", b". ", b"") + context[place : place + 40]
        out.append((text, len(near), len(near) + len(value.encode())))
        labels.append(real)
    return out, np.array(labels)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss of some windows by every weight of the network."""
    z, hidden, features, active, best = net.forward(x)
    dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
    grads = {"out": hidden.T @ dz, "out_bias": np.array([dz.sum()])}
    dh = np.outer(dz, net.out) * (hidden > 0)
    grads["dense"], grads["dense_bias"] = features.T @ dh, dh.sum(axis=0)
    dp = (dh @ net.dense.T)[:, : 3 * FILTERS] * (active > 0)
    grads["offset"] = dp.reshape(len(x), 3, FILTERS).sum(axis=(0, 1))
    gf = np.zeros_like(net.filters)
    columns = np.broadcast_to(np.arange(FILTERS), (len(x), FILTERS))
    for r in range(3):
        g = dp[:, r * FILTERS : (r + 1) * FILTERS]
        for o in range(WIDTH):
            np.add.at(gf[o], (np.take_along_axis(x, best[r] + o, 1), columns), g)
    grads["filters"] = gf
    return grads


def train(findings: list[tuple[bytes, int, int]], labels: np.ndarray, epochs: int = 8, seed: int = 5, batch: int = 64) -> Network:
    """Fit the network (Adam on the log loss), calibrate it on held-out findings, and set the threshold.

    A third is held out: the logit's scale and shift are those of the logistic regression of its labels (Platt), and
    the threshold of each kind, values with digits and without, is the largest at which ``RECALL`` of its secrets are
    found; a kind without secrets has 0.5.
    """
    rng = np.random.default_rng(seed)
    x = np.stack([windows(*f)[0] for f in findings])
    y = labels.astype(float)
    held = np.arange(len(y)) % 6 >= 4
    pooled = 3 * FILTERS + 2
    net = Network(
        rng.normal(0, 0.1, (WIDTH, 192, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, (pooled, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0
    )
    weights = {"filters": net.filters, "offset": net.offset, "dense": net.dense, "dense_bias": net.dense_bias, "out": net.out}
    weights["out_bias"] = np.zeros(1)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    rows, step = np.flatnonzero(~held), 0
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, len(rows), batch):
            part = order[at : at + batch]
            net.out_bias = float(weights["out_bias"][0])
            grads = gradients(net, x[part], y[part])
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                rate = 0.004 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    net.out_bias = float(weights["out_bias"][0])
    z = np.concatenate([net.forward(x[held][i : i + 512])[0] for i in range(0, int(held.sum()), 512)])
    t, a, b = y[held], 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, [((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    net.scale, net.shift = float(max(a, 1e-3)), float(b)
    p, bare = net.probability(x[held]), np.array([digitless(*f) for f in findings])[held]
    found = [np.sort(p[(t == 1) & (bare == kind)]) for kind in (False, True)]
    net.thresholds = tuple(float(f[int((1 - RECALL) * len(f))]) if len(f) else 0.5 for f in found)
    return net


def context_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[bytes]:
    """Up to ``CONTEXT_DOCS`` spans of 400 characters, of documents drawn by a hash of their id, at hashed places."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    drawn = named.select("id").orderBy(F.xxhash64("id"), "id").limit(CONTEXT_DOCS).distinct()
    place = F.pmod(F.xxhash64("id", F.lit(2)), F.greatest(F.lit(1), F.length("text") - 399)) + 1
    rows = (
        named.join(F.broadcast(drawn), "id")
        .filter("text IS NOT NULL")
        .select("id", F.substring(F.col("text"), place.cast("int"), F.lit(400)).alias("span"))
        .dropDuplicates(["id"])
        .collect()
    )
    return [r.span.encode() for r in sorted(rows, key=lambda r: r.id)]


_OUT = "doc_id long, start int, length int, preview string, probability double, secret boolean"


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, preview, probability, secret)`` of every candidate of every document.

    ``start`` and ``length`` count characters; ``preview`` shows the first four characters only. A candidate is a
    secret where its calibrated probability (the greatest of its windows) reaches the recall-constrained threshold of
    its kind.

    Defined cases: null and empty texts have no candidate and no row; a text and a candidate of any length are read
    whole; a null id stays null and an id that is no integer is a ValueError; a probability at the threshold is a
    secret; repeated rows give repeated findings; an empty table gives no rows; other columns are not read, whatever
    their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def find(batches):
        own = shared.value
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            raw, at = as_bytes(batch.column(1))
            found, xs, owner, bare = [], [], [], []
            for i in range(batch.num_rows):
                text = raw[at[i] : at[i + 1]].tobytes()
                head, last = 0, 0
                for s, e in candidates(text):
                    w = windows(text, s, e)
                    head, last = head + len(text[last:s].decode(errors="replace")), s
                    value = text[s:e].decode(errors="replace")
                    owner += [len(found)] * len(w)
                    found.append((ids[i], head, len(value), value[:4]))
                    bare.append(digitless(text, s, e))
                    xs.append(w)
            if not found:
                continue
            p = np.zeros(len(found))
            np.maximum.at(p, np.array(owner), own.probability(np.concatenate(xs)))
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.record_batch(
                [*columns, pa.array(p), pa.array(own.secret(p, np.array(bare)))],
                ["doc_id", "start", "length", "preview", "probability", "secret"],
            )

    narrow = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.filter("text IS NOT NULL").mapInArrow(find, _OUT)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its probability of being a secret."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(*labelled_findings(context_sample(docs))))
