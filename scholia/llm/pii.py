"""PII: base rules, and weak supervision for what they miss.

Base spans (email, ip, card, phone) follow fixed rules and are always kept. Beyond them, a wide generator proposes
candidate spans (other spellings of the four kinds, and secrets such as keys and passwords). Labelers by pattern,
gazetteer and context vote on each candidate; expectation-maximisation estimates every labeler's reliability without
labels, and a logistic span classifier is trained on the posteriors. Candidates it accepts join the base spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import map_rows, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Bounds of what the fit reads: documents that are sampled (about), and candidates of them.
SAMPLE, CANDIDATES = 20_000, 50_000
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; by way of the @ signs, so a long word without one costs nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if len(m[0]) <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *x) for x in ips(text)] + [("card", *x) for x in cards(text)]
        if "+" in text:
            found += [("phone", *x) for x in phones(text)]
    return found


# --- candidates beyond the base rules -------------------------------------------------------------------------------

_WIDE = [
    ("email", re.compile(r"(?<![\w.-])[A-Za-z0-9][A-Za-z0-9._-]*+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?:(?:\.| "
         r"?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot )[A-Za-z0-9-]++)++", re.I)),
    ("email", re.compile(r"(?<![\w.-])[A-Za-z0-9][A-Za-z0-9._-]*+ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\) ?|00[1-9][0-9]{0,2}[ .-])?[0-9]{2,4}[ .-][0-9]{2,4}[ .-][0-9]{2,5}(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[A-Z]{4}[0-9A-Z]{12,}+|[a-z]{2,4}_[0-9A-Za-z]{16,}+|[0-9a-f]{16,}+)(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<=[=:\"' ])[0-9A-Za-z+/_-]{12,}+={0,2}(?=[\s\"',;.]|$)")),
]
#: Gazetteers: words that stand near personal data of a kind.
NEAR = {
    "email": frozenset("mail email e-mail contact write courriel correo kontakt".split()),
    "ip": frozenset("ip host address server ping adresse".split()),
    "card": frozenset("card visa mastercard credit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon telefono".split()),
    "secret": frozenset("password passwd pwd token secret key api apikey auth credential".split()),
}
TOP_LEVEL = frozenset("com org net edu gov de fr es uk io info example".split())
_WORD = re.compile(r"[^\W\d_][\w-]*")
LABELERS = ("shape", "checksum", "gazetteer", "assignment", "entropy", "isolated", "mixed")


def candidates(text: str, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Spans that might be personal data and that no base span touches; the first pattern in the list wins an overlap. Each
    pattern's matches are merged with the sorted intervals so far, so that the work is linear in the spans."""
    spelled, digits = re.search(r"[(\[{]at[)\]}]| dot ", text, re.I), _DIGIT.search(text)
    if not spelled and not digits:
        return []
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in (base_spans(text) if base is None else base)):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = []
    for kind, pattern in _WIDE:
        if not (spelled if kind == "email" else digits):
            continue
        i, new = 0, []
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind != "email" and not _DIGIT.search(m[0]):
                continue
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or b <= taken[i][0]:
                new.append((a, b))
        if new:
            out += [(kind, *x) for x in new]
            taken = sorted(taken + new)  # two sorted runs: linear
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def votes(kind: str, text: str, a: int, b: int) -> list[int]:
    """Each labeler's vote on a candidate, in the order of LABELERS: 1 personal, -1 not, 0 abstains."""
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    d, low = _digits(s), before.lower()
    near = bool(NEAR[kind] & {w.lower() for w in _WORD.findall(low)})
    shape = {
        "email": 1 if re.search(r"\(at\)|\[at\]|\{at\}", s, re.I) and s.lower().rsplit(".", 1)[-1].rsplit("dot",
            1)[-1].strip(" )]}") in TOP_LEVEL else 0,
        "ip": 1, "card": 1 if re.fullmatch(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}", s) else -1, "phone": 1
            if s.startswith(("(", "00")) else 0,
        "secret": 1 if re.fullmatch(r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|sk_[0-9A-Za-z]{16,}", s) else 0,
    }[kind]
    checksum = (1 if luhn(d) else -1) if kind == "card" else (1 if 9 <= len(d) <= 15 else -1) if kind == "phone" else 0
    assigned = 1 if re.search(r"[\w\"']\s*[=:]\s*[\"']?$", before) else -1 if kind == "secret" and before[-1:].isspace() and not near else 0
    entropy = (1 if _entropy(s) >= 3.2 else -1) if kind == "secret" else 0
    isolated = 1 if (not before or before[-1] in " \n\t=:\"'(,;") and (not after or after[0] in " \n\t\"'),;.") else -1
    mixed = (1 if d and re.search("[A-Za-z]", s) else -1) if kind == "secret" else -1 if kind == "email" and " at " in s and not near else 0
    return [shape, checksum, 1 if near else 0, assigned, entropy, isolated, mixed]


def features(kind: str, text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    return [float(kind == k) for k in KINDS] + [float(v) for v in votes(kind, text, a, b)] + [math.log1p(b - a),
        sum(map(str.isdigit, s)) / len(s), _entropy(s) / 4]


#: What is believed before any candidate is seen: a labeler is right in 7 of 10 votes, and it takes 1.5 such votes more for
#: than against to accept a span. The classifier's weights are drawn to these by the ridge, so one rule holds for any data.
RIGHT, OF, NEEDED = 7, 10, 1.5
_VOTE = math.log(RIGHT / (OF - RIGHT))
BELIEF = [-NEEDED * _VOTE] + [0.0] * len(KINDS) + [_VOTE] * len(LABELERS) + [0.0] * 3


@dataclass
class SpanModel:
    """What the weak supervision learned: labelers' reliabilities and the classifier's weights."""

    reliability: dict[str, float] = field(default_factory=dict)
    prior: float = 0.5
    weights: list[float] = field(default_factory=lambda: list(BELIEF))
    threshold: float = 0.5

    def accepts(self, kind: str, text: str, a: int, b: int) -> bool:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features(kind, text, a, b), strict=True))
        return z >= math.log(self.threshold / (1 - self.threshold))


def estimate(v: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over votes (rows x labelers, in -1, 0, 1): posteriors, accuracies of the labelers where they vote, and the
    prior. One-coin model; starts at the majority vote and accuracies of 0.7, which also fixes which class is which."""
    accuracy, prior = np.full(v.shape[1], RIGHT / OF), 0.5
    post = np.full(len(v), 0.5)
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        post = 1 / (1 + np.exp(-np.clip(v @ weight + np.log(prior / (1 - prior)), -30, 30)))
        right = (v == 1).T @ post + (v == -1).T @ (1 - post)
        accuracy = np.clip((right + RIGHT) / ((v != 0).sum(0) + OF), 0.55, 0.98)
        prior = float(np.clip(post.mean(), 0.05, 0.95)) if len(v) else 0.5
    return post, accuracy, prior


def fit(rows: list[tuple[list[int], list[float]]], rounds: int = 300) -> SpanModel:
    """The span classifier from (votes, features) of candidates, however few: what they don't show stays as believed."""
    rows = sorted(rows)
    belief = np.array(BELIEF)
    v = np.array([r[0] for r in rows], float).reshape(len(rows), len(LABELERS))
    x = np.array([[1.0, *r[1]] for r in rows]).reshape(len(rows), len(belief))
    post, accuracy, prior = estimate(v)
    w = belief.copy()
    for _ in range(rounds):  # logistic regression on soft labels by Newton's steps, with a ridge towards the belief
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (post - p) - (w - belief))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return SpanModel(dict(zip(LABELERS, accuracy.tolist(), strict=True)), prior, w.tolist())


def train(docs: DataFrame, sample: int = SAMPLE, most: int = CANDIDATES) -> SpanModel:
    """Fits the model on about `sample` documents at most, chosen by a hash of the id (those without an id or a text are
    passed over), each text once, and of their candidates on those with the `most` least hashes of text and place. So the
    texts that are scanned and the votes that reach the driver are bounded, whatever copies a text has."""
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    share = min(1.0, sample / max(1, docs.count()))
    places = 1_000_003
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(places)) < int(places * share) + 1)
    chosen = chosen.withColumn("key", F.xxhash64("text")).dropDuplicates(["key"]).select("text")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict = {"h": [], "v": [], "x": []}
            for t in batch.column("text").to_pylist():
                seed = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
                for k, a, b in candidates(t):
                    out["h"].append(xxhash.xxh64_intdigest(f"{k}:{a}:{b}", seed) - (1 << 63))
                    out["v"].append(votes(k, t, a, b))
                    out["x"].append(features(k, t, a, b))
            return out

        return step

    found = map_rows(chosen, make, "h long, v array<int>, x array<double>").orderBy("h").limit(most)
    return fit([(list(r.v), list(r.x)) for r in found.collect()])


def all_spans(text: str, model: SpanModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans; base spans and the model's, by kind as listed, then start."""
    base = base_spans(text)
    more = [x for x in candidates(text, base) if model.accepts(x[0], text, x[1], x[2])]
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with each span replaced by its kind in brackets; of overlapping spans the first, extended to the union."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) for each row of docs (doc_id, text), of
    which no other column is read, whatever its name. Texts are read whole, in time linear in their length and spans."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out = {"doc_id": batch.column("doc_id"), **{f"n_{k}": [] for k in BASE}, "base_sha256": [], "spans": []}
            for t in batch.column("text").to_pylist():
                base, both = all_spans(t or "", model)
                for k in BASE:
                    out[f"n_{k}"].append(sum(x[0] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(both))
            return out

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, " + "".join(f"n_{k} long, "
        for k in BASE) + "base_sha256 string, spans string")


def redact_pii(docs: DataFrame, model: SpanModel) -> DataFrame:
    """`docs` (columns of documents) with personal data masked in text and n_chars following; null text stays null."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            new = [None if t is None else redact(t, all_spans(t, model)[1]) for t in batch.column("text").to_pylist()]
            return {n: batch.column(n) for n in ("doc_id", "lang", "source")} | {"text": new, "n_chars": [None if t is None else len(t) for t in new]}

        return step

    return map_rows(docs.select("doc_id", "text", "lang", "source"), make, "doc_id long, text string, lang string, source string, n_chars long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document, however long. Further columns of the table aren't read.

    Null and empty texts give zero counts, the digest of an empty string and empty spans; repeated rows are each
    reported; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, train(docs))
