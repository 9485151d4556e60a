"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Strict patterns give the base spans, which always stay. Looser ones give candidates: addresses spelled out, national
phone numbers, card numbers of other lengths or in need of context, longer internet addresses. Labelers (pattern,
gazetteer, checksum, context, surroundings) vote yes, no or nothing on every span, base or not. How often each combination
of votes comes is counted over all documents; expectation-maximisation on these counts estimates each labeler's
reliability without labels, and its posteriors train a logistic span classifier on votes and shape features. A
candidate that it accepts is a span.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsheaf.llm.text import slices
from rowsheaf.plans.files import materialise

KINDS = ("email", "ip", "card", "phone")
LABELERS = 4
CONTEXT_CHARS = 40
EM_ROUNDS = 50

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its start only: where that fails, so does every later start.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Candidates beyond them.
_AT = r"[\x20]?(?:\[at\]|\(at\)|\{at\}|[\x20]at[\x20])[\x20]?"
_DOT = r"[\x20]?(?:\[dot\]|\(dot\)|\{dot\}|[\x20]dot[\x20]|\.)[\x20]?"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_HAS_AT = re.compile(r"[\[({]at[\])}]|[\x20]at[\x20][A-Za-z0-9-]+[\x20]dot[\x20]")
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_LONG_IP = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")

# Gazetteers.
_TOP_LEVEL = frozenset("com org net edu gov mil int info biz name io co uk us ca de fr es it nl eu ch at be se no dk fi pl pt ru cn jp in br au nz mx".split())
_CARD_STARTS = re.compile(r"3[47]|4|5[1-5]|2[2-7]|6(?:011|5)")
_AREA = re.compile(r"[2-9][0-9]{2}")
# Words that speak for and against a kind, before the span.
_FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|contact|mail|write|reach|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|cc|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|telefon|tel[eé]fono)\b"),
}
_AGAINST = re.compile(r"(?i)\b(?:version|release|section|chapter|order|isbn|issn|invoice|serial|figure|table|page|build|id)\b[^0-9A-Za-z]*$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """The leftmost addresses. Each has an @, and starts where the run of local characters before it does."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
                at = text.find("@", done)
                continue
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind and start; places are code points."""
    spans = [(0, *s) for s in _emails(text)]
    spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := _digits(m[0])) <= 19 and _luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser spans that touch no base span; those of a kind don't overlap."""
    found = []
    if _HAS_AT.search(text):
        found += [(0, *m.span()) for m in _SPELLED.finditer(text) if "@" not in m[0]]
    if ":" in text:
        found += [(1, *m.span()) for m in _LONG_IP.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(_digits(m[0])) <= 19:
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in _NATIONAL.finditer(text)]
    if not found:
        return []
    starts = np.array(sorted((s, e) for _, s, e in base) or [(-1, -1)])
    far = np.maximum.accumulate(starts[:, 1])

    def touches(start, end):
        i = int(np.searchsorted(starts[:, 0], end)) - 1
        return i >= 0 and far[i] > start

    return [c for c in found if not touches(c[1], c[2])]


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    """0 no vote, 1 yes, 2 no of each labeler: pattern, gazetteer or checksum, context, surroundings.

    The pattern says yes to what the strict one takes, the surroundings only no, to pieces of longer strings.
    """
    own, name = text[start:end], KINDS[kind]
    digits = _digits(own)
    pattern = 1 if base else 0
    if kind == 0:
        gazetteer = 1 if re.split(r"[^A-Za-z0-9-]+", own)[-1].lower() in _TOP_LEVEL else 2
    elif kind == 1:
        gazetteer = 2 if own.startswith(("0.", "255.")) else 1
    elif kind == 2:
        gazetteer = 1 if _luhn(digits) and _CARD_STARTS.match(digits) else 2 if not _luhn(digits) else 0
    else:
        gazetteer = 1 if _AREA.fullmatch(digits[-10:-7]) else 2
    before = text[max(0, start - CONTEXT_CHARS) : start]
    context = 1 if _FOR[name].search(before) else 2 if _AGAINST.search(before) else 0
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    joined = any(c and (c.isalnum() or c in "_/=#@") for c in (left, right)) or (right in "-." and right != "" and text[end + 1 : end + 2].isalnum())
    return pattern, gazetteer, context, 2 if joined else 0


def _pattern(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """Kind, base or not, votes and shape features as one number."""
    own = text[start:end]
    code = kind * 2 + base
    for vote in votes(text, kind, start, end, base):
        code = code * 3 + vote
    n = len(_digits(own))
    return code * 8 + 4 * (" " in own or "(" in own) + 2 * ("-" in own or "." in own) + (n >= 10)


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, base, votes and shape features of pattern numbers."""
    shape = np.stack([(codes >> b) & 1 for b in range(3)], axis=1)
    rest, found = codes // 8, []
    for _ in range(LABELERS):
        found.append(rest % 3)
        rest = rest // 3
    return rest // 2, rest % 2, np.stack(found[::-1], axis=1), shape


def reliabilities(kinds: np.ndarray, ballots: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each ballot, and P(vote | truth) by kind, truth, labeler and vote, by EM on ballot counts.

    Starts from majority votes; one is added to every count, one more where labelers agree with the truth.
    """
    posterior = 1 / (1 + np.exp(-1.0 * ((ballots == 1).sum(axis=1) - (ballots == 2).sum(axis=1))))
    prior = np.zeros(len(KINDS))
    table = np.zeros((len(KINDS), 2, LABELERS, 3))
    for _ in range(rounds):
        for kind in range(len(KINDS)):
            own = kinds == kind
            for truth, weight in ((0, 1 - posterior), (1, posterior)):
                w = (weight * counts)[own]
                for labeler in range(LABELERS):
                    n = np.bincount(ballots[own, labeler], w, 3) + 1.0
                    n[1 if truth else 2] += 1.0
                    table[kind, truth, labeler] = n / n.sum()
            prior[kind] = ((posterior * counts)[own].sum() + 1) / (counts[own].sum() + 2)
        logs = np.log(table)
        rows = np.arange(LABELERS)
        score = np.log(prior / (1 - prior))[kinds] + np.array(
            [(logs[k, 1, rows, b] - logs[k, 0, rows, b]).sum() for k, b in zip(kinds, ballots)]
        ).reshape(len(kinds))
        posterior = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return posterior, table


def _features(codes: np.ndarray) -> np.ndarray:
    kinds, _, ballots, shape = _unpack(codes)
    one = [kinds == k for k in range(len(KINDS))]
    one += [(ballots[:, i] == v) for i in range(LABELERS) for v in (1, 2)]
    return np.stack([*one, *shape.T], axis=1).astype(np.float64)


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic regression over votes and shape features."""

    weights: np.ndarray

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(codes) @ self.weights, -30, 30)))


def train_classifier(codes: np.ndarray, counts: np.ndarray) -> SpanClassifier:
    """Newton steps on the EM posteriors of all spans, by their patterns; a ridge of one keeps it finite."""
    if not len(codes):
        return SpanClassifier(np.zeros(len(KINDS) + 2 * LABELERS + 3))
    kinds, _, ballots, _ = _unpack(codes)
    posterior, _ = reliabilities(kinds, ballots, counts)
    x, weights = _features(codes), np.zeros(len(KINDS) + 2 * LABELERS + 3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (counts * (posterior - p)) - weights
        curvature = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(weights))
        weights = weights + np.clip(np.linalg.solve(curvature, gradient), -5, 5)
    return SpanClassifier(weights)


def joined_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Personal data in every whole text.

    Returns one row per row of ``docs``: ``id_col``; ``n_email, n_ip, n_card, n_phone`` (long) and ``base_sha256`` of the
    base spans; ``spans``, all spans as ``kind:start:end`` joined by commas, by kind as listed, then start, in code points, end
    exclusive; ``n_added`` (long), how many of them the classifier has added. Null and empty texts have none. Repeated
    rows each give a row; other columns are not looked at. Texts are scanned once; what is shuffled are counts of patterns, of which
    there are at most a few thousand, and these alone come to the driver.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    base = base_spans(text)
                    more = candidate_spans(text, base)
                    rows.append((
                        [sum(s[0] == k for s in base) for k in range(len(KINDS))],
                        joined_spans(base),
                        [{"kind": k, "start": s, "end": e, "code": _pattern(text, k, s, e, own)} for group, own in ((base, True), (more, False)) for k, s, e in group],
                    ))
                spans = pa.array([r[2] for r in rows], pa.list_(_SPAN))
                digests = [hashlib.sha256(r[1].encode()).hexdigest() for r in rows]
                counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array(digests, pa.string()), spans],
                    ["_id", *[f"n_{k}" for k in KINDS], "base_sha256", "found"],
                )

    schema = f"_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + (
        ", base_sha256 string, found array<struct<kind: int, start: int, end: int, code: int>>"
    )
    scanned = materialise(source.mapInArrow(scan, schema), "pii-spans")
    seen = scanned.select(F.explode("found.code").alias("code")).groupBy("code").count().toPandas()
    codes, counts = seen["code"].to_numpy(np.int64), seen["count"].to_numpy(np.float64)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    model = train_classifier(codes, counts)
    _, base, _, _ = _unpack(codes)
    accepted = [int(c) for c, b, p in zip(codes, base, model.probability(codes)) if b or p >= least]

    kept = F.filter("found", lambda s: s["code"].isin(accepted)) if accepted else F.filter("found", lambda s: F.lit(False))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    n_base = sum(F.col(f"n_{k}") for k in KINDS)
    return scanned.select(
        F.col("_id").alias(id_col), *[f"n_{k}" for k in KINDS], "base_sha256",
        F.array_join(text, ",").alias("spans"), (F.size(ordered) - n_base).alias("n_added"),
    )


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())])
