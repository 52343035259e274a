"""Personal data: patterns, and a skip-chain conditional random field that adds what looks and repeats alike.

Nodes of the field are a document's tokens that hold a digit or "@"; names and other words are none. A node is an
e-mail address, an IP address, a card, a phone number, a secret (a key or password), or nothing. Potentials: the
token's shape, words before it that announce a kind, and its neighbours' shapes; agreement with the next node nearby
(the chain); agreement with the last earlier node of the same letters and digits, or the same last digits, however
far away (the skip edges; a token that stands a thousand times has a thousand edges, not half a million). Loopy
message passing gives each node's marginal over the kinds, so all sightings of a token in a text get one kind, also
where it is written in a way that no pattern matches.

Weights are learned here by pseudo-likelihood: softmax regression on a node's features and on its neighbours' labels,
where the patterns' matches (and values behind a word such as "password =") are the labels. It is fitted on a bounded
sample: NODES_PER_TEXT nodes at most of about TRAIN_TEXTS different texts, those with the smallest hashes. Labelling
then covers every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
#: States of a node: nothing, then the kinds.
STATES = len(KINDS) + 1
TRAIN_TEXTS, NODES_PER_TEXT = 4000, 16
#: Marginal from which a node becomes a span of its kind.
LIKELY = 0.95
#: Tokens between two nodes of the chain at most.
NEAR = 3
#: Last digits that make two nodes alike.
TAIL = 7
ROUNDS, DAMPING = 30, 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[^A-Za-z0-9+(\x80-\U0010FFFF]+|[^A-Za-z0-9)\x80-\U0010FFFF]+$")
_KEY = re.compile(r"[\W_]+")
_SECRET = re.compile(r"""\b(?:token|secret|password|passwd|api[_-]?key)\b[\x20"':=]{1,6}([A-Za-z0-9+/_=-]{16,})""", re.IGNORECASE)
#: Words that announce a kind, in the CUE_CHARS characters before a token.
_CUES = tuple(re.compile(rf"\b(?:{w})\b", re.IGNORECASE) for w in ("e-?mail|mailto", "ip|host|server", "card|visa|mastercard", "tel|phone|call|fax", "token|secret|password|passwd|key"))
CUE_CHARS = 24
_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches from left to right. Each "@" is looked at once, so long runs without one cost nothing."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        if at >= after:
            start = at
            while start > after and text[start - 1] in _LOCAL_BYTES:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                out.append((start, m.end()))
                after = m.end()
        at = text.find("@", max(at + 1, after))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches that pass their checks, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(token: str) -> list[float]:
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    dots, dashes = token.count("."), token.count("-")
    upper = sum(c.isupper() for c in token)
    return [
        1.0, float("@" in token), float("@" in token and dots > 0), digits / n, letters / n, min(digits, 20) / 20, min(n, 40) / 40, float(n > 24), min(dots, 4) / 4, float(dots == 3 and not letters),
        min(dashes, 4) / 4, float(token[0] == "+"), float(token[0] == "("), upper / n, float(14 <= digits <= 19 and not letters), float(digits > 0 and letters > 0), float(digits == n), float(digits <= 2),
    ]


SHAPES = len(_shape("0")) + len(_CUES)
#: Own shape and cues, those of the node before and after, if near.
FEATURES = 3 * SHAPES
WEIGHTS = FEATURES * len(KINDS) + 2


class Field:
    """Nodes of one text: spans, features and both kinds of edges (pairs of node numbers)."""

    def __init__(self, text: str):
        spans, at = [], []
        for k, m in enumerate(_TOKEN.finditer(text)):
            if not _SIGN.search(m[0]):
                continue
            start, end = m.start(), m.end()
            if edge := _EDGE.match(m[0]):
                start += edge.end()
            if start < end and (tail := re.search(r"[^A-Za-z0-9)\x80-\U0010FFFF]+$", text[start:end])):
                end = start + tail.start()
            if start < end and _SIGN.search(text, start, end):
                spans.append((start, end))
                at.append(k)
        self.spans = np.array(spans, np.int64).reshape(-1, 2)
        n = len(spans)
        shapes = np.array([_shape(text[a:b]) + [float(c.search(text, max(0, a - CUE_CHARS), a) is not None) for c in _CUES] for a, b in spans]).reshape(n, SHAPES)
        close = np.diff(np.array(at)) <= NEAR if n else np.zeros(0, bool)
        before, after = np.zeros((n, SHAPES)), np.zeros((n, SHAPES))
        before[1:][close], after[:-1][close] = shapes[:-1][close], shapes[1:][close]
        self.features = np.concatenate([shapes, before, after], 1)
        left = np.flatnonzero(close)
        self.chain = np.stack([left, left + 1], 1)
        last: dict[str, int] = {}
        skips = set()
        for i, (a, b) in enumerate(spans):
            key = _KEY.sub("", text[a:b]).casefold()
            digits = "".join(c for c in key if c.isdigit())
            for name in (key, f"#{digits[-TAIL:]}") if len(digits) >= TAIL and len(digits) * 2 > len(key) else (key,):
                if name in last and not (last[name] == i - 1 and close[i - 1]):
                    skips.add((last[name], i))
                last[name] = i
        self.skip = np.array(sorted(skips), np.int64).reshape(-1, 2)


def labelled_spans(text: str) -> list[tuple[int, int, int]]:
    """What the patterns and words before a value say: (start, kind, end), the labels of the field."""
    return sorted(base_spans(text) + [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)])


def states(spans: np.ndarray, labels: list[tuple[int, int, int]]) -> np.ndarray:
    """State of each span: that of the first label that it overlaps, or nothing."""
    out = np.zeros(len(spans), np.int64)
    at = 0
    for i, (a, b) in enumerate(spans.tolist()):
        while at < len(labels) and labels[at][2] <= a:
            at += 1
        for s, k, e in labels[at:]:
            if s >= b:
                break
            if e > a:
                out[i] = k + 1
                break
    return out


def covered(spans: np.ndarray, base: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each span overlaps one of base."""
    out = np.zeros(len(spans), bool)
    if not base or not len(spans):
        return out
    edges = sorted((s, e) for s, _, e in base)
    starts = np.array([s for s, _ in edges])
    reach = np.maximum.accumulate(np.array([e for _, e in edges]))
    k = np.searchsorted(starts, spans[:, 1], "left") - 1
    return (k >= 0) & (reach[np.maximum(k, 0)] > spans[:, 0])


def agreement(edges: np.ndarray, state: np.ndarray) -> np.ndarray:
    """For each node how many neighbours are in each state."""
    out = np.zeros((len(state), STATES))
    if len(edges):
        np.add.at(out, (edges[:, 0], state[edges[:, 1]]), 1.0)
        np.add.at(out, (edges[:, 1], state[edges[:, 0]]), 1.0)
    return out


def fit(x: np.ndarray, chain: np.ndarray, skip: np.ndarray, state: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights (features for each kind, then the chain's and the skip edges' pull) by Newton's method on the
    penalised pseudo-likelihood. Pulls below 0 are 0, as agreement is what they stand for."""
    kinds, f = len(KINDS), x.shape[1]
    y = np.eye(STATES)[state]
    use = [chain, skip]
    keep = [0, 1]
    while True:
        w = np.zeros(f * kinds + len(keep))
        edges = [use[k] for k in keep]
        for _ in range(40):
            score = np.zeros((len(x), STATES))
            score[:, 1:] = x @ w[: f * kinds].reshape(kinds, f).T
            for a, e in zip(w[f * kinds :], edges, strict=True):
                score += a * e
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            mean = [(p * e).sum(axis=1) for e in edges]
            grad = np.r_[((y - p)[:, 1:].T @ x).ravel(), [((y * e).sum(axis=1) - m).sum() for e, m in zip(edges, mean, strict=True)]] - penalty * w
            hess = penalty * np.eye(len(w))
            for k in range(kinds):
                for j in range(k + 1):
                    block = (x * (p[:, k + 1] * ((k == j) - p[:, j + 1]))[:, None]).T @ x
                    hess[k * f : (k + 1) * f, j * f : (j + 1) * f] += block
                    if k != j:
                        hess[j * f : (j + 1) * f, k * f : (k + 1) * f] += block.T
                for at, (e, m) in enumerate(zip(edges, mean, strict=True), f * kinds):
                    column = x.T @ (p[:, k + 1] * (e[:, k + 1] - m))
                    hess[k * f : (k + 1) * f, at] += column
                    hess[at, k * f : (k + 1) * f] += column
            for i, (e, m) in enumerate(zip(edges, mean, strict=True)):
                for j, (g, n) in enumerate(zip(edges, mean, strict=True)):
                    hess[f * kinds + i, f * kinds + j] += ((p * e * g).sum(axis=1) - m * n).sum()
            step = np.linalg.solve(hess, grad)
            w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        pulls = w[f * kinds :]
        if (pulls >= 0).all():
            out = np.zeros(f * kinds + 2)
            out[: f * kinds] = w[: f * kinds]
            out[[f * kinds + k for k in keep]] = pulls
            return out
        keep = [k for k, a in zip(keep, pulls, strict=True) if a >= 0]


def marginals(field: Field, weights: np.ndarray) -> np.ndarray:
    """Probability of each state of each node by loopy message passing; all messages are sent together."""
    n = len(field.spans)
    own = np.zeros((n, STATES))
    own[:, 1:] = field.features @ weights[: FEATURES * len(KINDS)].reshape(len(KINDS), FEATURES).T

    def soft(score: np.ndarray) -> np.ndarray:
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    edges = np.concatenate([field.chain, field.skip])
    if not len(edges):
        return soft(own)
    pull = np.expm1(np.concatenate([np.full(len(field.chain), weights[-2]), np.full(len(field.skip), weights[-1])]))
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    pull, back = np.r_[pull, pull][:, None], np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    message = np.zeros((len(source), STATES))

    def gathered() -> np.ndarray:
        return own + np.stack([np.bincount(target, message[:, k], n) for k in range(STATES)], axis=1)

    for _ in range(ROUNDS):
        fresh = np.log1p(pull * soft(gathered()[source] - message[back]))
        fresh -= fresh.mean(axis=1, keepdims=True)
        if np.abs(fresh - message).max() < 1e-6:
            break
        message = DAMPING * message + (1 - DAMPING) * fresh
    return soft(gathered())


def training_rows(docs: DataFrame, texts: int = TRAIN_TEXTS) -> DataFrame:
    """x (features), chain and skip (neighbours in each state) and y (state) of the sampled nodes. The share of texts
    to take is found from how many different ones there are; equal texts count once."""
    held = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    share = min(1.0, texts / max(1, held.agg(F.approx_count_distinct("h")).first()[0]))
    taken = held.where(F.shiftrightunsigned("h", 11) < F.lit(int(share * (1 << 53)))).dropDuplicates(["h"]).select("text")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for text in batch.column(0).to_pylist():
                field = Field(text)
                n = len(field.spans)
                if not n:
                    continue
                state = states(field.spans, labelled_spans(text))
                seed = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                chosen = np.sort(np.random.default_rng(seed).permutation(n)[:NODES_PER_TEXT])
                for into, value in zip(parts, (field.features, agreement(field.chain, state), agreement(field.skip, state), state), strict=True):
                    into.append(value[chosen])
            lists = [pa.array([row.astype(np.float32).tolist() for v in own for row in v], pa.list_(pa.float32())) for own in parts[:3]]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([int(s) for v in parts[3] for s in v], pa.int32())], ["x", "chain", "skip", "y"])

    return taken.mapInArrow(nodes, "x array<float>, chain array<float>, skip array<float>, y int")


def learned_weights(docs: DataFrame, texts: int = TRAIN_TEXTS) -> np.ndarray:
    """Weights from the sampled nodes, about texts x NODES_PER_TEXT at most; zeros, which add nothing, if there are
    none."""
    sample = sorted(training_rows(docs, texts).collect())
    if not sample:
        return np.zeros(WEIGHTS)
    x, chain, skip = (np.array([r[k] for r in sample], float) for k in ("x", "chain", "skip"))
    return fit(x, chain, skip, np.array([r.y for r in sample]))


def find_personal_data(docs: DataFrame, weights: np.ndarray | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end: code points, end exclusive; base: whether a pattern found it), by start, then
    kind as in KINDS.

    Null and empty texts have no spans; repeated rows repeat them; extra columns are ignored; an empty table
    gives an empty one. Spans that the field adds never overlap a pattern's match.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(learned_weights(rows) if weights is None else weights)  # WEIGHTS numbers

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, ends, base, sizes = [], [], [], [], [0]
            for value in batch.column(1).to_pylist():
                spans = []
                if value and _SIGN.search(value):
                    found = base_spans(value)
                    spans = [(s, k, e, True) for s, k, e in found]
                    field = Field(value)
                    if len(field.spans) and sent.value.any():
                        told = marginals(field, sent.value)
                        kind = told[:, 1:].argmax(axis=1)
                        chosen = (told[np.arange(len(kind)), kind + 1] >= LIKELY) & ~covered(field.spans, found)
                        spans = sorted(spans + [(int(s), int(k), int(e), False) for (s, e), k in zip(field.spans[chosen], kind[chosen], strict=True)])
                for s, k, e, b in spans:
                    kinds.append(KINDS[k])
                    starts.append(s)
                    ends.append(e)
                    base.append(b)
                sizes.append(len(kinds))
            items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(base, pa.bool_())], ["kind", "start", "end", "base"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)], ["doc_id", "spans"])

    return rows.mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def op9_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = joined.format("filter(spans, s -> s.base)")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(F.expr(base), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
