"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The patterns find emails, IP addresses, card numbers and phone numbers in their full form; a later
mention in another form (a phone number without its country code, a card number with other
separators, the name part of an address) they miss. The field labels words that hold a digit or an
at sign, or that repeat the name part of an address of the same text. Node potentials come from the
word's shape and from cue words before it, chain potentials join neighbouring candidates, and skip
potentials join a word with the next one, however far, that is similar: equal but for case and
punctuation, with the same last digits, or one the name part of the other. Loopy belief propagation
passes messages along both kinds of edges for a fixed number of rounds, with the patterns' spans as
observed labels, so the evidence for one mention reaches all others of the document. Words labelled with a probability of at least
MIN_PROBABILITY become spans unless they touch a span that the patterns found.

Weights are fitted by pseudo-likelihood on at most SAMPLE_DOCS documents with candidates, of at
most SAMPLE_BYTES each (a bounded sample; the lowest hashes of doc_id). What the patterns find is
labelled with its kind, as is a word that they would find if it stood alone (of two numbers side by
side they find neither); and so that the field learns more than they know, each sampled text is
followed by later mentions of half of its own entities in other forms, which carry the same label, and by
as many strings of the same forms that repeat nothing, which carry none (second_mentions).

Defined cases: a null or empty text has no spans; a null doc_id stays null; repeated rows give
repeated results; other columns are ignored; without documents there is nothing to fit and all
weights stay zero, so only the patterns count. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_sample, keep_id, map_batches, bounded_batches

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 20_000
ROUNDS = 8
MIN_PROBABILITY = 0.9
#: Log odds of an observed label.
CERTAIN = 30.0

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: Words with a digit or at sign; the look-behind lets each word be tried once.
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_KEY = re.compile(r"[^0-9a-z@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Words that announce a kind, in its order.
CUES = (
    ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    ("ip", "host", "server", "address", "node"),
    ("card", "credit", "visa", "mastercard", "tarjeta", "carte", "karte"),
    ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind."""
    if not _ANY.search(text):
        return []
    out: list[Span] = []
    # an email starts where the run of local characters before its at sign does, so look from the
    # at sign backwards: the work stays linear on long runs
    end = seen = 0
    for m in _DOMAIN.finditer(text):
        part = text[max(end, seen) : m.start()]
        size = len(part) - len(part.rstrip(_LOCAL))
        seen = m.start() + 1
        if size:
            out.append((m.start() - size, 0, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field ---------------------------------------------------------------------------------
_CORE = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?", re.S)
_SHAPES = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    re.compile(r"\+[0-9]{1,3}"),
    re.compile(r"\([0-9]{3}\)"),
    re.compile(r"[0-9]{3}[-.][0-9]{4}"),
    re.compile(r"[0-9]+"),
    re.compile(r"[0-9]+(?:-[0-9]+)+"),
    re.compile(r"\+[0-9().-]{9,}"),
)
_CUE_OF = {word: kind for kind, words in enumerate(CUES) for word in words}
N_FEATURES = len(_SHAPES) + 13 + len(CUES)


def word_features(core: str) -> list[int]:
    """The features that hold for a word without the punctuation around it."""
    on = [0] + [1 + i for i, shape in enumerate(_SHAPES) if len(core) <= 320 and shape.fullmatch(core)]
    digits, k = _NOT_DIGIT.sub("", core), 1 + len(_SHAPES)
    on.append(k + min(6, (len(digits) + 2) // 3) if len(digits) < 14 else k + 7 + (len(digits) > 19))
    if 14 <= len(digits) <= 19:
        on.append(k + 9 + luhn(digits))
    if "@" in core:
        on.append(k + 11)
    return on


def similar_keys(core: str) -> list[str]:
    """Words with a key in common are similar: the same letters and digits, the same last seven
    digits of seven or more, or one the name part of the other's address."""
    low = core[:320].lower()
    name, at, _ = low.partition("@")
    keys = ["t" + _NOT_KEY.sub("", low), "l" + name]
    if not at:
        digits = _NOT_DIGIT.sub("", low)
        if len(digits) >= 7:
            keys.append("n" + digits[-7:])
    return keys


class Graph:
    """Candidate words of several texts: their features, edges and places."""

    def __init__(self, texts: list[str]):
        self.features, self.text_of, self.start, self.end = [], [], [], []
        chain, skip = [], []
        for t, text in enumerate(texts):
            before, latest = None, {}
            for m in self._candidates(text):
                core = _CORE.search(m[0])
                if core is None:
                    continue
                node = len(self.features)
                self.features.append(word_features(core[0]) + self._cue(text, m.start()))
                self.text_of.append(t)
                self.start.append(m.start() + core.start())
                self.end.append(m.start() + core.end())
                if before is not None and m.start() - before <= 1:
                    chain.append((node - 1, node))
                before = m.end()
                linked = set()
                for key in similar_keys(core[0]):
                    if key in latest and latest[key] not in linked:
                        linked.add(latest[key])
                        skip.append((latest[key], node))
                    latest[key] = node
        self.edges = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
        self.x = np.zeros((len(self.features), N_FEATURES))
        for i, on in enumerate(self.features):
            self.x[i, on] = 1

    @staticmethod
    def _candidates(text: str) -> list[re.Match]:
        """Words with a digit or at sign, and words that are the name part of an address, in order."""
        found = list(_CANDIDATE.finditer(text))
        names = {m[0].partition("@")[0].lower() for m in found if "@" in m[0][1:]} if "@" in text else set()
        names = {n for n in names if len(n) >= 3 and not _ANY.search(n)}
        if names:
            inside = re.compile(r"(?<![^\x20\x09-\x0D])[^\w\x20\x09-\x0D]*(?:" + "|".join(map(re.escape, sorted(names))) + r")[^\w\x20\x09-\x0D]*(?![^\x20\x09-\x0D])", re.I)
            found = sorted(found + list(inside.finditer(text)), key=lambda m: m.start())
        return found

    @staticmethod
    def _cue(text: str, start: int) -> list[int]:
        words = _WORD.findall(text[max(0, start - 40) : start])
        kind = _CUE_OF.get(words[-1].strip(".,:;()\"'").lower()) if words else None
        return [] if kind is None else [1 + len(_SHAPES) + 12 + kind]

    def labels(self, spans: list[list[Span]]) -> np.ndarray:
        """The kind (plus one) of the first span that a candidate lies in, else 0. Candidates stand in
        order, so spans that end before one are not looked at again."""
        out = np.zeros(len(self.features), np.int64)
        at, text = 0, -1
        for i, t in enumerate(self.text_of):
            if t != text:
                own, at, text = sorted(spans[t]), 0, t
            while at < len(own) and own[at][2] <= self.start[i]:
                at += 1
            for start, kind, end in own[at:]:
                if start >= self.end[i]:
                    break
                if end > self.start[i]:
                    out[i] = kind + 1
                    break
        return out

    def alone(self, texts: list[str]) -> np.ndarray:
        """The kind (plus one) of candidates that a pattern takes whole when they stand alone."""
        out = np.zeros(len(self.features), np.int64)
        for i, (t, a, b) in enumerate(zip(self.text_of, self.start, self.end)):
            if b - a <= 320:
                out[i] = next((k + 1 for x, k, y in pattern_spans(texts[t][a:b]) if (x, y) == (0, b - a)), 0)
        return out


def fit(graph: Graph, labels: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights by maximum pseudo-likelihood: each label given its neighbours' labels."""
    k = len(KINDS) + 1
    w = {"node": np.zeros((N_FEATURES, k)), "chain": np.zeros((k, k)), "skip": np.zeros((k, k))}
    n = len(labels)
    if not n:
        return w
    y = np.eye(k)[labels]
    momentum = {name: np.zeros_like(v) for name, v in w.items()}
    for _ in range(steps):
        score = graph.x @ w["node"]
        for name, e in zip(("chain", "skip"), graph.edges):
            np.add.at(score, e[:, 0], y[e[:, 1]] @ w[name].T)
            np.add.at(score, e[:, 1], y[e[:, 0]] @ w[name])
        p = np.exp(score - score.max(1, keepdims=True))
        miss = y - p / p.sum(1, keepdims=True)
        slope = {"node": graph.x.T @ miss / n}
        for name, e in zip(("chain", "skip"), graph.edges):
            slope[name] = (miss[e[:, 0]].T @ y[e[:, 1]] + y[e[:, 0]].T @ miss[e[:, 1]]) / max(1, len(e))
        for name in w:
            momentum[name] = 0.9 * momentum[name] + slope[name] - decay * w[name]
            w[name] += rate * momentum[name]
    return w


def beliefs(graph: Graph, w: dict[str, np.ndarray], known: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities by loopy belief propagation, all edges at once each round. known: labels
    that are observed (0: none); what the patterns found is evidence for the rest."""
    node = graph.x @ w["node"]
    seen = np.flatnonzero(known)
    node[seen, known[seen]] += CERTAIN
    a = np.concatenate([graph.edges[0][:, 0], graph.edges[1][:, 0]])
    b = np.concatenate([graph.edges[0][:, 1], graph.edges[1][:, 1]])
    table = np.concatenate([np.repeat(w[name][None], len(e), 0) for name, e in zip(("chain", "skip"), graph.edges)])
    forth, back = np.zeros((len(a), node.shape[1])), np.zeros((len(a), node.shape[1]))

    def gather() -> np.ndarray:
        total = node.copy()
        np.add.at(total, b, forth)
        np.add.at(total, a, back)
        return total

    def send(score: np.ndarray, along: np.ndarray) -> np.ndarray:
        x = score[:, :, None] + along
        top = x.max(1, keepdims=True)
        m = np.log(np.exp(x - top).sum(1)) + top[:, 0]
        return m - m.max(1, keepdims=True)

    for _ in range(rounds if len(a) else 0):
        total = gather()
        forth, back = send(total[a] - back, table), send(total[b] - forth, table.transpose(0, 2, 1))
    total = gather()
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find_spans(texts: list[str], w: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """For each text, the patterns' spans and the spans that the field adds."""
    base = [pattern_spans(t) for t in texts]
    graph = Graph(texts)
    added: list[list[Span]] = [[] for _ in texts]
    if len(graph.features):
        p = beliefs(graph, w, graph.labels(base))
        label = np.where(p.max(1) >= MIN_PROBABILITY, p.argmax(1), 0)
        linked = {int(j): int(i) for i, j in graph.edges[0]}
        for i in np.flatnonzero(label).tolist():
            t, kind, spans = graph.text_of[i], int(label[i]) - 1, added[graph.text_of[i]]
            if kind == 3 and i in linked and label[linked[i]] == label[i] and spans and spans[-1][2] == graph.end[linked[i]]:
                spans[-1] = (spans[-1][0], kind, graph.end[i])  # a phone number of several words
            else:
                spans.append((graph.start[i], kind, graph.end[i]))
        for t, spans in enumerate(added):
            if spans and base[t]:
                reach, ends = 0, []  # the furthest end of the spans up to each start
                for _, _, e in base[t]:
                    reach = max(reach, e)
                    ends.append(reach)
                starts = [a for a, _, _ in base[t]]
                added[t] = [x for x in spans if not (k := bisect_right(starts, x[2] - 1)) or ends[k - 1] <= x[0]]
    return list(zip(base, added))


def second_mentions(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text followed by further mentions of its entities in forms that no pattern knows, and the
    spans of those; between them stand strings of the same forms that repeat nothing, once or twice,
    which are no spans. What is drawn depends on the text alone."""
    rng, out, added = random.Random(zlib.crc32(text.encode())), [text, "\n"], []
    size = len(text) + 1

    def put(form: str, kind: int | None) -> None:
        nonlocal size
        for word in (rng.choice(("so", "and", "the", "de")), form):
            if word is form and kind is not None:
                added.append((size, kind, size + len(form)))
            out.append(word + " ")
            size += len(word) + 1

    def other(form: str) -> str:
        return "".join(str(rng.randrange(10)) if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in form)

    for start, kind, end in spans:
        if rng.random() < 0.5:
            continue  # entities that are mentioned once must be learned too
        entity = text[start:end]
        digits = _NOT_DIGIT.sub("", entity)
        forms = {
            0: [entity.partition("@")[0], entity.rpartition(".")[0]],
            1: [entity.replace(".", "-"), entity.replace(".", "_")],
            2: ["/".join(digits[i : i + 4] for i in range(0, len(digits), 4)), digits[:4] + "." + digits[4:]],
            3: [digits[-10:], f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"{digits[-7:-4]}-{digits[-4:]}"],
        }[kind]
        form = rng.choice(forms)
        if len(form) < 3:
            continue
        put(form, kind)
        decoy = other(form)
        put(decoy, None)
        if rng.random() < 0.5:
            put(decoy, None)
    return "".join(out), added


def training_set(texts: list[str]) -> tuple[Graph, np.ndarray]:
    """The graph of the texts with their second mentions, and its labels."""
    longer, spans = [], []
    for text in texts:
        base = pattern_spans(text)
        more, added = second_mentions(text, base)
        longer.append(more)
        spans.append(base + added)
    graph = Graph(longer)
    labels = graph.labels(spans)
    return graph, np.where(labels > 0, labels, graph.alone(longer))


def fit_on(docs: DataFrame) -> dict[str, np.ndarray]:
    """Fit on a bounded sample of the documents that hold candidates."""
    pool = keep_id(docs, "doc_id", "text").where(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= SAMPLE_BYTES))
    texts = [r[0] for r in bounded_sample(pool, ["doc_id", "text"], SAMPLE_DOCS, docs.count()).select("text").collect()]
    return fit(*training_set(texts))


def _write(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the patterns' spans, their digest, all spans, and their number."""
    bounded_batches(docs.sparkSession)
    w = fit_on(docs)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = find_spans([t or "" for t in b.column(1).to_pylist()], w)
        counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
        digest = pa.array([hashlib.sha256(_write(base).encode()).hexdigest() for base, _ in found], pa.string())
        spans = pa.array([_write(base + added) for base, added in found], pa.string())
        total = pa.array([len(base) + len(added) for base, added in found], pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans, total], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return map_batches(keep_id(docs, "doc_id", "text"), run, schema)


def redact_text(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in brackets; spans that overlap are replaced together."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; null texts stay null."""
    bounded_batches(docs.sparkSession)
    w = fit_on(docs)
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(at).to_pylist()
        found = find_spans([t or "" for t in texts], w)
        new = [t if t is None else redact_text(t, base + added) for t, (base, added) in zip(texts, found)]
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)], b.schema.names)

    return map_batches(docs, run, docs.schema)
