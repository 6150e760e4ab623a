"""Operator 1, secret scans: character Markov models of random strings and ordinary identifiers.

Three patterns give the base spans. What is left of other long tokens is judged by two first-order Markov models, one of
random strings and one of ordinary identifiers, both trained from labelled samples; a token whose log-likelihood ratio
exceeds the threshold learned with them is one more span. Tokens without a digit have a threshold of their own, as long
words are among them.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.shared import hash_sample, table

#: The base patterns, and the least length of what must be that long.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Kinds in the order in which spans of one start are listed; the last is the models'.
KINDS = ("assign", "access", "hex", "random")
#: Documents that lend words to the sample of ordinary identifiers, and random strings that are drawn.
MAX_DOCS, DRAWN = 2_000, 6_000
#: Characters of a token that the models judge, at least.
SHORTEST = 16
_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Symbol numbers by code point; the one after the last is the token's start.
_PLACE = {c: i for i, c in enumerate(_SYMBOLS)}
_START = len(_SYMBOLS)
#: Words of which identifiers are composed, besides those of the documents.
_PARTS = (
    "get set is has to from with by id ids name names value values key keys index count size list map array table row column user users account order item items file files path paths url "
    "host port client server request response header body status code error message handler manager factory builder config option options default test tests util utils common core base data "
    "model view controller service event events queue task job worker thread lock cache store session page pages image button label text line block node edge graph tree version update create "
    "delete remove insert add find search filter sort merge split join parse format encode decode read write open close start stop init load save send receive connect first last next previous"
).split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind's number, end)``, sorted: leftmost non-overlapping matches of each kind, too short ones dropped."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of what is long enough to be judged, has a letter, and lies in a token outside the base spans."""
    for m in _TOKEN.finditer(text):
        start = m.start()
        for a, b in [*((a, b) for a, _, b in base if a < m.end() and m.start() < b), (m.end(), m.end())]:
            if a - start >= SHORTEST and text[start:a].strip("0123456789+/_=-"):
                yield start, a
            start = max(start, b)


def codes(token: str) -> np.ndarray:
    return np.array([_START, *(_PLACE[c] for c in token if c in _PLACE)])


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratios of transitions, random over ordinary, and the ratio a character beyond which a token is random,
    for tokens with a digit and for others."""

    ratio: np.ndarray
    threshold: float
    of_letters: float

    def score(self, token: str) -> float:
        c = codes(token)
        return float(self.ratio[c[:-1], c[1:]].sum()) / max(1, len(c) - 1)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Random tokens, or what is left of them outside the base spans."""
        out = []
        for start, end in candidates(text, base):
            token = text[start:end]
            if self.score(token) > (self.threshold if any("0" <= c <= "9" for c in token) else self.of_letters):
                out.append((start, 3, end))
        return out


def drawn_random(n: int = DRAWN, seed: int = 1) -> list[str]:
    """Labelled sample of random strings: hexadecimal of either case, letters and digits, and base64, of 16 to 64 characters."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", _SYMBOLS[:62], _SYMBOLS[:64], _SYMBOLS[26:62], _SYMBOLS[:62] + "_-"]
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))) for _ in range(n)]


def drawn_letters(n: int = DRAWN // 3, seed: int = 3) -> list[str]:
    """Labelled sample of random strings of letters alone, in either case, of 16 to 64 characters."""
    rng = random.Random(seed)
    return ["".join(rng.choices(_SYMBOLS[:52], k=rng.randint(16, 64))) for _ in range(n)]


def composed_identifiers(words: list[str], n: int = DRAWN, seed: int = 2) -> list[str]:
    """Labelled sample of ordinary identifiers: words joined in snake, kebab, path and camel style, some with numbers."""
    rng = random.Random(seed)
    pool = _PARTS * max(1, len(words) // len(_PARTS)) + words
    out = []
    for _ in range(n):
        parts = rng.choices(pool, k=rng.randint(2, 6))
        if rng.random() < 0.6:
            parts.insert(rng.randint(1, len(parts)), rng.choice([str(rng.randint(0, 99)), str(rng.randint(1990, 2030)), f"v{rng.randint(1, 9)}", f"{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"]))
        joint = rng.choice(["_", "-", "/", "", "camel"])
        out.append("".join(p.capitalize() if i else p for i, p in enumerate(parts)) if joint == "camel" else joint.join(parts))
    return out


def train(words: list[str]) -> Models:
    """Both models from labelled samples, ``words`` being ordinary ones. The threshold lies midway between what 99.5 % of
    the ordinary tokens stay under and what 99.5 % of the random ones exceed, on the fifth of each that isn't trained on. That
    for letters alone lies above all but one in a thousand of the ordinary tokens without a digit, too."""
    random_tokens = drawn_random()
    ordinary = composed_identifiers([w for w in words if w and all(c in _PLACE for c in w)])

    def logs(tokens: list[str]) -> np.ndarray:
        n = np.full((_START + 1, _START), 0.5)
        for t in tokens:
            c = codes(t)
            np.add.at(n, (c[:-1], c[1:]), 1)
        return np.log(n / n.sum(1, keepdims=True))

    apart = lambda x: (x[: len(x) * 4 // 5], x[len(x) * 4 // 5 :])
    (r, r_apart), (o, o_apart) = apart(random_tokens), apart(ordinary)
    ratio = np.hstack([logs(r) - logs(o), np.zeros((_START + 1, 1))])
    models = Models(ratio, 0.0, 0.0)
    scores = lambda tokens: [models.score(t) for t in tokens]
    middle = (np.quantile(scores(o_apart), 0.995) + np.quantile(scores(r_apart), 0.005)) / 2
    plain = scores(t for t in ordinary if len(t) >= SHORTEST and not any("0" <= c <= "9" for c in t))
    low = np.quantile(plain, 0.999) if plain else middle
    letters = max(low, (low + np.quantile(scores(drawn_letters()), 0.05)) / 2)
    return Models(ratio, float(middle), float(letters))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS) -> Models:
    """Models whose ordinary words come from about ``max_docs`` documents at most, picked by a hash of the id.

    Ten words a document at most, its least by hash, of plain letters alone; so the driver gets a bounded sample.
    """
    own = hash_sample(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")), "id", max_docs)
    plain = F.filter(F.array_distinct(F.split(F.coalesce("t", F.lit("")), "[^A-Za-z]+")), lambda w: F.length(w).between(3, 24))
    some = F.slice(F.array_sort(F.transform(plain, lambda w: F.struct(F.xxhash64(w).alias("o"), w.alias("w")))), 1, 10)
    return train(sorted({r[0] for r in own.select(F.explode(some["w"])).distinct().collect()}))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for every row of ``docs``.

    Offsets are code points, ends exclusive. A null text counts as empty; repeated rows stay repeated; an empty table gives
    an empty result; other columns are ignored. Each text is scanned whole, within its row.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                more = models.spans(t, base)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(docs: DataFrame, models: Models, text: str = "text", n_chars: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text, overlapping ones as one, replaced by ``mark`` and ``n_chars`` set anew where it
    is a column; texts without a secret, null ones too, stay as they are. Repeated rows stay repeated, an empty table stays
    empty, and all other columns are kept, whatever their names. A task holds one Arrow batch of whole texts."""
    at = docs.columns.index(text)
    length = docs.columns.index(n_chars) if n_chars in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            texts, sizes = [], []
            for t in columns[at]:
                t = t.as_py()
                base = base_spans(t or "")
                done, out = 0, []
                for start, _, end in sorted(base + models.spans(t or "", base)):
                    if start >= done:
                        out += [t[done:start], mark]
                    done = max(done, end)
                texts.append("".join(out) + t[done:] if out else t)
                sizes.append(len(texts[-1]) if out else None)
            columns[at] = pa.array(texts, columns[at].type)
            if length >= 0:
                old = columns[length].to_pylist()
                columns[length] = pa.array([o if s is None else s for o, s in zip(old, sizes, strict=True)], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))


SQL = None
