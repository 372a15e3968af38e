"""Secrets in text: fixed patterns, and a linear-chain conditional random field.

The field tags tokens as begin of a secret, inside, or outside. It sees a token's shape, the
neighbouring words and features of the whole text, and is decoded by Viterbi. A token is a
run of characters that keys are made of. One of fewer than 12, and one without a digit or a
capital within, is a word, and outside by definition. So a text falls into chains of adjacent
tokens that are no words, which are decoded one by one.

There are no labelled secrets: the field is trained on a bounded sample of the documents,
where the fixed patterns say what is a secret, and on made-up secrets and look-alikes.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import map_batches, per_text, struct_array

SAMPLE_DOCS = 500  # documents to learn from
CHAINS_PER_DOC = 200  # chains to learn from in one of them
MADE_UP = 3000  # made-up examples
MEMORY = 100_000  # tokens whose shape a worker remembers
LEAST = 12  # characters of a token that may be a secret

# The base patterns, and the least length of what they find.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "field")
LEAST_OF = {"assign": 12, "access": 18, "hex": 16}

TOKEN = re.compile(rf"[A-Za-z0-9+/=_.-]{{{LEAST},}}")
NO_WORD = re.compile(r"[0-9]|[a-z].*[A-Z]|[A-Z].*[A-Z].*[a-z]")
LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST_OF['hex']},}}")
CUE = re.compile(
    r"(?i:password|passwd|pwd|secret|token|api.?key|credential|bearer|auth|private|access|key)"
    r"[\"']?\s*(?:[:=]|is|key)?\s*[\"']?$", re.ASCII,
)
BEFORE, AFTER = 24, 4  # characters around a token that are looked at

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, as (start, end, kind) in code points, in order."""
    spans = []
    if ":" in text or "=" in text:
        spans += [
            (*m.span(), "assign") for m in ASSIGN.finditer(text)
            if len(m[2]) >= LEAST_OF["assign"]
        ]
    if "AKIA" in text:
        spans += [
            (*m.span(), "access") for m in ACCESS.finditer(text)
            if len(m[0]) >= LEAST_OF["access"]
        ]
    spans += [(*m.span(), "hex") for m in LONG_HEX.finditer(text)]
    return ordered(spans)


def uncovered(
    text: str, spans: list[tuple[int, int]], base: list[Span]
) -> list[tuple[int, int]]:
    """Parts of the spans outside those of `base`, with a letter or digit.

    What stands right before an assignment is part of its name, if it is a word. Both lists
    come by their starts, and `spans` don't overlap.
    """
    out, first = [], 0
    for start, end in spans:
        while first < len(base) and base[first][1] <= start:
            first += 1
        k = first
        while start < end:
            low, high, kind = base[k] if k < len(base) else (end, end, "")
            part = text[start : min(low, end)]
            named = kind == "assign" and low < end
            if any(map(str.isalnum, part)) and not (
                named and not any(map(NO_WORD.search, TOKEN.findall(part)))
            ):
                out.append((start, start + len(part)))
            start, k = max(start, high), k + 1
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# ------------------------------------------------------------------ features

SHAPE = (
    "any digit upper lower letters mixed_case digit_letter hex number alternating very_alternating "
    "varied few_vowels len16 len24 len40 len80 plus slash underscore dash dot equals word_dots "
    "capital_first many_upper path spaced_digits"
).split()
AROUND = "cue colon quote_before quote_after at_sign url adjacent line_start line_end".split()
WHOLE = "code_like digit_rich short_text".split()
FEATURES = [*SHAPE, *AROUND, *WHOLE]
PLACE = {name: i for i, name in enumerate(FEATURES)}
LABELS = ("outside", "begin", "inside")
VOWELS = set("aeiouAEIOU")


def shape(token: str) -> list[int]:
    """Features of a token alone."""
    n = len(token)
    digits = sum(map(str.isdigit, token))
    upper, lower = sum(map(str.isupper, token)), sum(map(str.islower, token))
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else "p" for c in token]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    letters = upper + lower
    vowels = sum(c in VOWELS for c in token)
    found = {
        "any": True, "digit": digits > 0, "upper": upper > 0, "lower": lower > 0,
        "letters": letters == n, "mixed_case": upper > 1 and lower > 1,
        "digit_letter": digits > 1 and letters > 1,
        "hex": all(c in "0123456789abcdefABCDEF" for c in token) and digits > 0,
        "number": letters == 0, "alternating": turns >= n / 8, "very_alternating": turns >= n / 4,
        "varied": len(set(token)) >= min(n, 40) * 0.5,
        "few_vowels": letters > 0 and vowels < 0.25 * letters,
        "len16": n >= 16, "len24": n >= 24, "len40": n >= 40, "len80": n >= 80,
        "plus": "+" in token, "slash": "/" in token, "underscore": "_" in token,
        "dash": "-" in token, "dot": "." in token, "equals": "=" in token,
        "word_dots": bool(re.search(r"[a-z]{2,}[./][a-z]{2,}", token)),
        "capital_first": token[0].isupper() and upper == 1, "many_upper": upper > 0.5 * n,
        "path": token.count("/") > 1 and digits < 3,
        "spaced_digits": bool(re.fullmatch(r"\d+(?:[-./]\d+)+\.?", token)),
    }
    return [PLACE[name] for name, holds in found.items() if holds]


def around(text: str, start: int, end: int, adjacent: bool) -> list[int]:
    """Features of what stands around a token."""
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    found = {
        "cue": CUE.search(before) is not None,
        "colon": before.rstrip(" \"'")[-1:] in (":", "="),
        "quote_before": before[-1:] in ("\"", "'", "`"),
        "quote_after": after[:1] in ("\"", "'", "`"),
        "at_sign": "@" in (before[-1:], after[:1]), "url": before.endswith("://"),
        "adjacent": adjacent, "line_start": before[-1:] in ("", "\n"),
        "line_end": after[:1] in ("", "\n"),
    }
    return [PLACE[name] for name, holds in found.items() if holds]


def whole(text: str) -> list[int]:
    """Features of the text (the file) as a whole."""
    n = max(len(text), 1)
    found = {
        "code_like": sum(map(text.count, "{}=;")) * 100 > n,
        "digit_rich": sum(map(text.count, string.digits)) * 20 > n, "short_text": n < 200,
    }
    return [PLACE[name] for name, holds in found.items() if holds]


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text) if NO_WORD.search(m[0])]


def chains(text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Tokens with no other word between them, together."""
    out: list[list[tuple[int, int]]] = []
    for start, end in tokens:
        if out and not any(map(str.isalnum, text[out[-1][-1][1] : start])):
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
    return out


def described(text: str, chain: list[tuple[int, int]], file: list[int]) -> list[list[int]]:
    return [
        [*shape(text[s:e]), *around(text, s, e, i > 0), *file] for i, (s, e) in enumerate(chain)
    ]


# ------------------------------------------------------------------ the field

class Field:
    """Scores of (begin, inside) for each feature, and of steps from label to label.

    Outside scores nothing, nor does the step from outside to outside. A chain begins and ends
    outside; inside can't follow outside.
    """

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps
        names = [PLACE[name] for name in (*AROUND, *WHOLE)]
        self.most_around = float(np.maximum(weights[names], 0).sum(0).max())
        self.most_step = float(np.maximum(steps[np.isfinite(steps)], 0).max())

    def may_hold(self, features: list[int]) -> bool:
        """False if no surroundings could make a token with this shape part of a secret."""
        score = self.weights[features].sum(0).max()
        return bool(score + self.most_around + 2 * self.most_step >= 0)

    def decode(self, chain: list[list[int]]) -> list[int]:
        """The best labels by Viterbi; of equal ones the more outside."""
        best, back = np.array([0.0, -np.inf, -np.inf]), []
        for features in chain:
            scores = best[:, None] + self.steps
            back.append(scores.argmax(0))
            best = scores.max(0) + np.concatenate([[0.0], self.weights[features].sum(0)])
        label = int((best + self.steps[:, 0]).argmax())
        labels = []
        for pointers in reversed(back):
            labels.append(label)
            label = int(pointers[label])
        return labels[::-1]


def fit(data: list[tuple[list[list[int]], list[int]]], rounds: int = 250, ridge: float = 1e-3):
    """A field by maximum likelihood: gradient ascent with Adam on chains of equal length."""
    n = len(FEATURES)
    by_length: dict[int, list] = {}
    for chain, labels in data:
        by_length.setdefault(len(chain), []).append((chain, labels))
    groups = []
    for length, rows in by_length.items():
        x = np.zeros((len(rows), length, n))
        for i, (chain, _) in enumerate(rows):
            for j, features in enumerate(chain):
                x[i, j, features] = 1
        groups.append((x, np.array([labels for _, labels in rows])))
    allowed = np.ones((3, 3), bool)
    allowed[0, 2] = False
    theta = np.zeros(2 * n + 9)
    moment, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, t = theta[: 2 * n].reshape(n, 2), np.where(allowed, theta[2 * n :].reshape(3, 3), -1e9)
        grad_w, grad_t = -ridge * len(data) * w, -ridge * len(data) * np.where(allowed, t, 0)
        for x, y in groups:
            dw, dt = _gradient(x, y, w, t)
            grad_w, grad_t = grad_w + dw, grad_t + dt
        grad_t[0, 0] = 0
        grad = np.concatenate([grad_w.ravel(), np.where(allowed, grad_t, 0).ravel()]) / len(data)
        moment = 0.9 * moment + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta += 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    steps = np.where(allowed, theta[2 * n :].reshape(3, 3), -np.inf)
    return Field(theta[: 2 * n].reshape(n, 2), steps)


def _gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray):
    """Of the log likelihood of chains of one length: counts seen less counts expected."""
    rows, length, _ = x.shape
    emit = np.concatenate([np.zeros((rows, length, 1)), x @ w], axis=2)

    def total(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    ahead = [t[0] + emit[:, 0]]
    for i in range(1, length):
        ahead.append(total(ahead[-1][:, :, None] + t, 1) + emit[:, i])
    behind = [np.broadcast_to(t[:, 0], (rows, 3))]
    for i in range(length - 1, 0, -1):
        behind.insert(0, total(t + (emit[:, i] + behind[0])[:, None, :], 2))
    z = total(ahead[-1] + t[:, 0], 1)
    dw, dt = np.zeros_like(w), np.zeros((3, 3))
    for i in range(length):
        share = np.exp(ahead[i] + behind[i] - z[:, None])
        for k in (1, 2):
            dw[:, k - 1] += x[:, i].T @ ((y[:, i] == k) - share[:, k])
        if i == 0:
            dt[0] += np.bincount(y[:, 0], minlength=3) - share.sum(0)
        else:
            both = ahead[i - 1][:, :, None] + t + (emit[:, i] + behind[i])[:, None, :]
            dt -= np.exp(both - z[:, None, None]).sum(0)
            np.add.at(dt, (y[:, i - 1], y[:, i]), 1)
    np.add.at(dt[:, 0], y[:, -1], 1)
    dt[:, 0] -= np.exp(ahead[-1] + t[:, 0] - z[:, None]).sum(0)
    return dw, dt


# ------------------------------------------------------------------ what it learns from

def labelled(text: str) -> list[tuple[list[list[int]], list[int]]]:
    """A text's chains with labels: tokens in what the fixed patterns find are secrets."""
    tokens = candidates(text)
    secret = [(s, e) for s, e, _ in base_spans(text) if any(map(str.isalpha, text[s:e]))]
    file, out = whole(text), []
    for chain in chains(text, tokens)[:CHAINS_PER_DOC]:
        chain = chain[:8]
        inside = [any(s < b and a < e for a, b in secret) for s, e in chain]
        out.append((described(text, chain, file), [int(hit) for hit in inside]))
    return out


def made_up(n: int = MADE_UP, seed: int = 7) -> list[tuple[list[list[int]], list[int]]]:
    """Made-up secrets in usual places, and look-alikes that are none."""
    r = random.Random(seed)
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def of(chars: str, low: int, high: int) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(low, high)))

    def word(low: int = 2, high: int = 9) -> str:
        made = "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(6))
        return made[: r.randint(low, high)]

    secrets = [
        lambda: of(string.hexdigits.lower()[:16], 32, 64), lambda: of(alnum, 20, 48),
        lambda: of(b64, 28, 64) + "==", lambda: "_".join((of("abcdefghkpst", 2, 4), of(alnum, 24, 40))),
        lambda: "-".join((of("abcdefghkpst", 2, 4), of(alnum, 24, 48))),
        lambda: ".".join(of(alnum + "_-", 20, 60) for _ in range(3)),
        lambda: of(string.ascii_uppercase + string.digits, 20, 32),
    ]
    places = ["{} ", '"{}" ', "Authorization: Bearer {} ", "key = {}\n", "api.key: '{}'\n", "{}\n",
              "credential {} ", "auth={} ", "access key {} "]
    others = [
        lambda: f"{word()}.{word()}{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.example.com",
        lambda: "https://www." + "/".join(word(4) for _ in range(r.randint(2, 5))) + ".html",
        lambda: "".join(word() for _ in range(4)), lambda: str(r.randint(10**12, 10**16)),
        lambda: "-".join(word(3) for _ in range(r.randint(2, 4))),
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: f"2{r.randint(0, 999):03d}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: "/".join(word() for _ in range(5)), lambda: "_".join(word(3) for _ in range(4)),
        lambda: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}",
        lambda: "-" * r.randint(12, 60), lambda: "=" * r.randint(12, 60), lambda: "." * 14,
        lambda: "".join(word() for _ in range(4)).capitalize(), lambda: word(6, 9).upper() * 2,
        lambda: word(4) + "_" + word(4) + str(r.randint(1, 999)),
        lambda: word(2, 3).upper() + word(4) + word(4),
        lambda: word(4) + "".join(word(4).capitalize() for _ in range(r.randint(1, 3))),
        lambda: r.choice(alnum) * r.randint(12, 40), lambda: (word(2, 4) + "-") * 6,
    ]
    data = []
    for i in range(n):
        lead = " ".join(word() for _ in range(r.randint(0, 8))) + r.choice([" ", "\n"])
        if i % 20 == 0:  # a block of lines
            lines = [of(b64, 60, 64) for _ in range(r.randint(2, 6))]
            text, kind = lead + "key:\n" + "\n".join(lines) + "\n" + word(), "block"
        elif i % 2:
            text, kind = lead + r.choice(places).format(r.choice(secrets)()) + word(), "secret"
        else:
            text, kind = lead + r.choice(places[:2] * 5 + ["key = {}\n"]).format(r.choice(others)()) + word(), "other"
        for chain in chains(text, candidates(text)):
            labels = [0] * len(chain) if kind == "other" else [1] + [2] * (len(chain) - 1)
            data.append((described(text, chain[:8], whole(text)), labels[:8]))
    return data


def trained(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Field:
    """A field from at most `sample` documents, the first by a hash of the id, and made-up text."""
    chosen = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample)
    texts = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (chain, labels) for text in batch.column(0).to_pylist() if text
                for chain, labels in labelled(text)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in rows], pa.list_(pa.list_(pa.int32()))),
                 pa.array([y for _, y in rows], pa.list_(pa.int32()))],
                names=["chain", "labels"],
            )

    rows = map_batches(texts, run, "chain array<array<int>>, labels array<int>").collect()
    found = sorted(([list(f) for f in row.chain], list(row.labels)) for row in rows)
    return fit(found + made_up())


# ------------------------------------------------------------------ scanning

class Scanner:
    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, bool] = {}

    def _may_hold(self, token: str) -> bool:
        held = self.known.get(token)
        if held is None:
            held = bool(NO_WORD.search(token)) and self.field.may_hold(shape(token))
            if len(self.known) < MEMORY and len(token) < 200:
                self.known[token] = held
        return held

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """What the fixed patterns find, and that with what the field adds."""
        base = base_spans(text)
        if not any(map(self._may_hold, TOKEN.findall(text))):
            return base, base
        tokens, file, added = candidates(text), whole(text), []
        for chain in chains(text, tokens):
            if not any(self._may_hold(text[s:e]) for s, e in chain):
                continue
            for (start, end), label in zip(chain, self.field.decode(described(text, chain, file))):
                if label == 1:
                    added.append((start, end))
                elif label == 2:
                    added[-1] = (added[-1][0], end)
        return base, ordered(base + [(s, e, "field") for s, e in uncovered(text, added, base)])


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, n_field, spans.

    Needs doc_id and text; other columns are ignored. A null or empty text has no secrets.
    Spans are kind:start:end in code points, end exclusive, by start, then kind; those of the
    field (kind `field`) are cut to what no span of the fixed patterns covers. Rows that repeat get equal
    results. No documents give no rows.
    """
    scanner = Scanner(field or trained(docs))

    def run(texts: pa.Array) -> pa.Array:
        found = [scanner.spans(text) for text in texts.to_pylist()]
        counts = [[kind for _, _, kind in spans] for _, spans in found]
        return struct_array(
            **{f"n_{k}": pa.array([c.count(k) for c in counts], pa.int64()) for k in KINDS},
            base_sha256=[hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
            spans=[joined(spans) for _, spans in found],
        )

    kind = ", ".join(f"n_{k}:bigint" for k in KINDS)
    column = per_text(run, f"struct<{kind}, base_sha256:string, spans:string>")
    return docs.select("doc_id", column(F.col("text")).alias("r_")).select("doc_id", "r_.*")


def redact(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All documents and columns, secrets in the text replaced by a mark, n_chars as it is then.

    Only rows with secrets change; a table without n_chars gets none.
    """
    text = without_secrets(F.col("text"), field or trained(docs), mark)
    changed = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.length("text").cast(kind))
    return changed.select(docs.columns)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """A text with each span replaced; spans that overlap are one."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def without_secrets(text: Column, field: Field, mark: str = "[SECRET]") -> Column:
    """A text with its secrets replaced by a mark; texts without any, and null, as they are."""
    scanner = Scanner(field)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(
            [redacted(t, scanner.spans(t)[1], mark) for t in texts.to_pylist()], pa.large_string()
        ).cast(pa.string())

    return F.when(text.isNotNull(), per_text(run, "string")(text))
