"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags tokens as begin, inside or outside of a secret from the token's
shape, the neighbouring words and features of the whole text. It is trained
here, on windows from a bounded sample of texts (``FIT_TEXTS``), tagged by the
patterns and by secrets of random alphabets put into ordinary windows.

Decoding is exact Viterbi. A token whose score for outside leads by more than
any two transitions can change is outside on every best path, so the recursion
runs only over the tokens between such tokens.

A token's shape is the order of kinds of characters in its first 64 characters, of which six runs count: a
feature, not a limit of the scan, which reads every token whole.

Defined results: a null text is an empty text with no spans; null doc_ids and
repeated rows are scanned like any other; spans of the field that overlap a pattern's
are dropped, patterns of different kinds may overlap each other and are redacted as one stretch; paths
of equal score go to the tag listed first; very long texts are scanned whole; an empty table
has no rows, and a field that had no window to learn from adds nothing to what the patterns find. Extra columns play no part in
:func:`scan` and pass unchanged through :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import few_rows

FIT_TEXTS = 4000
FIT_WINDOWS = 400
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, as those of + with 32 or more
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"[\w+/.=-]+|[^\w\s+/.=-]+")

B, I, O = 0, 1, 2  # noqa: E741
OFFSETS = (-3, -2, -1, 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(x in low for x in CUES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Where the secrets of the patterns' matches stand, without the names in front."""
    parts = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return parts + [(a, b) for a, b, kind in base_spans(text) if kind != "assign"]


def shape(token: str) -> str:
    """Kinds of characters in order, runs once, six at most."""
    out: list[str] = []
    for c in token[:64]:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c.isascii() else "?"
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:6]) + ("+" if len(out) > 6 else "")


def token_features(token: str) -> tuple:
    """What the features of the token itself depend on."""
    n, distinct = len(token), len(set(token))
    if n < 12 and token.isalpha():  # ordinary words, in fewer steps
        case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else shape(token)
        upper = 0 if case == "a" else 8 if case == "A" else 8 * sum(c.isupper() for c in token) // n
        return case, n if n < 8 else 8, 0, upper, distinct // 3, n // 8, 0, False, token[:4] == "AKIA", False
    digits = sum(c.isdigit() for c in token)
    upper = sum(c.isupper() for c in token)
    length = min(n, 8) if n < 12 else 12 + min(n // 8, 8)
    changes = sum(a.isalpha() != b.isalpha() for a, b in zip(token, token[1:], strict=False))
    hexadecimal = n >= 16 and all(c in "0123456789abcdef" for c in token)
    return shape(token), length, 8 * digits // n, 8 * upper // n, min(distinct, 24) // 3, min(n, 40) // 8, min(changes, 8), hexadecimal, token[:4] == "AKIA", bool(digits and upper and n >= 8)


def own_names(features: tuple) -> list[str]:
    """Names of the features of a token itself."""
    kind, length, digits, upper, distinct, size, changes, hexadecimal, access, mixed = features
    return ["bias", f"s:{kind}", f"n:{length}", f"d:{digits}", f"u:{upper}", f"v:{distinct}:{size}", f"c:{changes}", f"x:{hexadecimal}", f"k:{access}:{size}", f"m:{mixed}:{size}"]


def neighbour_names(word: str, kind: str, offset: int) -> list[str]:
    """Names of the features of a token for the tag ``-offset`` tokens on."""
    return [f"w{offset}:{word}", f"t{offset}:{kind[:3]}"]


def word_of(token: str) -> str:
    return token.lower() if len(token) <= 12 else "long"


def file_features(text: str) -> list[str]:
    """Names of the features of the whole text."""
    n = max(1, len(text))
    return [f"f:size:{min(n.bit_length(), 16)}", f"f:lines:{min(8, 400 * text.count(chr(10)) // n)}", f"f:assign:{min(4, text.count('=') + text.count(':'))}", f"f:code:{'{' in text}:{';' in text}"]


def _sequence_features(tokens: list[str], whole: list[str]) -> list[list[str]]:
    out = []
    for t, token in enumerate(tokens):
        own = own_names(token_features(token)) + whole
        for o in OFFSETS:
            near = tokens[t + o] if 0 <= t + o < len(tokens) else ""
            own += neighbour_names(word_of(near), token_features(near)[0] if near else "", o)
        out.append(own)
    return out


class Field:
    """Weights of a chain with three tags; scores by feature and by pair of tags. Features not met in training weigh nothing."""

    def __init__(self, names: dict[str, int] | None = None, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.names = names if names is not None else {}
        self.weights = weights if weights is not None else np.zeros((0, 3))
        self.moves = moves if moves is not None else np.zeros((3, 3))
        self.words = {x.partition(":")[2] for x in self.names if x[0] == "w"}
        self._ids: dict[str, int] = {}
        self._kinds: dict[tuple, int] = {}
        self._rows = np.zeros((1024, 1 + len(OFFSETS), 3), dtype=np.float32)

    def state(self) -> tuple:
        return self.names, self.weights, self.moves

    def train(self, samples: list[tuple[list[str], list[int], list[str]]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Maximum conditional likelihood by AdaGrad over all samples (tokens, tags, file features)."""
        if not samples:
            return
        steps = max(len(t) for t, _, _ in samples)
        feats = [_sequence_features(t, w) for t, _, w in samples]
        per = len(feats[0][0])
        self.names = {x: i for i, x in enumerate(sorted({x for f in feats for row in f for x in row}))}
        self.weights = np.zeros((len(self.names), 3))
        feats = [[[self.names[x] for x in row] for row in f] for f in feats]
        index = np.zeros((len(samples), steps, per), dtype=np.int64)
        gold, mask = np.full((len(samples), steps), O), np.zeros((len(samples), steps))
        for i, (f, (_, tags, _)) in enumerate(zip(feats, samples, strict=True)):
            index[i, : len(f)], gold[i, : len(f)], mask[i, : len(f)] = f, tags, 1
        want = np.eye(3)[gold] * mask[..., None]
        pairs = mask[:, 1:] * mask[:, :-1]
        seen_moves = np.einsum("bti,btj->ij", want[:, :-1] * pairs[..., None], want[:, 1:])
        power, power_moves = np.full_like(self.weights, 1e-6), np.full((3, 3), 1e-6)
        for _ in range(rounds):
            score = self.weights[index].sum(axis=2) * mask[..., None]
            ahead, behind = np.zeros_like(score), np.zeros_like(score)
            ahead[:, 0] = score[:, 0]
            for t in range(1, steps):
                step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.moves[None], axis=1) + score[:, t]
                ahead[:, t] = np.where(mask[:, t, None] > 0, step, ahead[:, t - 1])
            for t in range(steps - 2, -1, -1):
                step = np.logaddexp.reduce(self.moves[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0)
            total = np.logaddexp.reduce(ahead[:, -1], axis=1)
            alone = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
            both = ahead[:, :-1, :, None] + self.moves + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
            both = np.exp(both) * pairs[..., None, None]
            gain = np.zeros_like(self.weights)
            flat = np.repeat((want - alone).reshape(-1, 3), per, axis=0)
            for k in range(3):
                gain[:, k] = np.bincount(index.reshape(-1), weights=flat[:, k], minlength=len(self.names))
            gain = gain / len(samples) - decay * self.weights
            gain_moves = (seen_moves - both.sum(axis=(0, 1))) / len(samples) - decay * self.moves
            power += gain**2
            power_moves += gain_moves**2
            self.weights += rate * gain / np.sqrt(power)
            self.moves += rate * gain_moves / np.sqrt(power_moves)

    def _sum(self, names: list[str]) -> np.ndarray:
        at = [self.names[x] for x in names if x in self.names]
        return self.weights[at].sum(axis=0) if at else np.zeros(3)

    def _row(self, token: str) -> int:
        """Row of the token's scores; tokens of the same features share one."""
        features = token_features(token) if token else None
        word = word_of(token)
        key = (features, word if word in self.words else None)
        at = self._kinds.get(key)
        if at is None:
            at = self._kinds[key] = len(self._kinds)
            if at >= len(self._rows):
                self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
            self._rows[at, 0] = self._sum(own_names(features)) if features else 0
            for k, o in enumerate(OFFSETS, 1):
                self._rows[at, k] = self._sum(neighbour_names(word, features[0] if features else "", o))
        self._ids[token] = at
        return at

    def scores(self, tokens: list[str], whole: list[str]) -> np.ndarray:
        """Score of each tag for each token; equal tokens are looked up once."""
        if len(self._ids) > 200_000 or len(self._kinds) > 100_000:
            self._ids.clear()
            self._kinds.clear()
        known = self._ids
        ids = np.array([known[x] if x in known else self._row(x) for x in tokens], dtype=np.int64)
        n, far = len(ids), max(map(abs, OFFSETS))
        wide = np.full(n + 2 * far, self._row(""), dtype=np.int64)
        wide[far : far + n] = ids
        out = self._rows[ids, 0] + self._sum(whole).astype(np.float32)
        for k, o in enumerate(OFFSETS, 1):
            out += self._rows[wide[far + o : far + o + n], k]
        return out

    def viterbi(self, score: np.ndarray, bounded: tuple[bool, bool] = (False, False)) -> list[int]:
        """Best tags; ``bounded``: whether an outside token stands before and after."""
        now = score[0] + (self.moves[O] if bounded[0] else 0)
        back = []
        for row in score[1:]:
            step = now[:, None] + self.moves
            back.append(step.argmax(axis=0))
            now = step.max(axis=0) + row
        at = int((now + (self.moves[:, O] if bounded[1] else 0)).argmax())
        out = [at]
        for b in reversed(back):
            at = int(b[at])
            out.append(at)
        return out[::-1]

    def tags(self, score: np.ndarray) -> np.ndarray:
        """Best tags of a whole text, by recursion only between tokens that must be outside."""
        out = np.full(len(score), O)
        reach = 2 * (self.moves.max() - self.moves.min()) + 1e-3
        open_ = score[:, O] - score[:, :O].max(axis=1) <= reach
        at = np.flatnonzero(open_)
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
            a, b = int(run[0]), int(run[-1]) + 1
            out[a:b] = self.viterbi(score[a:b], (a > 0, b < len(score)))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        tokens = TOKEN.findall(text)
        if not tokens or not self.moves.any():  # a field that has learnt nothing
            return []
        tags = self.tags(self.scores(tokens, file_features(text)))
        if (tags == O).all():
            return []
        out: list[tuple[int, int, str]] = []
        last = O
        for m, tag in zip(TOKEN.finditer(text), tags.tolist(), strict=True):
            if tag == B or tag == I and last == O:
                out.append((m.start(), m.end(), "crf"))
            elif tag == I:
                out[-1] = (out[-1][0], m.end(), "crf")
            last = tag
        return out


def all_spans(text: str | None, field: Field) -> tuple[list, list]:
    """(base spans, all spans): the field adds the spans that touch no base span."""
    base = base_spans(text) if text else []
    more = [x for x in (field.spans(text) if text else []) if not any(x[0] < b and a < x[1] for a, b, _ in base)]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _windows(text: str, rng: np.random.Generator, reach: int = 12) -> list[tuple[list[str], list[int], list[str]]]:
    """Tagged windows of a text: around its secrets, and one elsewhere, plain and with a secret put in."""
    found = list(TOKEN.finditer(text))
    if not found:
        return []
    tokens = [m[0] for m in found]
    parts = secret_parts(text)
    tags = [O] * len(tokens)
    for i, m in enumerate(found):
        if hit := [p for p in parts if p[0] < m.end() and m.start() < p[1]]:
            tags[i] = I if i and tags[i - 1] != O and any(p[0] < found[i - 1].end() for p in hit) else B
    whole = file_features(text)
    cut = lambda at: (tokens[max(0, at - reach) : at + reach], tags[max(0, at - reach) : at + reach], whole)
    out = [cut(i) for i, t in enumerate(tags) if t == B][:3]
    odd = [i for i, t in enumerate(tokens) if tags[i] == O and any(c.isdigit() for c in t)]
    out += [cut(odd[int(rng.integers(len(odd)))])] if odd else []
    plain = cut(int(rng.integers(len(tokens))))
    out.append(plain)
    names = ["token", "password", "passwd", "pwd", "secret", "api_key", "key", "auth", "credential"]
    alphabet = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"][int(rng.integers(4))]
    value = "".join(rng.choice(list(alphabet), int(rng.integers(12, 44))))
    lead = [[names[int(rng.integers(len(names)))], "=", '"'], [names[int(rng.integers(len(names)))], ":"], [names[int(rng.integers(len(names)))], "="]][int(rng.integers(3))]
    at = int(rng.integers(len(plain[0]) + 1))
    tail = ['"'] if lead[-1] == '"' else []
    for made in TOKEN.findall(value)[:1]:
        out.append((plain[0][:at] + lead + [made] + tail + plain[0][at:], plain[1][:at] + [O] * len(lead) + [B] + [O] * len(tail) + plain[1][at:], whole))
    return out


def fit(docs: DataFrame, texts: int = FIT_TEXTS, windows: int = FIT_WINDOWS, seed: int = 2) -> Field:
    """Train on windows of the ``texts`` rows whose ids hash lowest; at most ``windows`` of each sort."""
    order = F.xxhash64("doc_id", F.lit(seed))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(order, "doc_id").limit(texts)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")  # ids: bounded by ``texts``

    def run(batches):
        for batch in few_rows(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (tokens, tags, whole) in enumerate(_windows(text or "", np.random.default_rng(abs(doc_id) + seed))):
                    rows.append((doc_id, n, B in tags, tokens, tags, whole))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n", "has", "tokens", "tags", "whole"])

    made = sample.mapInArrow(run, "doc_id long, n int, has boolean, tokens array<string>, tags array<int>, whole array<string>")
    rank = F.row_number().over(Window.partitionBy("has").orderBy(F.xxhash64("doc_id", "n"), "doc_id", "n"))
    rows = made.withColumn("rank", rank).where(F.col("rank") <= windows).orderBy("has", "rank").collect()
    field = Field()
    field.train([(r["tokens"], r["tags"], r["whole"]) for r in rows])
    return Field(*field.state())


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field.state())  # bounded by the training windows

    def run(batches):
        local = Field(*shared.value)
        for batch in few_rows(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text, local)
                kinds = [k for _, _, k in every]
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), kinds.count("crf")))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redact(docs: DataFrame, field: Field, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each found span replaced by ``mark``; ``n_chars`` follows, all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(field.state())
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        local = Field(*shared.value)
        for batch in few_rows(batches):
            texts, sizes = [], []
            for text in batch.column(at).to_pylist():
                _, spans = all_spans(text, local)
                if spans:
                    out, end = [], 0
                    for a, b, _ in spans:
                        if a >= end:
                            out += [text[end:a], mark]
                        end = max(end, b)
                    text = "".join(out) + text[end:]
                texts.append(text)
                sizes.append(len(text) if spans else None)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=pa.string())
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([o if n is None else n for o, n in zip(old, sizes, strict=True)], type=columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
