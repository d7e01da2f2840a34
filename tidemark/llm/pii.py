"""Personal data: fixed patterns, and a linear-chain conditional random field that finds what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_ids, fields

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9]+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_BLANK = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid(kind: str, text: str) -> bool:
    """The rule a match of a kind has to pass."""
    if kind == "ip":
        return all(len(n) < 4 and int(n or 0) <= 255 for n in (p.lstrip("0") for p in text.split(".")))
    digits = "".join(_DIGITS.findall(text))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def _emails(text: str) -> Iterator[Span]:
    """Around each @: the run of local characters before it, the dotted name after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
            at = text.find("@", end)
        else:
            # The next local part cannot reach back over this @.
            end, at = max(end, at + 1), text.find("@", at + 1)


def _ips(text: str) -> Iterator[Span]:
    """Four numbers at a time from each run of dotted numbers."""
    for run in _NUMBERS.finditer(text):
        parts = [m.span() for m in _NUMBER.finditer(text, *run.span())]
        for i in range(0, len(parts) - 3, 4):
            yield "ip", parts[i][0], parts[i + 3][1]


def matches(text: str) -> tuple[list[Span], list[Span]]:
    """(spans, dropped): pattern matches of a text that pass their rules, and those that do not."""
    if not _MARK.search(text):
        return [], []
    found = [*_emails(text)] if "@" in text else []
    found += _ips(text) if "." in text else []
    found += [("card", *m.span()) for m in _CARD.finditer(text)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text)]
    good, bad = [], []
    for s in found:
        (good if _valid(s[0], text[s[1] : s[2]]) else bad).append(s)
    return ordered(good), bad


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- words and features


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit or an @, as (start, end) of each word.

    All other words can only be tagged O: the model says so, which cuts the chain into these runs, and
    decoding each run by itself is decoding the whole text.
    """
    out: list[list[tuple[int, int]]] = []
    end, n = -1, len(text)
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start > 0 and text[start - 1] not in _BLANK:
            start -= 1
        stop = _stop(text, m.start())
        if out and not text[end:start].strip(_BLANK):
            out[-1].append((start, stop))
        else:
            out.append([(start, stop)])
        end = stop
        m = _MARK.search(text, stop) if stop < n else None
    return out


_GAP = re.compile(r"[\x20\x09-\x0D]|\Z")


def _stop(text: str, at: int) -> int:
    return _GAP.search(text, at).start()


_LONG = 64  # a longer word shows its first and last characters


def shape(word: str) -> str:
    """X, x, d for upper, lower and digits, the rest as is; runs as one character and a length class."""
    if len(word) > _LONG:
        word = word[: _LONG // 2] + word[-_LONG // 2 :]
    out, last, n = [], "", 0
    for c in word + "\0":
        k = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if k == last:
            n += 1
            continue
        if last:
            out.append(last if last not in "dXx" else last + (str(n) if last == "d" and n < 5 else "+" if n > 4 else ""))
        last, n = k, 1
    return "".join(out)


def _count(word: str) -> str:
    """The digits of a word as a class: cards, phones and addresses have their own numbers of them."""
    n = sum("0" <= c <= "9" for c in word)
    return str(n) if n < 10 else "10-13" if n < 14 else "14-19" if n < 20 else "20+"


def features(words: list[str], before: str, after: str) -> list[list[str]]:
    """Word-shape features of each word of a run; before and after are the words around it."""
    shapes = [shape(before), *map(shape, words), shape(after)]
    out = []
    for i, w in enumerate(words, 1):
        s = shapes[i]
        out.append([
            "bias", f"s={s}", f"n={_count(w)}", f"a={s[:2]}", f"z={s[-2:]}", f"@={'@' in w}", f".={min(w.count('.'), 4)}",
            f"p={shapes[i - 1][:6]}", f"q={shapes[i + 1][:6]}", f"p+={w[:1] == '+'}",
        ])
    return out


def _around(text: str, run: list[tuple[int, int]]) -> tuple[str, str]:
    """The words before and after a run; of a long word the part next to it."""
    left = text[max(0, run[0][0] - _LONG) : run[0][0]].split()
    right = text[run[-1][1] : run[-1][1] + _LONG].split()
    return (left[-1] if left else ""), (right[0] if right else "")


# ---------------------------------------------------------------- the model


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    index: dict[str, int]
    emit: np.ndarray  # feature x tag
    move: np.ndarray  # tag x tag
    begin: np.ndarray  # tag

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(TAGS)))
        for i, names in enumerate(rows):
            known = [self.index[f] for f in names if f in self.index]
            out[i] = self.emit[known].sum(0)
        return out

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths of many runs at once: runs are padded to the longest of their length class."""
        paths: list[np.ndarray] = [np.zeros(0, np.int64)] * len(batch)
        order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            lengths = np.array([len(batch[i]) for i in part])
            longest = int(lengths.max())
            x = np.zeros((len(part), longest, len(TAGS)))
            for r, i in enumerate(part):
                x[r, : len(batch[i])] = batch[i]
            best = x[:, 0] + self.begin
            back = np.zeros((len(part), longest, len(TAGS)), np.int8)
            for t in range(1, longest):
                through = best[:, :, None] + self.move
                back[:, t] = through.argmax(1)
                step = through.max(1) + x[:, t]
                best = np.where((t < lengths)[:, None], step, best)
            tag = best.argmax(1)
            rows = np.arange(len(part))
            path = np.zeros((len(part), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                inside = t < lengths
                path[inside, t] = tag[inside]
                tag = np.where(inside & (t > 0), back[rows, t, tag], tag)
            for r, i in enumerate(part):
                paths[i] = path[r, : lengths[r]]
        return paths


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Forbidden starts and moves (-inf where I follows anything but B or I of its kind)."""
    move, begin = np.zeros((len(TAGS), len(TAGS))), np.zeros(len(TAGS))
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            begin[j] = -1e4
            for i, before in enumerate(TAGS):
                if before == "O" or before[2:] != tag[2:]:
                    move[i, j] = -1e4
    return move, begin


def train(table: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by full-batch Adam over runs ``(features of each word, tag of each word)``.

    Equal runs are merged and weighted.  With an empty table every word is O.
    """
    merged: dict[tuple, int] = {}
    for rows, tags in table:
        key = (tuple(map(tuple, rows)), tuple(tags))
        merged[key] = merged.get(key, 0) + 1
    index: dict[str, int] = {}
    for rows, _ in merged:
        for names in rows:
            for f in names:
                index.setdefault(f, len(index))
    stop_move, stop_begin = _allowed()
    emit, move, begin = np.zeros((len(index), len(TAGS))), np.zeros_like(stop_move), np.zeros_like(stop_begin)
    if not merged:
        begin[0] = 1.0
        return Field(index, emit, move + stop_move, begin + stop_begin)
    keys = sorted(merged, key=lambda k: len(k[0]))
    total = sum(merged.values())
    groups = []
    for n in sorted({len(k[0]) for k in keys}):
        same = [k for k in keys if len(k[0]) == n]
        ids = np.array([[[index[f] for f in names] for names in rows] for rows, _ in same])
        groups.append((ids, np.array([t for _, t in same]), np.array([merged[k] for k in same]) / total))
    state = [(w, np.zeros_like(w), np.zeros_like(w)) for w in (emit, move, begin)]
    for step in range(1, steps + 1):
        grads = [ridge * w for w, _, _ in state]
        for ids, gold, weight in groups:
            x = emit[ids].sum(2)
            m, b = move + stop_move, begin + stop_begin
            length = x.shape[1]
            alpha, beta = [x[:, 0] + b], [np.zeros_like(x[:, 0])]
            for t in range(1, length):
                alpha.append(_log_sum(alpha[-1][:, :, None] + m, 1) + x[:, t])
            for t in range(length - 1, 0, -1):
                beta.insert(0, _log_sum(m + (x[:, t] + beta[0])[:, None, :], 2))
            z = _log_sum(alpha[-1], 1)
            r = np.arange(len(gold))
            for t in range(length):
                p = np.exp(alpha[t] + beta[t] - z[:, None])
                p[r, gold[:, t]] -= 1
                p *= weight[:, None]
                for k in range(ids.shape[2]):
                    np.add.at(grads[0], ids[:, t, k], p)
                if t == 0:
                    grads[2] += p.sum(0)
                else:
                    q = np.exp(alpha[t - 1][:, :, None] + m + (x[:, t] + beta[t])[:, None, :] - z[:, None, None])
                    grads[1] += (q * weight[:, None, None]).sum(0)
                    np.add.at(grads[1], (gold[:, t - 1], gold[:, t]), -weight)
        for (w, first, second), g in zip(state, grads, strict=True):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(index, emit, move + stop_move, begin + stop_begin)


def examples(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled runs of a text: words of pattern matches carry their kind, all others O.

    A run that holds a match dropped by its rule is not labelled: such a match is what the model is for.
    """
    good, bad = matches(text)
    out = []
    for run in runs(text):
        a, b = run[0][0], run[-1][1]
        inside = [s for s in good if s[1] < b and s[2] > a]
        if any(s[1] < b and s[2] > a and _doubtful(s, text) for s in bad):
            continue
        tags = [0] * len(run)
        for kind, start, end in inside:
            words = [i for i, (c, d) in enumerate(run) if c < end and d > start]
            if all(tags[i] == 0 for i in words):
                for j, i in enumerate(words):
                    tags[i] = TAGS.index(("I-" if j else "B-") + kind)
        before, after = _around(text, run)
        out.append((features([text[c:d] for c, d in run], before, after), tags))
    return out


def _doubtful(span: Span, text: str) -> bool:
    """A dropped match with enough digits to hold something of its kind (a plain short number does not)."""
    kind, a, b = span
    return len(_DIGITS.findall(text[a:b])) >= {"card": 14, "phone": 10}.get(kind, 4)


_TRIM = {
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9][ ().0-9-]+[0-9]"),
}


def added(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """Spans of the model that overlap no base span: trimmed to their characters, and valid for their kind."""
    out = []
    for kind, a, b in found:
        if kind == "email":
            hit = next(_emails(text[a:b]), None)
            hit = hit and (kind, a + hit[1], a + hit[2])
        else:
            m = _TRIM[kind].search(text, a, b)
            hit = (kind, *m.span()) if m else None
        if hit and _valid(kind, text[hit[1] : hit[2]]) and all(hit[2] <= s[1] or hit[1] >= s[2] for s in base):
            out.append(hit)
    return out


def spans_of(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; the runs of all texts are decoded together."""
    bases, work, owners = [], [], []
    for i, text in enumerate(texts):
        bases.append(matches(text)[0])
        for run in runs(text) if _MARK.search(text) else ():
            before, after = _around(text, run)
            work.append(model.scores(features([text[c:d] for c, d in run], before, after)))
            owners.append((i, run))
    found: list[list[Span]] = [[] for _ in texts]
    for (i, run), path in zip(owners, model.decode(work), strict=True):
        for (c, d), tag in zip(run, path, strict=True):
            name = TAGS[tag]
            if name[0] == "B":
                found[i].append((name[2:], c, d))
            elif name[0] == "I":
                found[i][-1] = (name[2:], found[i][-1][1], d)
    return [(b, ordered([*b, *added(t, b, f)])) for t, b, f in zip(texts, bases, found, strict=True)]


# ---------------------------------------------------------------- on tables

SAMPLE = 8_000  # documents of the labelled table
_RUNS, _WORDS = 50, 30  # of a document and of a run, for training only


def labelled(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[list[list[str]], list[int]]]:
    """The small labelled table: runs with pattern labels from ``sample`` documents (smallest hash of doc_id).

    The documents are a bounded sample by design; only their runs reach the driver.
    """
    bare = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    few = bounded_ids(bare, "doc_id", sample)  # a bounded number of longs: safe to send around

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, t) for x in batch["text"].dropna() for r, t in examples(x)[:_RUNS]]
            yield pd.DataFrame({"features": [r for r, _ in rows], "tags": [t for _, t in rows]}, dtype=object)

    schema = fields(features="array<array<string>>", tags="array<int>")
    found = bare.join(F.broadcast(few), "doc_id", "left_semi").mapInPandas(run, schema)
    return [([list(w) for w in r["features"]], list(r["tags"])) for r in found.collect() if len(r["tags"]) <= _WORDS]


def find(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: base counts, a digest of the base spans, and all spans.

    A null text is empty.  Offsets are code points.  Repeated rows are treated alike, a null doc_id is
    kept, other columns are ignored.
    """
    model = model or train(labelled(docs))
    names = [f"n_{k}" for k in KINDS]
    schema = fields(doc_id="bigint", **dict.fromkeys(names, "bigint"), base_sha256="string", spans="string", n_added="bigint")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for base, every in spans_of([t or "" for t in batch["text"]], model):
                count = [sum(s[0] == k for s in base) for k in KINDS]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((*count, digest, listed(every), len(every) - len(base)))
            out = pd.DataFrame(rows, columns=[*names, "base_sha256", "spans", "n_added"])
            yield pd.concat([batch[["doc_id"]], out], axis=1)

    bare = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return bare.mapInPandas(run, schema)


def redact(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind, and n_chars brought up to date.

    Overlapping spans are replaced as one, under the kind that starts first.  A null text stays null.
    """
    model = model or train(labelled(docs))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        found = spans_of([t or "" for t in texts], model)
        return pd.Series([t if not every else replaced(t, every) for t, (_, every) in zip(texts, found, strict=True)], dtype=object)

    out = docs.withColumn("text", clean(docs["text"].cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def replaced(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
