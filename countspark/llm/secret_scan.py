"""Secrets in texts: fixed patterns, and formats inferred from the credentials that these label.

The patterns give labelled credentials of three kinds. For each kind a prefix tree of a bounded sample is folded into a probabilistic
automaton: states whose symbol and end frequencies do not differ by more than a Hoeffding bound are merged. Every other token of a text
of at least half the length of the shortest credential of a kind is then scored under the automata against a model of ordinary characters, and
tokens as likely as held-out credentials are added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from countspark.llm.common import id_column, slices
from countspark.session import keep

#: Kinds in the order of output, patterns and least lengths.
KINDS = ("assign", "access", "hex", "inferred")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is matched whole, so shorter ones may fail at once
TOKEN = r"[A-Za-z0-9+/_.=-]"
KEYWORDS = ("passw", "secret", "token", "api")
#: Distinct credentials per kind that an automaton is learnt from at most (smallest hash first), their characters in all, and those of one.
SAMPLE = 1000
SAMPLE_CHARS = 200_000
LONGEST = 4096
#: Confidence of the merge test, least count of a tested state, probability of an unseen symbol, least gain per character in nats.
CONFIDENCE = 0.05
LEAST_COUNT = 10
UNSEEN = 1e-3
GAIN = 0.5
#: How far, in nats per character, a token may stay behind the held-out credentials (a token of another length ends less likely).
SLACK = 0.25
#: Nats that a format must leave open: a token it holds likelier than that is a word of a list (as in "token: string") and no credential.
OPEN = 9.0
#: Tokens whose verdict a task remembers.
REMEMBERED = 1 << 18
#: Tokens are scored from half the length of the shortest credential of a kind on, and from so many characters, as credentials have.
SHORTEST = 6


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the value)`` of the pattern matches, in order; offsets are code points."""
    found = []
    folded = text.lower()
    if any(k in folded for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


class Automaton:
    """A probabilistic automaton folded from the prefix tree of example strings."""

    def __init__(self, examples: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.out: list[Counter] = [Counter()]
        self.total, self.end = [0], [0]
        for example in examples:
            at = 0
            self.total[0] += 1
            for c in example:
                self.out[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.out.append(Counter())
                    self.total.append(0)
                    self.end.append(0)
                at = self.next[at][c]
                self.total[at] += 1
            self.end[at] += 1
        self._fold()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if n1 < LEAST_COUNT or n2 < LEAST_COUNT:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / CONFIDENCE)) * (n1 ** -0.5 + n2 ** -0.5)

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self.total[b] < LEAST_COUNT:
                continue
            if self._differ(self.end[a], self.total[a], self.end[b], self.total[b]):
                return False
            for c in self.out[a].keys() | self.out[b].keys():
                if self._differ(self.out[a][c], self.total[a], self.out[b][c], self.total[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _merge(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.end[a] += self.end[b]
            self.out[a] += self.out[b]
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _fold(self) -> None:
        red = [0]
        while True:
            members = set(red)
            blue = [(self.total[b], -r, c, r, b) for r in red for c, b in self.next[r].items() if b not in members]
            if not blue:
                break
            _, _, c, r, b = max(blue)
            for a in red:
                if self._alike(a, b):
                    self.next[r][c] = a
                    self._merge(a, b)
                    break
            else:
                red.append(b)
        name = {s: i for i, s in enumerate(red)}
        self.states = [{c: (name[self.next[s][c]], math.log(n / self.total[s])) for c, n in self.out[s].items()} for s in red]
        self.ends = [math.log(max(self.end[s], UNSEEN) / self.total[s]) if self.total[s] else math.log(UNSEEN) for s in red]


def likelihood(states: list[dict], ends: list[float], token: str) -> float:
    """Log likelihood per character; an unseen symbol costs ``UNSEEN`` and leaves the state as it is."""
    at, total, floor = 0, 0.0, math.log(UNSEEN)
    for c in token:
        step = states[at].get(c)
        if step is None:
            total += floor
        else:
            at, cost = step
            total += cost
    return (total + ends[at]) / max(1, len(token))


def _learn(kind: str, values: list[str]) -> dict:
    """Automaton of one kind, and the lowest likelihood of the one in five credentials that are held out of it."""
    held = values[::5] if len(values) >= 10 else values
    model = Automaton([v for i, v in enumerate(values) if i % 5] if len(values) >= 10 else values)
    scores = sorted(likelihood(model.states, model.ends, v) for v in held)
    return {"kind": kind, "states": model.states, "ends": model.ends, "least": scores[len(scores) // 20], "shortest": max(SHORTEST, min(map(len, values)) // 2)}


def learn_formats(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> dict:
    """Automata of the kinds that occur in the documents, and the character frequencies of ordinary words.

    The credentials are labelled by the patterns, in all texts. Each kind is learnt from at most ``sample`` distinct credentials, those with the
    smallest hashes. Only such samples, and the counts of the token characters, reach the driver.
    """
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found, letters = set(), Counter()
            for value in batch.column(0).to_pylist():
                if not value:
                    continue
                spans = base_spans(value)
                found.update((KINDS[k], value[at:end]) for _, k, end, at in spans if end - at <= LONGEST)
                letters.update(value if not spans else "".join(value[a:b] for a, b in zip([0, *(s[2] for s in spans)], [*(s[0] for s in spans), len(value)])))
            rows = [(k, v, 1) for k, v in found] + [("", c, n) for c, n in letters.items() if re.match(TOKEN, c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                              pa.array([r[2] for r in rows], pa.int64())], ["kind", "value", "n"])

    seen = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(label, "kind string, value string, n bigint")
    seen = keep(seen.groupBy("kind", "value").agg(F.sum("n").alias("n")))
    letters = {r["value"]: r["n"] for r in seen.where("kind = ''").collect()}  # one row per token character
    formats = []
    for row in seen.where("kind <> ''").groupBy("kind").count().orderBy("kind").collect():
        # hashes below a bound that about four times the sample is expected to meet, so that few rows are sorted at any size
        bound = min(1 << 32, math.ceil((1 << 34) * max(sample, 250) / row["count"]))
        few = seen.where((F.col("kind") == row["kind"]) & (F.pmod(F.xxhash64("value"), F.lit(1 << 32)) < bound))
        values, chars = [], 0
        for r in few.select("value").orderBy(F.pmod(F.xxhash64("value"), F.lit(1 << 32)), "value").limit(sample).collect():
            chars += len(r["value"])
            if values and chars > SAMPLE_CHARS:
                break
            values.append(r["value"])
        formats.append(_learn(row["kind"], values))
    total = sum(letters.values()) + 66
    return {"formats": formats, "letters": {c: math.log((n + 1) / total) for c, n in letters.items()}, "rare": math.log(1 / total)}


class Scorer:
    """Scores tokens under learnt formats; what it said of a token is remembered for a while."""

    def __init__(self, formats: dict):
        self.formats = formats
        shortest = min((m["shortest"] for m in formats["formats"]), default=0)
        self.tokens = re.compile(f"{TOKEN}{{{shortest},}}") if formats["formats"] else None
        self.known: dict[str, bool] = {}

    def _fits(self, token: str) -> bool:
        letters, rare = self.formats["letters"], self.formats["rare"]
        plain = sum(letters.get(c, rare) for c in token) / len(token)
        for model in self.formats["formats"]:
            if len(token) >= model["shortest"]:
                fit = likelihood(model["states"], model["ends"], token)
                if fit >= model["least"] - SLACK and fit >= plain + GAIN and -fit * len(token) >= OPEN:
                    return True
        return False

    def fits(self, token: str) -> bool:
        """Whether a token is as likely as held-out credentials of a format, and likelier than ordinary text."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self._fits(token)
            if len(token) <= 256:
                self.known[token] = found
        return found

    def spans(self, text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Fitting tokens outside the base spans, which are in order of their starts."""
        found = []
        if self.tokens is None:
            return found
        at, upto = 0, 0  # base spans that start before the token's end, and how far they reach
        for m in self.tokens.finditer(text):
            start, end = m.span()
            while at < len(base) and base[at][0] < end:
                upto = max(upto, base[at][2])
                at += 1
            if upto <= start and self.fits(m.group()):
                found.append((start, 3, end, start))
        return found


def _told(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: key, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_inferred``.

    Spans are ``kind:start:end`` in code points over the whole text, by start and then kind. Null and empty texts have no spans. Repeated
    rows are scanned alike; other columns are ignored; an empty table gives an empty result. Without any labelled credential nothing is
    inferred. Labelled credentials of more than ``LONGEST`` characters are spans as any others, but no format is learnt from them.
    """
    formats = learn_formats(docs, text=text, sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(formats)
        for batch in slices(batches, 1):
            out = []
            for value in batch.column(1).to_pylist():
                base = base_spans(value or "")
                more = scorer.spans(value or "", base)
                n = Counter(s[1] for s in base)
                out.append((n[0], n[1], n[2], hashlib.sha256(_told(base).encode()).hexdigest(), _told(sorted(base + more)), len(more)))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_inferred"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"id {id_column(docs, key)}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_inferred bigint"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)


def redact(text: str, scorer: Scorer) -> str:
    """The text with the value of every secret replaced by ``[SECRET]``."""
    base = base_spans(text)
    out, at = [], 0
    for start, end in sorted((v, e) for _, _, e, v in base + scorer.spans(text, base)):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redacted_rows(docs: DataFrame, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows of ``docs`` with secrets replaced in the text; ``length``, where the column exists, follows a changed text."""
    formats = learn_formats(docs, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(formats)
        for batch in slices(batches, 0):
            old = batch.column(0).to_pylist()
            new = [None if v is None else redact(v, scorer) for v in old]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), pa.array([a != b for a, b in zip(old, new)], pa.bool_()), batch.column(1)], ["new", "changed", "row"])

    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.col(text).cast("string").alias("new"), F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))
    changed = rows.mapInArrow(run, T.StructType([rows.schema["new"], T.StructField("changed", T.BooleanType()), rows.schema["row"]]))

    def column(name: str) -> Column:
        if name == text:
            return F.col("new").alias(name)
        if name == length:
            return F.when(F.col("changed"), F.length("new")).otherwise(F.col("row")[name]).cast(docs.schema[name].dataType).alias(name)
        return F.col("row")[name].alias(name)

    return changed.select(*[column(c) for c in docs.columns])
