"""Personal data by weak-supervision aggregation.

Each text gives candidate spans: those of the base patterns, and looser ones (written-out e-mail addresses, phone numbers
without a country code, digit groups like cards). Labelers vote on a candidate: its form (regular expressions and checksums), gazetteers (domain endings,
calling codes, issuer prefixes, reserved address ranges), its context (cue words before it in several languages) and its
edges. Expectation-maximisation over the counts of vote patterns, at most 4 * 3 ** 4 rows, estimates how reliable each
labeler is for each kind; a logistic span classifier is trained on the posteriors of a bounded sample of candidates. It decides on the looser
candidates; base spans always stay.

Positions are code points, ends exclusive. Defined cases: null texts count as empty; empty texts have no spans; rows are treated one by
one, so equal or null ids don't matter; other columns are carried along by ``redact`` and left out by ``spans``.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kith.llm.common import slices
from kith.sources.workspace import materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("form", "gazetteer", "context", "edges")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LOOSE_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
_LOOSE_EMAIL = r"[A-Za-z0-9._%+-]{1,64}[ ]?[\[(](?:at|AT)[\])][ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:[\[(](?:dot|DOT)[\])]|\.)[ ]?[A-Za-z0-9-]{2,63})+"

# Public domain endings, calling codes, issuer prefixes and cue words.
_ENDINGS = frozenset("com org net edu gov mil int info io co biz name de fr es it uk us ca au jp cn in br ru nl ch at be se no dk fi pl pt ie eu".split())
_CALLING = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
            "351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972").split()
_ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "35", "36", "37", "38", "50", "56", "57", "58", "60", "62", "64", "65", "67")
_CUES = {
    EMAIL: ("mail", "e-mail", "contact", "kontakt", "courriel", "correo", "write", "schreib"),
    IP: ("ip", "host", "server", "address", "adresse", "client", "login"),
    CARD: ("card", "karte", "carte", "tarjeta", "visa", "mastercard", "payment", "credit"),
    PHONE: ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "anruf", "sms"),
}
_AGAINST = ("version", "isbn", "order", "section", "chapter", "article", "figure", "table", "serial", "build", "release")


@dataclass(frozen=True)
class PiiOptions:
    rounds: int = 10         # of expectation-maximisation
    sample: int = 20_000     # candidates the classifier is trained on, at most
    threshold: float = 0.9   # probability at which a looser candidate becomes a span


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order; linear in the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := re.compile(_DOMAIN).match(text, at + 1)):
            end = free = m.end()
            out.append((start, EMAIL, end))
        at = text.find("@", end)
    for m in re.finditer(_IP, text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in re.finditer(_CARD, text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in re.finditer(_PHONE, text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def loose_spans(text: str, base: list) -> list[tuple[int, int, int]]:
    """Further candidates that touch no base span."""
    found = [(m.start(), PHONE, m.end()) for m in re.finditer(_LOOSE_PHONE, text)]
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        found += [(m.start(), EMAIL, m.end()) for m in re.finditer(_LOOSE_EMAIL, text)]
    for m in re.finditer(_CARD, text):
        if len(m[0].replace(" ", "").replace("-", "")) <= 19:
            found.append((m.start(), CARD, m.end()))
    out, taken, k, free = [], sorted(base), 0, 0
    for start, kind, end in sorted(found):
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        if start >= free and (k == len(taken) or taken[k][0] >= end):
            out.append((start, kind, end))
            free = end
    return out


def votes(text: str, start: int, kind: int, end: int, base: bool) -> str:
    """A letter for each labeler: y, n or a (abstains)."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    form = "y" if base else "a"
    if kind == CARD and not base or kind in (CARD, PHONE) and len(set(digits)) < 3:
        form = "n"
    if kind == EMAIL:
        listed = re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in _ENDINGS
    elif kind == IP:
        listed = digits != "" and span.split(".")[0].lstrip("0") not in ("", "127", "255")
    elif kind == CARD:
        listed = digits.startswith(_ISSUERS)
    else:
        listed = span.startswith("+") and digits.startswith(tuple(_CALLING))
    gazetteer = "y" if listed else "a" if kind == PHONE and not span.startswith("+") else "n"
    near = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, start - 40):start].lower())[-4:]
    context = "n" if any(w in _AGAINST for w in near) else "y" if any(w in _CUES[kind] for w in near) else "a"
    around = text[start - 1:start] + text[end:end + 1]
    edges = "n" if any(c.isalnum() for c in around) else "y"
    return form + gazetteer + context + edges


def candidates(text: str) -> list[tuple[int, int, int, bool, str]]:
    base = base_spans(text)
    found = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
    return [(s, k, e, b, votes(text, s, k, e, b)) for s, k, e, b in sorted(found)]


CANDIDATE = "array<struct<start:bigint,kind:tinyint,end:bigint,base:boolean,votes:string>>"


def label(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``found``, the candidates of each whole text."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("found", T._parse_datatype_string(CANDIDATE))])

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int8()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string())]))
        names = ("start", "kind", "end", "base", "votes")
        for whole in batches:
            for batch in slices(whole, text):
                found = [[dict(zip(names, c)) for c in candidates(t)] if t else [] for t in batch.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], pa.array(found, kind)], [*keys, "found"])

    return df.select(*keys, text).mapInArrow(run, schema)


def reliabilities(counts: list[tuple[int, str, int]], rounds: int) -> dict:
    """Posterior of each (kind, votes) by expectation-maximisation, kind by kind; smoothed, started from trusted forms."""
    out = {}
    for kind in range(len(KINDS)):
        rows = [(v, n) for k, v, n in counts if k == kind]
        p = {v: 1 / (1 + math.exp(-(4.0 * (v[0] == "y") - 4.0 * (v[0] == "n") + sum((x == "y") - 1.5 * (x == "n") for x in v[1:]) - 1))) for v, _ in rows}
        for _ in range(rounds):
            good = sum(n * p[v] for v, n in rows)
            bad = sum(n * (1 - p[v]) for v, n in rows)
            prior = (good + 1) / (good + bad + 2)
            table = {}
            for j in range(len(LABELERS)):
                for x in "yna":
                    # A labeler's prior votes: right twice as often as wrong.
                    table[j, x] = ((sum(n * p[v] for v, n in rows if v[j] == x) + {"y": 4, "n": 2, "a": 4}[x]) / (good + 10),
                                   (sum(n * (1 - p[v]) for v, n in rows if v[j] == x) + {"y": 2, "n": 4, "a": 4}[x]) / (bad + 10))
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(table[j, x][0] / table[j, x][1]) for j, x in enumerate(v))
                p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out.update({(kind, v): p[v] for v, _ in rows})
    return out


def features(kind: int, found: str, length: int) -> list[float]:
    hot = [float(x == y) for x in found for y in "yn"]
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *hot, min(length, 40) / 40]


def train(rows: list, posterior: dict) -> list[float]:
    """Weights of the span classifier: logistic regression on the posteriors, by regularised Newton steps."""
    if not rows:
        return []
    x = np.array([features(k, v, n) for k, v, n in rows])
    y = np.array([posterior[k, v] for k, v, _ in rows])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, gradient)
    return [float(v) for v in np.round(w, 9)]


def accepted(weights: list[float], kind: int, found: str, length: int, threshold: float) -> bool:
    z = sum(a * b for a, b in zip(weights, features(kind, found, length)))
    return z >= math.log(threshold / (1 - threshold))


def fit(labelled: DataFrame, opts: PiiOptions = PiiOptions()) -> list[float]:
    """Train the span classifier; counts cover all candidates, and the sample is that of the smallest hashes."""
    each = labelled.select(F.explode("found").alias("c")).select("c.kind", "c.votes", (F.col("c.end") - F.col("c.start")).alias("n"))
    counts = [tuple(r) for r in each.groupBy("kind", "votes").agg(F.count("*")).collect()]
    posterior = reliabilities(sorted(counts), opts.rounds)
    spread = each.groupBy("kind", "votes", "n").agg(F.count("*").alias("c")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.least("c", F.lit(opts.sample)))))
    sample = spread.orderBy(F.xxhash64("kind", "votes", "n", "i"), "kind", "votes", "n", "i").limit(opts.sample).select("kind", "votes", "n").collect()
    return train(sorted(map(tuple, sample)), posterior)


def spans(df: DataFrame, keys: list[str], text: str = "text", opts: PiiOptions = PiiOptions()) -> DataFrame:
    """``keys``, ``base`` and ``spans``: arrays of (start, kind, end), base spans and all accepted ones, in order."""
    labelled = materialize(label(df, keys, text), "pii")
    weights, threshold = fit(labelled, opts), opts.threshold
    taken = "array<struct<start:bigint,kind:tinyint,end:bigint>>"
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, T._parse_datatype_string(taken)) for n in ("base", "spans"))])

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int8()), ("end", pa.int64())]))
        cut = lambda c: {k: c[k] for k in ("start", "kind", "end")}
        for batch in batches:
            found = batch.column(len(keys)).to_pylist()
            base = [[cut(c) for c in cs if c["base"]] for cs in found]
            every = [[cut(c) for c in cs if c["base"] or accepted(weights, c["kind"], c["votes"], c["end"] - c["start"], threshold)] for cs in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], pa.array(base, kind), pa.array(every, kind)], [*keys, "base", "spans"])

    return labelled.mapInArrow(run, schema)


def written(found) -> str:
    """``kind:start:end``, comma-joined."""
    return ",".join(f"{KINDS[c['kind']]}:{c['start']}:{c['end']}" for c in found)


def redact(df: DataFrame, text: str = "text", opts: PiiOptions = PiiOptions()) -> DataFrame:
    """``df`` with each span of the text replaced by its kind in angle brackets; null texts stay null."""
    weights, threshold = fit(materialize(label(df, [], text), "pii"), opts), opts.threshold
    at = df.columns.index(text)

    def clean(t):
        out, free = [], 0
        for s, k, e, b, v in candidates(t):
            if s >= free and (b or accepted(weights, k, v, e - s, threshold)):
                out += [t[free:s], f"<{KINDS[k]}>"]
                free = e
        return "".join(out) + t[free:] if out else t

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                columns = list(batch.columns)
                columns[at] = pa.array([clean(t) if t else t for t in columns[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)


def digests(found: DataFrame) -> DataFrame:
    """Replace ``base`` and ``spans`` by the counts of base spans, their digest, and all spans as text."""
    keys = [f for f in found.schema.fields if f.name not in ("base", "spans")]
    names = [f"n_{k}" for k in KINDS]
    schema = T.StructType([*keys, *(T.StructField(n, T.LongType()) for n in names),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for batch in batches:
            base, every = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("base", "spans"))
            counts = [pa.array([sum(c["kind"] == k for c in cs) for cs in base], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]),
                 pa.array(list(map(written, every)), pa.string())], [*(f.name for f in keys), *names, "base_sha256", "spans"])

    return found.mapInArrow(run, schema)
