"""Personal data by candidate spans and gradient boosting.

Generators with high recall propose overlapping spans of four kinds: the base formats, and looser forms of them
(addresses with "at" and "dot" written out, numbers with other separators or without a plus sign). A base match is
always redacted. Any other candidate is scored by boosted trees over its format and its context, and redacted where
the calibrated probability reaches its kind's threshold and it overlaps no base match. A kind's threshold is the least with which the
accepted examples of a calibration fold have a precision of ``PRECISION``, at least ``LEAST_PROBABILITY``; a kind for which none has accepts nothing.

There are no labelled spans, so the trees learn from base matches, as written and rewritten in the looser forms, against
candidates of the same generators that are none: numbers with wrong check digits, octets or lengths, pieces of longer
tokens, and random numbers put in the place of a base match. Features that only repeat a base rule's decision are left out.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Booster
from .store import column, read_table, small_batches

#: The kinds in their order, and the base formats.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: A run of the first class can only match from its start, or from where the last match ended: with
#: these, long runs without a match take linear time.
_BASE = {"email": (re.compile(EMAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL)), "ip": (re.compile(IP), re.compile(r"(?<![0-9])" + IP)), "card": (re.compile(CARD), re.compile(CARD)), "phone": (re.compile(PHONE), re.compile(PHONE))}

_AT = r"(?:@|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s)"
_DOT = r"(?:\.|\[\.\]|\(\.\)|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_LOOSE = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.IGNORECASE),
    "ip": re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|,)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{0,2}[0-9]{1,6}){2,6}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:00|\+ ?)?\(?[0-9]{1,4}\)?(?:[ ./-]{0,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])"),
}
_DOTS = re.compile(_DOT, re.IGNORECASE)
_ATS = re.compile(_AT, re.IGNORECASE)
_OCTETS = re.compile(rf"(?=({_LOOSE['ip'].pattern}))", re.IGNORECASE)
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9]+")
#: What may stand between two groups of digits, and how many digits a kind has.
_SEPARATED = re.compile(r"\)?[ ._/-]{0,2}\(?")
LENGTHS = {"card": (12, 19), "phone": (9, 15)}

#: Rows that the trees are fitted and calibrated on, at most.
SAMPLE_DOCS = 1500
SAMPLE_SPANS = 12_000
#: Share of true ones among the examples that a kind's threshold accepts in the calibration fold, how many it takes at least, and
#: the probability below which nothing is accepted.
PRECISION = 0.97
LEAST_ACCEPTED = 20
LEAST_PROBABILITY = 0.9
CONTEXT = 24
_HINTS = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "iban", "tarjeta", "carte", "karte"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell"),
}


#: Endings that mail addresses often have.
TOP_DOMAINS = "com org net edu gov info io biz co eu de fr es it nl uk us at ch be pl se no dk fi pt br mx jp cn in ru ca au".split()


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int

    def order(self) -> tuple[int, int, int]:
        return self.start, KINDS.index(self.kind), self.end

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


class Ground:
    """Places that spans take, as disjoint ranges in order."""

    def __init__(self, spans: list[Span] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s in sorted(spans, key=lambda s: s.start):
            if self.ends and s.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], s.end)
            else:
                self.starts.append(s.start)
                self.ends.append(s.end)

    def meets(self, s: Span) -> bool:
        i = bisect_left(self.starts, s.end) - 1
        return i >= 0 and self.ends[i] > s.start

    def add(self, s: Span) -> None:
        """Take the places of a span that meets none."""
        i = bisect_left(self.starts, s.start)
        self.starts.insert(i, s.start)
        self.ends.insert(i, s.end)


@dataclass
class Model:
    """Trees, the threshold of each kind, and (precision, recall, true ones) of each on a fold that neither saw."""

    booster: Booster
    thresholds: dict[str, float]
    tested: dict[str, tuple[float, float, int]]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    if kind == "card":
        digits = _digits(found)
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(_digits(found)) <= 15


def _matches(kind: str, text: str) -> Iterator[re.Match]:
    here, later = _BASE[kind]
    at = 0
    while found := (here.match(text, at) if at else None) or later.search(text, at):
        yield found
        at = found.end()


def base_spans(text: str) -> list[Span]:
    """Matches of the base formats that pass their checks, in order."""
    out = []
    digits = _DIGIT.search(text) is not None
    for kind in KINDS:
        if "@" in text if kind == "email" else digits and ("+" in text or kind != "phone"):
            out += [Span(kind, m.start(), m.end()) for m in _matches(kind, text) if _valid(kind, m[0])]
    return sorted(out, key=Span.order)


def _numbers(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Cards and phones in runs of digit groups: from each group to each later one, within the lengths of the kind."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    least, most = LENGTHS[kind]
    for i, (start, _) in enumerate(groups):
        n = 0
        for k in range(i, len(groups)):
            if k > i and not _SEPARATED.fullmatch(text, groups[k - 1][1], groups[k][0]):
                break
            n += groups[k][1] - groups[k][0]
            if n > most:
                break
            if n < least:
                continue
            lo, hi = start, groups[k][1]
            if kind == "phone":
                opened = text.count("(", lo, hi) - text.count(")", lo, hi)
                hi += opened > 0 and text[hi : hi + 1] == ")"
                lo -= text[lo - 1 : lo] == "(" and text.count("(", lo, hi) < text.count(")", lo, hi)
                lo -= 1 if text[lo - 1 : lo] == "+" else 2 if text[max(0, lo - 2) : lo] == "+ " else 0
            if _LOOSE[kind].fullmatch(text, lo, hi):
                yield lo, hi


def candidates(text: str) -> list[Span]:
    """All that the loose generators propose; spans overlap.

    Of each kind these are the longest matches, and the shorter readings of them: numbers from any group of digits to any
    other, octets from any number, and addresses that end at any label.
    """
    out: dict[Span, None] = {}
    digits = _DIGIT.search(text) is not None
    for kind, pattern in _LOOSE.items():
        if kind != "email" and not digits:
            continue
        if kind == "email" and not _ATS.search(text):
            continue
        for m in pattern.finditer(text):
            out[Span(kind, m.start(), m.end())] = None
            if kind == "email":
                ends = [d.start() for d in _DOTS.finditer(text, m.start(), m.end())]
                out |= {Span(kind, m.start(), e): None for e in ends if pattern.fullmatch(text, m.start(), e)}
        if kind == "ip":
            out |= {Span(kind, *m.span(1)): None for m in _OCTETS.finditer(text)}
        elif kind != "email":
            out |= {Span(kind, lo, hi): None for lo, hi in _numbers(kind, text)}
    return list(out)


def features(text: str, s: Span) -> list[float]:
    """Format and context of a candidate."""
    found = text[s.start : s.end]
    before, after = text[max(0, s.start - CONTEXT) : s.start], text[s.end : s.end + CONTEXT]
    digits = _digits(found)
    groups = re.findall("[0-9]+", found)
    words = re.split(r"[^a-z]+", before.lower())
    letters = sum(c.isalpha() for c in found)
    return [
        float(KINDS.index(s.kind)),
        len(found), len(digits), len(groups),
        float(len(groups[0])) if groups else 0.0, float(len(groups[-1])) if groups else 0.0,
        float(max(map(len, groups))) if groups else 0.0, float(min(map(len, groups))) if groups else 0.0,
        float(luhn(digits)) if digits else 0.0,
        float(max((int(g[:6]) for g in groups), default=0) <= 255),
        float(found.count("@")), float(found.count(".")), float(found.count("-")), float(found.count(" ")), float(found.count("(")),
        float(found[:1] == "+"), float(found[:2] == "00"),
        letters / max(1, len(found)), float(len(set(digits))) if digits else 0.0,
        float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(before[-1:] in ".-/_=:"), float(after[:1] in "-/_=:"),
        float(len(before) == 0 or before[-1:].isspace()), float(len(after) == 0 or after[:1].isspace() or after[:1] in ".,;)"),
        float(any(w.startswith(h) for w in words[-4:] for h in _HINTS[s.kind])),
        float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)),
        float(re.split(r"[^a-z0-9]+", found.lower())[-1] in TOP_DOMAINS),
        float("[at]" in found.lower() or "(at)" in found.lower()), float(" at " in found.lower()), float("dot" in found.lower()),
    ]


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(["", "n", "r", "s"])


def _rewritten(kind: str, found: str, rng: random.Random) -> str | None:
    """A base match in another form that means the same."""
    if kind == "email":
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" at ", " dot "), ("@", " dot ")])
        name, _, domain = found.partition("@")
        # names and domains of all sorts, so that only the form and the ending tell
        name = rng.choice([name, re.sub("[0-9]+", "", name).strip(".") or "me", f"{_word(rng)}.{_word(rng)}", _word(rng)])
        domain = rng.choice([domain, f"{_word(rng)}.{rng.choice(TOP_DOMAINS)}", f"{_word(rng)}.{_word(rng)}.{rng.choice(TOP_DOMAINS)}"])
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return found.replace(".", rng.choice(["[.]", " [dot] ", "(dot)"])) if rng.random() < 2 / 3 else found.replace(".", "[dot]")
    digits = _digits(found)
    if kind == "card":
        if len(digits) != 16:
            return None
        return rng.choice([".", "/", "  ", "_"]).join(digits[i : i + 4] for i in range(0, 16, 4))
    if len(digits) < 10:
        return None
    area, mid, end = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice([f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"00{digits[:-10]} {area} {mid} {end}"])


def _decoy(kind: str, rng: random.Random) -> str:
    """A number that looks like one of the kind and is none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "ip":
        return rng.choice([f"{d(1)}.{d(2)}.{d(1)}.{300 + rng.randrange(600)}", f"{d(2)},{d(3)},{d(3)},{d(3)}"])
    if kind == "card":
        wrong = d(16)
        while luhn(wrong):
            wrong = d(16)
        return rng.choice([wrong, "-".join(wrong[i : i + 4] for i in range(0, 16, 4)), d(8) + "." + d(6)])
    if kind == "phone":
        return rng.choice([f"{rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{d(2)}.{d(2)}", f"{d(3)} {d(3)}", d(7), d(8), d(5) + "-" + d(2), f"{d(1)}.{d(3)}.{d(3)}"])
    w = lambda: _word(rng)
    return rng.choice([f"{w()} at {w()}.{w().capitalize()}", f"{w()} at {w()} dot {w()}", f"{w()} at {d(2)}.{d(2)}", f"{w()} (at) {w()}. {w()}", f"{w()}@{w()} dot {w()}", f"{w()}[at]{w()}.{d(1)}"])


def _date(rng: random.Random) -> str:
    return f"{rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"


def examples(text: str, seed: int) -> list[tuple[Span, str, int]]:
    """(span, text, label) for training: from base matches, rewritten ones and decoys in their place, and other candidates."""
    rng = random.Random(seed)
    base = base_spans(text)
    taken = {k: Ground([s for s in base if s.kind == k]) for k in KINDS}
    out = [(s, text, 1) for s in base]
    # a piece of a base match of its kind has no label of its own
    out += [(s, text, 0) for s in candidates(text) if not taken[s.kind].meets(s)]
    for s in base:
        for new, label in ((_rewritten(s.kind, text[s.start : s.end], rng), 1), (_decoy(s.kind, rng), 0)):
            if new is None:
                continue
            head, tail = text[max(0, s.start - 200) : s.start], text[s.end : s.end + 200]
            if s.kind in LENGTHS:
                # other numbers next to it, as a date, an expiry or a second one
                joined = rng.choice([" ", "/", ", "])
                head, tail = rng.choice([(head, tail), (head, tail), (f"{head}{_date(rng)} ", tail), (head + new + joined, tail), (head, joined + new + tail), (head, rng.choice([" 12/25", " 123", f" {_date(rng)}"]) + tail)])
            changed = head + new + tail
            for c in candidates(changed):
                if c.start < len(head) + len(new) and len(head) < c.end:
                    whole = c.kind == s.kind and c.start <= len(head) + 1 and c.end >= len(head) + len(new) - 1
                    if c.kind in LENGTHS:
                        # a number with less or more than its own groups is none
                        whole = whole and c.start >= len(head) - 1 and c.end <= len(head) + len(new) + 1
                    elif label and not whole and c.kind == s.kind:
                        continue
                    out.append((c, changed, int(bool(label and whole))))
    return out


def chosen_thresholds(kinds: np.ndarray, p: np.ndarray, y: np.ndarray, precision: float = PRECISION, least: int = LEAST_ACCEPTED) -> dict[str, float]:
    """For each kind the least probability with which the accepted rows are true ones to a share of ``precision``; 2 where none is."""
    out = {}
    for i, kind in enumerate(KINDS):
        own = kinds == i
        order = np.argsort(-p[own], kind="stable")
        ps, hits = p[own][order], np.cumsum(y[own][order])
        n = np.arange(1, len(ps) + 1)
        # a threshold accepts all rows of its probability
        last = np.append(ps[1:] != ps[:-1], True) if len(ps) else np.zeros(0, bool)
        good = last & (hits >= precision * n) & (n >= least) & (ps >= LEAST_PROBABILITY)
        out[kind] = float(ps[np.flatnonzero(good)[-1]]) if good.any() else 2.0
    return out


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> Model:
    """Fit on the spans of at most ``sample_docs`` documents that hold a base format, those whose seeded hash is least.

    Of five parts of the documents, three are for the trees, one for calibration and thresholds, and one to test them. Documents without an id, and those that
    repeat one, count together. Without examples no candidate is ever accepted.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(column(id_col).cast("string").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    telling = texts.where(F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]{12}"))
    order = F.xxhash64("id", F.lit(17))
    chosen = telling.select(order.alias("h")).orderBy("h").limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h & 0x7FFFFFFF, label, features(t, s)) for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s, t, label in examples(text, h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["h", "label", "x"])

    # as many hashes as the sample has documents
    picked = telling.select("text", order.alias("h")).join(F.broadcast(chosen.distinct()), "h").select("text", "h")
    found = picked.mapInArrow(run, "h long, label int, x array<double>").orderBy("h", "label", "x").limit(sample_spans).toArrow()
    model = Model(Booster(), dict.fromkeys(KINDS, 2.0), {})
    if not found.num_rows:
        return model
    x = np.array(found.column(2).to_pylist(), float)
    y, h = found.column(1).to_numpy().astype(float), found.column(0).to_numpy()
    calibration, test = h % 5 == 0, h % 5 == 1
    fitted = ~(calibration | test)
    if len(set(y[fitted])) < 2 or not calibration.any():
        return model
    model.booster.fit(x[fitted], y[fitted]).calibrate(x[calibration], y[calibration])
    model.thresholds = chosen_thresholds(x[calibration, 0], model.booster.probability(x[calibration]), y[calibration])
    p = model.booster.probability(x[test])
    for i, kind in enumerate(KINDS):
        own = x[test, 0] == i
        taken, true = p[own] >= model.thresholds[kind], y[test][own] > 0
        model.tested[kind] = (float((taken & true).sum() / max(1, taken.sum())), float((taken & true).sum() / max(1, true.sum())), int(true.sum()))
    return model


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the accepted candidates, best first where candidates overlap."""
    base = base_spans(text)
    ground = Ground(base)
    loose = [c for c in candidates(text) if not ground.meets(c)]
    added: list[Span] = []
    if loose and model.booster.trees:
        z = model.booster.raw(np.array([features(text, c) for c in loose], float))
        p = model.booster.calibrated(z)
        accepted = [i for i, c in enumerate(loose) if p[i] >= model.thresholds[c.kind]]
        # probabilities come in steps: log odds tell within one, and of an address the longest reading stands
        for i in sorted(accepted, key=lambda i: (-p[i], loose[i].start - loose[i].end if loose[i].kind == "email" else 0, -z[i], loose[i].order())):
            if not ground.meets(loose[i]):
                ground.add(loose[i])
                added.append(loose[i])
    return base, sorted(base + added, key=Span.order)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted) for each row of ``docs``.

    Counts and the digest are of base spans, ``spans`` has all of them, by start and then kind; places are code points. In
    ``redacted`` each span is replaced by its kind in brackets. Null texts are empty, texts of any length are searched whole; null ids pass through, rows that
    repeat an id are searched one by one; extra columns are ignored, whatever their names. Where spans start at one place, the kinds come in their order. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = all_spans(text, shared.value)
                digest = hashlib.sha256(",".join(map(str, base)).encode()).hexdigest()
                rows.append((doc, *[sum(s.kind == k for s in base) for k in KINDS], digest, ",".join(map(str, spans)), redact(text, spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"])

    texts = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, redacted string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans one replacement stands for all."""
    out, at = [], 0
    for s in sorted(spans, key=Span.order):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """One row per document: base counts, their digest, and all spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs)).drop("redacted")
