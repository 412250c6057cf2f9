"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Base spans come from four patterns with their checks (parts of an address up to 255, Luhn, count of digits) and always
stay. Wider generators propose more: addresses whose sign is spelled ``(at)``, host numbers with dots in brackets, numbers in
phone or card shape without the prefix or with other separators, matches of the base patterns that failed a check, and parts of
these: a phone or card followed by another number is one match of its base pattern that fails. Trees score each proposal by its
format and context. They are fitted on at most ``TRAIN_DOCS`` documents (a documented bound; picked by a hash of the id) and
20 proposals for each of these (a second bound; beyond it kinds and labels take turns, each in the order of a hash of the place):
base spans, base spans rewritten the way the wider generators see them, and base spans with a number set behind them, against all
other proposals that are no base span even alone, those of wrong length beside such a number and those of spoiled base spans (a part above 255, a wrong check
digit, a price in place of a domain) among them. On the half of
the proposals that was not used for fitting, the lowest threshold per kind at which PRECISION of what it selects is right is kept, halfway to the next lower score; a
kind without such a threshold selects nothing. A selected span that overlaps a base span is dropped, and of overlapping selected
spans the best one stays.

Positions are code points. Defined results: null and empty texts hold nothing. Every input row gives a row, whatever its
id; columns other than ``doc_id`` and ``text`` are ignored, and ``redacted`` returns them unchanged.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkplume.llm import arrays as A
from sparkplume.llm.boosting import Trees

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 4000
PRECISION = 0.995
LEAST = 30  # proposals that a threshold must rest on

# fixed values: the base patterns
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PART = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+", re.IGNORECASE
)
BRACKETED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.| ?[(\[](?:dot|\.)[)\]] ?)[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
AROUND = 40  # characters kept beside a span in an altered text
NUMBER = re.compile(r"(?<!\w)[(+]?[0-9][0-9 ().\-/]{6,28}[0-9](?!\w)")
WORDS = {
    "email": ("mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}

REPORT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_matches(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and matches of the base patterns that failed their check."""
    good: list[Span] = []
    bad: list[Span] = []
    # each match of the address pattern holds one sign, so the signs are tried in turn; every step is linear
    after, place = 0, text.find("@")
    while place >= 0:
        domain = DOMAIN.match(text, place)
        local = text[after:place]
        start = after + len(local.rstrip(LOCAL))
        if domain and start < place:
            after = domain.end()
            good.append((start, 0, after))
        place = text.find("@", max(after, place + 1))
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            ends = [d.end() for d in PART.finditer(text, m.start(), m.end())]
            start = m.start()
            for k in range(3, len(ends), 4):  # four parts at a time, from the left
                parts = text[start : ends[k]].split(".")
                (good if all(map(_small, parts)) else bad).append((start, 1, ends[k]))
                start = ends[k] + 1
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                good.append((m.start(), 2, m.end()))
            elif len(digits) >= 12:
                bad.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                (good if 10 <= len(_digits(m.group())) <= 15 else bad).append((m.start(), 3, m.end()))
    return sorted(good), bad


def parts_of(text: str, start: int, end: int, least: int, most: int, first: bool) -> list[tuple[int, int]]:
    """Stretches of whole groups of digits that hold ``least`` to ``most`` of them; ``first``: from the start only."""
    groups = [m.span() for m in PART.finditer(text, start, end)]
    found = []
    for i in range(1 if first else len(groups)):
        n = 0
        for low, high in groups[i : i + most]:
            n += high - low
            if n > most:
                break
            if n >= least:
                found.append((start if first else groups[i][0], high))
    return found


def proposals(text: str, base: list[Span], failed: list[Span]) -> list[Span]:
    """Overlapping spans of the wider generators, without those that are base spans."""
    found = set()
    for start, kind, end in failed:
        if KINDS[kind] != "card" or end - start <= 41:  # 21 digits and the separators between them
            found.add((start, kind, end))
        if KINDS[kind] == "phone":
            found |= {(start, kind, high) for _, high in parts_of(text, start, end, 10, 15, True)}
        if KINDS[kind] == "card":
            spans = parts_of(text, start, end, 14, 19, False)
            found |= {(low, kind, high) for low, high in spans if luhn(_digits(text[low:high]))}
    folded = text.casefold() if "(" in text or "[" in text else ""
    if "at)" in folded or "at]" in folded:
        found |= {(m.start(), 0, m.end()) for m in SPELLED.finditer(text)}
    if DIGIT.search(text):
        if any(mark in folded for mark in ("dot)", "dot]", ".)", ".]")):
            found |= {(m.start(), 1, m.end()) for m in BRACKETED.finditer(text) if all(map(_small, PART.findall(m.group())))}
        for m in NUMBER.finditer(text):
            n = len(_digits(m.group()))
            if 9 <= n <= 15:
                found.add((m.start(), 3, m.end()))
            if 13 <= n <= 19:
                found.add((m.start(), 2, m.end()))
    return sorted(found - set(base))


def features(text: str, span: Span, form: str | None = None) -> list[float]:
    """Format and context of a span; ``form`` stands in for its text when a rewritten span is described."""
    start, kind, end = span
    form = text[start:end] if form is None else form
    digits = _digits(form)
    groups = re.findall(r"[0-9]+", form)
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    marks = re.sub(r"[A-Za-z0-9]", "", form)
    place = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isdigit() else 3.0 if c.isalpha() else 4.0
    return [
        float(kind),
        len(form),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(marks),
        len(set(marks)),
        float(form[:1] == "+"),
        float("(" in form),
        float(form.count(".")),
        float(form.count("-")),
        float(luhn(digits)) if digits else 0.0,
        float(all(map(_small, groups))) if groups else 0.0,
        float(len(form.rsplit(".", 1)[-1])),
        len(digits) / max(len(form), 1),
        place(before[-1:]),
        place(after[:1]),
        float(any(w in before.lower() for w in WORDS[KINDS[kind]])),
        float(len(_digits(before + after))),
    ]


def rewritten(text: str, span: Span) -> str:
    """A base span in one of the forms that only the wider generators see, chosen by its own bytes."""
    form, kind = text[span[0] : span[2]], KINDS[span[1]]
    pick = zlib.crc32(form.encode()) % 3
    if kind == "email":
        return form.replace("@", (" (at) ", "[at]", "(at)")[pick])
    if kind == "phone":
        return (form[1:], form[1:].lstrip("0123456789 "), form[1:].replace(" ", "."))[pick]
    if kind == "card":
        step = (".", "/", "  ")[pick]
        digits = _digits(form)
        return step.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return form.replace(".", ("[.]", "(dot)", " [dot] ")[pick])


def alone(form: str, kind: int) -> bool:
    return (0, kind, len(form)) in base_matches(form)[0]


def altered(text: str, span: Span) -> list[tuple[list[float], int]]:
    """Features and labels of proposals in texts made from a base span: a number set behind it, or the span spoiled."""
    start, kind, end = span
    before, form, after = text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]
    mark = zlib.crc32(form.encode())
    quad = ".".join(str(b) for b in mark.to_bytes(4, "big"))
    numbers = (quad, f"{mark:010d}{mark % 1000000:06d}", f"{mark:010d}"[: 3 + mark % 6])
    texts: list[tuple[str, str]] = []  # what stands before the span, and from its start on
    spoiled = ""
    if KINDS[kind] in ("card", "phone"):
        texts += [(before, f"{form} {number}{after}") for number in numbers]
    if KINDS[kind] == "card":
        texts += [(f"{before}{number} ", form + after) for number in numbers[1:]]
        spoiled = form[:-1] + str((int(form[-1]) + 1 + mark % 8) % 10)
    if KINDS[kind] == "ip":
        spoiled = f"{form.rsplit('.', 1)[0]}.{256 + mark % 700}"
    if KINDS[kind] == "email":
        words = re.findall(r"[^\W\d_]+", before + " " + after, re.ASCII) or ["here"]
        spoiled = f"{words[0]} (at) {mark % 900}.{mark % 97:02d}"  # a price
    right_texts = len(texts)
    if spoiled:
        texts.append((before, spoiled + after))
    out = []
    if KINDS[kind] == "email":  # names without numbers too
        local, domain = form.split("@")
        out.append((features(text, span, f"{DIGIT.sub('', local) or 'name'} (at) {DIGIT.sub('', domain)}"), 1))
    for n, (head, tail) in enumerate(texts):
        made = head + tail
        own = (len(head), kind, len(made) - len(after))
        if n < right_texts:
            own = (len(head), kind, len(head) + len(form))
        base, failed = base_matches(made)
        for s in proposals(made, base, failed):  # what does not meet the span is not known to be right or wrong
            if s[0] < own[2] and s[2] > own[0] and all(s[2] <= b[0] or s[0] >= b[2] for b in base):
                out.append((features(made, s), int(s == own and n < right_texts)))
    return out


class Selector:
    """Trees and a threshold per kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        fold = np.arange(len(y)) % 2 == 0
        self.trees = Trees(x[fold], y[fold])
        self.limit = np.full(len(KINDS), 2.0)
        kept = ~fold
        score = self.trees.score(x[kept]) if kept.any() else np.empty(0)
        for kind in range(len(KINDS)):
            own = x[kept][:, 0] == kind if kept.any() else np.empty(0, dtype=bool)
            if not own.any() or not y[kept][own].any():
                continue
            order = np.argsort(-score[own], kind="stable")
            s, right = score[own][order], np.cumsum(y[kept][own][order])
            count = np.arange(1, len(s) + 1)
            last = np.concatenate((s[1:] < s[:-1], [True]))  # equal scores are selected together
            fine = np.flatnonzero(last & (right >= PRECISION * count) & (count >= LEAST))
            if len(fine):
                low = fine[-1]
                below = s[low + 1] if low + 1 < len(s) else 0.0
                self.limit[kind] = (s[low] + below) / 2

    def select(self, text: str, base: list[Span], failed: list[Span]) -> list[Span]:
        offered = proposals(text, base, failed)
        if not offered:
            return base
        score = self.trees.score(np.array([features(text, s) for s in offered]))
        taken = list(base)
        for k in np.argsort(-score, kind="stable").tolist():
            start, kind, end = offered[k]
            if score[k] >= self.limit[kind] and all(end <= t[0] or start >= t[2] for t in taken):
                taken.append(offered[k])
        return sorted(taken)


def _example_batches(batches):
    for batch in A.slices(batches):
        x, y, place = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            base, failed = base_matches(text or "")
            for s in base:
                x += [features(text, s), features(text, s, rewritten(text, s))]
                y += [1, 1]
                made = altered(text, s)
                x += [m[0] for m in made]
                y += [m[1] for m in made]
                place += [(doc, *s)] * (2 + len(made))
            # a part of a failed match that alone would be a base span may be right: it is no example
            covered = [
                s
                for s in proposals(text or "", base, failed)
                if all(s[2] <= b[0] or s[0] >= b[2] for b in base) and not alone(text[s[0] : s[2]], s[1])
            ]
            x += [features(text, s) for s in covered]
            y += [0] * len(covered)
            place += [(doc, *s) for s in covered]
        columns = [pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())]
        columns += [pa.array([p[k] for p in place], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["x", "y", "doc_id", "start", "kind", "end"])


def examples(docs: DataFrame, rows: int) -> DataFrame:
    """(x, y) of the proposals of ``rows`` documents, 20 times as many at most.

    Beyond that bound the examples of each kind and label are taken in turn, each in the order of a hash of its place.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    found = sample.mapInArrow(_example_batches, "x array<double>, y int, doc_id long, start long, kind long, end long")
    mark = F.xxhash64("doc_id", "kind", "start", "end", F.lit(29))
    turn = F.row_number().over(Window.partitionBy("kind", "y").orderBy(mark, "x"))
    found = found.withColumn("turn", turn).where(F.col("turn") <= 20 * rows)
    return found.orderBy("turn", "kind", "y").limit(20 * rows).select("x", "y")


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> Selector:
    """Fit on the proposals of a bounded sample of documents."""
    found = examples(docs, rows).orderBy("x", "y").toArrow()
    x = np.array(found["x"].to_pylist(), dtype=np.float64).reshape(len(found), len(features("", (0, 0, 0))))
    y = found["y"].to_numpy().astype(np.float64)
    # folds must not follow the order of the features
    order = np.random.RandomState(3).permutation(len(y))
    return Selector(x[order], y[order])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, selector: Selector) -> DataFrame:
    """Per document the counts of base spans, the digest of their list, and the list of all spans."""
    held = docs.sparkSession.sparkContext.broadcast(selector)

    def run(batches):
        for batch in A.slices(batches):
            counts, digests, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base, failed = base_matches(text or "")
                counts.append([sum(s[1] == k for s in base) for k in range(len(KINDS))])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(held.value.select(text or "", base, failed)))
            n = np.array(counts, dtype=np.int64).reshape(-1, len(KINDS))
            columns = [batch.column("doc_id"), *(pa.array(n[:, k]) for k in range(len(KINDS)))]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests), pa.array(spans)], names)

    return docs.select("doc_id", "text").mapInArrow(run, REPORT)


def personal_data(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))


def redact(text: str | None, selector: Selector) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if not text:
        return text
    spans = selector.select(text, *base_matches(text))
    out, after = [], 0
    for start, kind, end in spans:
        if start >= after:
            out += [text[after:start], f"[{KINDS[kind].upper()}]"]
        after = max(after, end)
    return "".join([*out, text[after:]]) if spans else text


def redacted(docs: DataFrame, selector: Selector) -> DataFrame:
    """Whole rows with personal data replaced in ``text``; ``n_chars``, if there, follows the new text."""
    held = docs.sparkSession.sparkContext.broadcast(selector)

    def run(batches):
        for batch in A.slices(batches):
            text = [redact(t, held.value) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
