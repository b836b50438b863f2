"""Personal data by candidate gradient boosting.

Generators of high recall propose spans, overlapping ones too. Each candidate gets features of its
format and of the text around it; boosted trees judge them, and a threshold per kind, set on candidates
held out from fitting, selects what is redacted. The labels are those of personal data and look-alikes
planted into texts of the table. A kind with too few of them to learn from is selected by its format and
check digits. Spans of the four base kinds are found by their patterns and
checks alone and are always selected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from hashlib import sha256
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm.columns import text_or_empty
from roamframe.llm.planted import PERSONAL, planted
from roamframe.llm.trees import Trees, boosted, least_threshold

# The patterns of the base kinds, in the order in which they are listed.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the generators propose beside the base kinds; a number that fails the card check is proposed again.
MORE = {
    "account": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "address6": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9])",
    "number": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){8,24}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "spelled_email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]?(?:@|\bat\b)[\])]?\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]?(?:\.|\bdot\b)[\])]?\x20?[A-Za-z0-9-]{1,63}){1,4}",
}
KINDS = [*BASE, *MORE]
#: Texts that spans are planted into, at most, and the longest text among them; spans per text, kind and label.
FIT_ROWS, FIT_CHARS, PLANTS = 1000, 8000, 2
#: Tasks that plant and look at what is proposed.
FIT_TASKS = 32
#: The precision asked of held-out candidates, and the least threshold, as look-alikes are more common than planted.
PRECISION, LEAST = 0.97, 0.5
_AROUND = 24
#: No candidate but a secret, which is sought everywhere, reaches further from its digit or its ``at``.
_NEAR = 140
_BASE = {k: re.compile(v) for k, v in BASE.items()}
_SPELLED = re.compile(r"@|[\[(]at[\])]|\bat\x20[A-Za-z0-9-]{1,63}\x20[\[(]?dot\b")
_MORE = {k: re.compile(v) for k, v in MORE.items()}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DIGIT, _DIGITS, _WORDS = re.compile("[0-9]"), re.compile("[0-9]+"), re.compile("[A-Za-z]+")
#: A run of digits is entered at its first one only: what fails there fails at the later ones.
_ADDRESS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
# Words that point to kinds of personal data, and to other things.
_CUES = [
    re.compile(p, re.IGNORECASE)
    for p in (
        r"\b(?:e-?mail|mail|write to|contact|correo|courriel)\b",
        r"\b(?:call|phone|tel|fax|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
        r"\b(?:card|visa|iban|account|bank|konto|compte|cuenta|karte|tarjeta|carte|customer|member|passport|id)\b",
        r"\b(?:token|key|secret|password|api|passwort|clave)\b",
        r"\b(?:version|license|chapter|page|section|isbn|file|see|on|since|time)\b",
    )
]
_HEX = re.compile(r"[0-9a-fA-F]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in text.split(".")))
    if kind == "card":
        digits = _only_digits(text)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(_only_digits(text)) <= 15
    return True


def _emails(text: str):
    """Matches of the email pattern, found from each @.

    No match crosses the border of a run of the pattern's letters around an @. In a run, a match that
    fails at the first letter before an @ fails at the later ones too, so only the first is tried.
    """
    at = text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in _LOCAL:
            start -= 1
        end = _RUN.match(text, at).end()
        while at >= 0:
            m = _BASE["email"].match(text, start, end) if start < at else None
            if m:
                yield m.start(), m.end()
            start = m.end() if m else at + 1
            at = text.find("@", start, end)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind as listed."""
    spans = []
    if "@" in text:
        spans += [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _ADDRESS), ("card", _BASE["card"]), ("phone", _BASE["phone"])):
            spans += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return sorted(spans, key=_by_start)


def _by_start(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def candidates(text: str) -> list[tuple[int, int, str]]:
    """What the generators propose; spans may overlap. All but secrets are searched near a digit or an ``at`` only."""
    spans = [(f.start(), f.end(), "secret") for f in _MORE["secret"].finditer(text)]
    for name, seed in (("", _DIGIT), ("spelled_email", _SPELLED)):
        kinds = [name] if name else [k for k in MORE if k not in ("spelled_email", "secret")]
        low = high = 0
        for m in [*seed.finditer(text), None]:
            if m and m.start() <= high:
                high = max(high, m.end() + _NEAR)
                continue
            if high:
                spans += [(f.start(), f.end(), k) for k in kinds for f in _MORE[k].finditer(text, low, high)]
            if m:
                low, high = max(high, m.start() - _NEAR), m.end() + _NEAR
    return spans


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    """Format of the span and what stands around it."""
    start, end, kind = span
    own = text[start:end]
    digits = _only_digits(own)
    letters = sum(c.isalpha() for c in own)
    before, after = text[max(0, start - _AROUND) : start], text[end : end + _AROUND]
    counts = np.bincount(np.frombuffer(own.encode("utf-8", "replace"), dtype=np.uint8))
    share = counts[counts > 0] / counts.sum()
    groups = _DIGITS.findall(own)
    classes = np.array([0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in own])
    words = _WORDS.findall(own)
    return [
        len(own),
        len(digits),
        letters,
        len(own) - len(digits) - letters,
        len(set(own)),
        float(-(share * np.log2(share)).sum()),
        float(luhn(digits)) if digits else 0.0,
        len(re.findall(r"[\x20().-]", own)),
        max((int(p[:6]) for p in groups), default=-1),
        len(groups),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        max(map(len, groups), default=0),
        float(digits[:1] or -1),
        float(digits[:3] or -1),
        sum(len(g) == 4 and "1900" <= g < "2040" for g in groups),
        sum(g == "000" for g in groups),
        float(_remainder(own) == 1),
        own.count(":"),
        own.count("::"),
        own.count("_") + own.count("-"),
        float((classes[1:] != classes[:-1]).mean()) if len(own) > 1 else 0.0,
        sum(c in "aeiouAEIOU" for c in own) / max(letters, 1),
        max(map(len, words), default=0),
        len(words[-1]) if words else 0,
        sum(w in ("at", "dot") for w in words),
        sum(own.count(c) for c in "[("),
        float(own[-1:].islower()),
        own.count(" "),
        float(". " in own or " ." in own),
        float(_HEX.fullmatch(own) is not None),
        float(own[:1].isupper()),
        own.count("@") + own.count("."),
        float(before[-1:] in ('"', "'", "=", ":")),
        float(after[:1].isalnum()),
        float(before[-1:].isalnum()),
        *[float(bool(c.search(before))) for c in _CUES],
    ]


def _remainder(own: str) -> int:
    """Of an account number by the check of its kind: 1 where it holds; 0 for other lengths and letters."""
    turned = own.replace(" ", "")
    turned = turned[4:] + turned[:4]
    if not 15 <= len(turned) <= 34 or not (turned.isascii() and turned.isalnum()):
        return 0
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def weak_label(text: str, span: tuple[int, int, str]) -> int:
    """What a candidate's format and check digits alone say; used for kinds without trees."""
    start, end, kind = span
    own = text[start:end]
    digits = _only_digits(own)
    if kind in ("ip", "phone"):
        return int(_valid(kind, own))
    if kind in ("card", "number"):
        return int(12 <= len(digits) <= 19 and luhn(digits))
    if kind == "account":
        return int(_remainder(own) == 1)
    if kind == "address6":
        return int(own.count(":") == 7 or "::" in own)
    if kind == "local_phone":
        return int(9 <= len(digits) <= 15 and bool(_CUES[1].search(text[max(0, start - _AROUND) : start])))
    if kind == "secret":
        return int(len(digits) >= 4 and len(set(own)) >= 8 and any(c.isalpha() for c in own))
    return int(bool(re.search(r"(?:@|\bat\b).*(?:\.|\bdot\b)[\])]?\x20?[a-z]{2,6}$", own)) and ("[" in own or "(" in own or "@" in own))


@dataclass
class Detector:
    """Trees and threshold per kind; a kind without enough candidates of either label has none and goes by weak_label.

    ``measured`` has recall, precision and count of planted personal data in texts neither fitted to nor
    used for the threshold.
    """

    kinds: dict[str, tuple[Trees, float]]
    measured: dict[str, tuple[float, float, int]] = field(default_factory=dict)

    def selected(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """All spans of each text: the base ones, and candidates over their threshold that overlap none.

        A candidate of a kind without trees is as likely as its weak label says. Of overlapping candidates
        one inside another gives way, then the likeliest stays, then the first, then the longest.
        """
        base = [base_spans(t) for t in texts]
        asked: dict[str, list[tuple[int, tuple[int, int, str], list[float]]]] = {}
        likely: dict[int, list[tuple[float, tuple[int, int, str]]]] = {}
        for r, text in enumerate(texts):
            for span in candidates(text):
                if any(a < span[1] and span[0] < b for a, b, _ in base[r]):
                    continue
                if span[2] in self.kinds:
                    asked.setdefault(span[2], []).append((r, span, features(text, span)))
                elif weak_label(text, span):
                    likely.setdefault(r, []).append((1.0, span))
        for kind, rows in asked.items():
            trees, least = self.kinds[kind]
            for (r, span, _), p in zip(rows, trees.probability(np.array([f for *_, f in rows]))):
                if p >= least:
                    likely.setdefault(r, []).append((p, span))
        for r, found in likely.items():
            held = sorted((a, b) for a, b, _ in base[r])
            added, reach, order = [], -1, []
            for p, span in sorted(found, key=lambda x: (x[1][0], -x[1][1], -x[0])):
                order.append((span[1] <= reach, -p, span[0], -span[1], span))
                reach = max(reach, span[1])
            for *_, span in sorted(order):
                if all(b <= span[0] or span[1] <= a for a, b, _ in added):
                    added.append(span)
            base[r] = sorted([*base[r], *added], key=_by_start)
            assert len(base[r]) == len(held) + len(added)
        return base


def _least_keys(batches):
    """The FIT_ROWS least keys of a task, each once."""
    least: set[int] = set()
    for batch in batches:
        least.update(batch.column(0).to_pylist())
        if len(least) > 2 * FIT_ROWS:
            least = set(nsmallest(FIT_ROWS, least))
    yield pa.RecordBatch.from_arrays([pa.array(nsmallest(FIT_ROWS, least), pa.int64())], ["key"])


_EXAMPLE = "part int, kind string, personal boolean, proposed boolean, label double, x array<double>"


def _examples(batches):
    """Rows (key, text) give one row per planted span and candidate over it, or one where nothing is proposed."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for kind in PERSONAL:
                for personal in (True, False):
                    for i in range(PLANTS):
                        around, start, end = planted(text, f"{key}:{i}", kind, personal)
                        # A candidate is right where more than half of it and the planted span is common.
                        over = [s for s in candidates(around) if s[2] == kind and s[0] < end and start < s[1]]
                        rows = [(1.0 if personal and 2 * (min(end, b) - max(start, a)) > max(end, b) - min(start, a) else 0.0, features(around, (a, b, k))) for a, b, k in over]
                        for label, x in rows or [(0.0, [])]:
                            for column, value in zip(out, (key % 4, kind, personal, bool(rows), label, x)):
                                column.append(value)
        types = [pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["part", "kind", "personal", "proposed", "label", "x"])


def fit(docs: DataFrame, text_col: str = "text") -> Detector:
    """Fit each kind to spans planted into at most FIT_ROWS texts.

    The texts are the least by a hash in the whole table; equal texts count once. Planting and features
    are the tasks' work; the driver gets the features of at most 4 * PLANTS * FIT_ROWS spans or so per kind.
    By the hash, half of the texts are fitted to, a quarter sets the threshold, a quarter is measured. A
    kind with fewer than five candidates of a label to fit to, or without a threshold of the precision,
    gets no trees.
    """
    spark = docs.sparkSession
    texts = docs.select(text_or_empty(text_col).alias("text")).filter(F.length("text") <= FIT_CHARS)
    texts = texts.select(F.xxhash64("text").alias("key"), "text")
    least = texts.select("key").mapInArrow(_least_keys, "key bigint").distinct().orderBy("key").limit(FIT_ROWS)
    some = spark.createDataFrame(pa.table({"key": pa.array([r.key for r in least.collect()], pa.int64())}))
    chosen = texts.join(F.broadcast(some), "key", "left_semi").dropDuplicates(["key"])
    told = chosen.repartition(FIT_TASKS).mapInArrow(_examples, _EXAMPLE).toArrow()
    columns = [told.column(c).to_numpy(zero_copy_only=False) for c in ("part", "kind", "personal", "proposed", "label")]
    features_of = told.column("x").to_pylist()
    kinds, measured = {}, {}
    for kind in PERSONAL:
        own = np.flatnonzero((columns[1] == kind) & columns[3].astype(bool))
        part, y = columns[0][own], columns[4][own]
        x = np.array([features_of[i] for i in own])
        if min(y[part < 2].sum(), (1 - y[part < 2]).sum()) < 5 or not (part == 2).any():
            continue
        trees = boosted(x[part < 2], y[part < 2])
        least_p = max(LEAST, least_threshold(trees.probability(x[part == 2]), y[part == 2], PRECISION))
        if least_p > 1:
            continue
        kinds[kind] = trees, least_p
        taken = trees.probability(x[part == 3]) >= least_p if (part == 3).any() else np.zeros(0, bool)
        missed = ((columns[1] == kind) & (columns[0] == 3) & columns[2].astype(bool) & ~columns[3].astype(bool)).sum()
        right, all_right = y[part == 3][taken].sum(), y[part == 3].sum() + missed
        measured[kind] = float(right / max(all_right, 1)), float(right / max(taken.sum(), 1)), int(all_right)
    return Detector(kinds, measured)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def personal_data(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the base kinds; spans has all, as ``kind:start:end`` by start and
    then kind, joined by commas (code points, end exclusive). A null text counts as empty and has none.
    Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    names = ["_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"]

    def detect(batches):
        for batch in batches:
            spans = shared.value.selected(batch.column(1).to_pylist())
            base = [[s for s in own if s[2] in BASE] for own in spans]
            counts = [pa.array([sum(s[2] == k for s in own) for own in base], pa.int64()) for k in BASE]
            digests = pa.array([sha256(_joined(own).encode()).hexdigest() for own in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([_joined(own) for own in spans], pa.string())], names)

    schema = "_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string"
    return rows.mapInArrow(detect, schema).withColumnRenamed("_id", id_col)


def redacted(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """``docs`` with each selected span replaced by its kind in brackets; overlapping base spans as one."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    at = docs.columns.index(text_col)

    def clean(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for text, spans in zip(texts, shared.value.selected([t or "" for t in texts])):
                parts, done = [], 0
                for a, b, kind in spans:
                    if a >= done:
                        parts += [text[done:a], f"[{kind}]"]
                    done = max(done, b)
                out.append(text if text is None else "".join(parts) + text[done:])
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)
