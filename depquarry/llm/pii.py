"""Personal data by candidate gradient boosting.

High-recall generators propose spans of four kinds (email, ip, card, phone) that may overlap. Boosted trees score each
from its format and context; a span is taken if its score reaches its kind's calibrated threshold. Spans that meet the
base rules are always taken; others only where they overlap no taken span.

The trees are fitted on the labelled candidates of all documents. Tasks count equal ones; a level of a tree needs the histograms of these counts only. Up to ``_FEW`` distinct vectors the
driver takes the counts themselves, beyond that tasks make the histograms, a pass a level. Sums are of integers, so the
model does not depend on how the table is partitioned. The base format is no label: base spans are rewritten where they stand into the wider forms
(``variants``) as positives and into look-alikes as negatives; further negatives are the text's own candidates that meet
a base span of another kind, fail their kind's test, or are one bare run of digits. Other candidates are of unknown kind
and left out. A hash of the source holds a third back; on these each kind's threshold is the smallest score from which
precision is ``PRECISION`` or more (a kind without enough of them takes base spans only). All of this covers every whole
text.

Null text counts as empty. Repeated rows are handled one by one; ties between scores go to the earlier, then longer
span. An empty table gives no rows. Extra columns are kept by ``redact`` and ignored by ``find_pii``. Every generator
runs in linear time, so a very long text costs in proportion.
"""

from __future__ import annotations

import hashlib
import re
import struct as packed
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import map_batches, struct, table, texts_of, written

KINDS = ("email", "ip", "card", "phone")
PRECISION, LEAST_HELD = 0.95, 20
TREES, DEPTH, RATE, BINS, AT_ONCE = 30, 3, 0.3, 16, 10_000
CONTEXT = 40

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")

_marker = re.compile(r"@|\s?[\[(]at[\])]\s?|\sat\s", re.I)
_wide_local = re.compile(r"[\w.+%-]{1,64}\Z")
_wide_domain = re.compile(r"[\w-]{1,63}(?:(?:\s?[\[(]dot[\])]\s?|\sdot\s|\.)[\w-]{1,63}){1,6}", re.I)
_wide = {
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?[.\[(]{1,2}[\])]?\x20?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,22}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])"),
}
_context = {
    "email": re.compile(r"mail|contact|write to|reach", re.I),
    "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|credit|account", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 4 and int(s or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of the base rules, by kind; matches that fail a kind's test are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    if _digit.search(text):
        out["ip"] = [m.span() for m in _ip.finditer(text) if all(map(_octet, m[0].split(".")))]
        out["card"] = [m.span() for m in _card.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out["phone"] = [m.span() for m in _phone.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of everything that might be personal data; spans may overlap."""
    found = []
    if "@" in text or " at " in text or "at]" in text or "at)" in text:
        for m in _marker.finditer(text):
            before, after = _wide_local.search(text, max(0, m.start() - 64), m.start()), _wide_domain.match(text, m.end())
            if before and after:
                found.append((0, before.start(), after.end()))
    if _digit.search(text):
        found += [(KINDS.index(k), *m.span()) for k, p in _wide.items() for m in p.finditer(text)]
    return found


def _check_digit(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _grouped(digits: str, sizes: tuple[int, ...], by: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return by.join(x for x in [*out, digits[at:]] if x)


def variants(kind: int, s: str) -> list[tuple[str, bool]]:
    """A base span in wider forms (true), and look-alikes (false)."""
    digits = _digits(s)
    if kind == 0:
        out, named = [], tuple(s.split("@", 1))
        plain = (re.sub("[0-9]", "", named[0]).strip("._%+-") or named[0], ".".join(re.sub("[0-9]", "", x) or x for x in named[1].split(".")))
        for local, domain in dict.fromkeys((named, plain)):  # an address needs no digits
            out += [(local + at + domain.replace(".", dot), True) for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."))]
            out += [(f"{local.split('.')[0]} at {domain.split('.')[0]}.{x}", False) for x in ("html", "5", "Then")]
        return out
    if kind == 1:
        parts = s.split(".")
        wrong = [*parts[:2], str(300 + int(parts[2][-3:]) % 600), parts[3]]
        return [(by.join(x), good) for x, good in ((parts, True), (wrong, False)) for by in ("[.]", "(.)", " . ")] + [(".".join(wrong), False)]
    if kind == 2:
        out = []
        for d, sizes in ((digits, (4, 4, 4, 4)), (_check_digit(digits[:14]), (4, 6, 5))):
            wrong = d[:-1] + str((int(d[-1]) + 1 + int(d[0]) % 9) % 10)
            forms = [*(("." , "_", "/", " - ") if len(d) > 15 else ("", " ", "-", "."))]
            out += [(_grouped(x, sizes, by), x is d) for x in (d, wrong) for by in forms]
            out += [(wrong, False), (_grouped(wrong, sizes, " "), False)]
        return out
    d, year = digits[-10:], f"20{digits[-2:]}"
    month, day = 1 + int(digits[-4:-2]) % 12, 1 + int(digits[-3:]) % 28
    out = [(x, True) for x in (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"1-{d[:3]}-{d[3:6]}-{d[6:]}") if len(d) == 10] + [(s[1:], True)] * (not s[1:].isdigit())
    return out + [(x, False) for x in (f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{year}/{month:02}/{day:02}", digits[:9], f"{digits[:4]}-{digits[-4:]}", f"{digits[:6]}.{digits[-2:]}")]


def examples(text: str) -> list[tuple[str, list[float], bool]]:
    """(source, features, label) of a text's labelled candidates; what meets a wider form as another kind is a negative."""
    out, base = [], base_spans(text)
    for k, kind in enumerate(KINDS):
        for a, b in base[kind]:
            right = text[b : b + 2 * CONTEXT]
            for left in (text[max(0, a - 2 * CONTEXT) : a], " "):  # with and without what announces it
                for form, good in variants(k, text[a:b]):
                    there, end = left + form + right, len(left) + len(form)
                    for c in candidates(there):
                        if c == (k, len(left), end) or (good and c[0] != k and c[1] < end and len(left) < c[2]):
                            out.append((f"{k}:{a}:{text[a:b]}", features(there, *c), good and c[0] == k))
    taken = sorted((a, b, k) for k, kind in enumerate(KINDS) for a, b in base[kind])
    for k, a, b in candidates(text):
        s, meets = text[a:b], {j for x, y, j in taken if x < b and a < y}
        d = _digits(s)
        fails = (k == 1 and not all(map(_octet, re.findall("[0-9]+", s)))) or (k == 2 and not luhn(d)) or (k == 3 and s.isdigit())
        if k not in meets and (meets or fails):
            out.append((f"{k}:{a}:{s}", features(text, k, a, b), False))
    return out


FEATURES = 16


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s, near = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = _digits(s)
    groups = [len(g) for g in re.split("[^0-9]+", s) if g]
    before, after = text[start - 1 : start], text[end : end + 1]
    return [
        float(kind), float(len(s)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(luhn(digits)) if digits else 0.0, float(len(groups) == 4 and max(groups) < 4 and all(map(_octet, re.findall("[0-9]+", s)))), float(s[:1] == "+"), float("@" in s),
        float(sum(c in " -" for c in s)), float(sum(c in ".()/[]_" for c in s)), float(len(set(digits))), float(before.isalnum()) + 2 * float(after.isalnum()),
        float(bool(_context[KINDS[kind]].search(near))), float(len(s) - s.rfind(".")) if "." in s else 0.0,
    ]


_UNIT = float(1 << 30)  # gradients are summed as whole numbers of 2^-30


class Trees:
    """Gradient-boosted trees of fixed depth for a logistic loss, on binned features."""

    def __init__(self, cuts: list[np.ndarray], bias: float):
        self.cuts, self.bias, self.trees = cuts, bias, []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1)

    def histograms(self, b: np.ndarray, y: np.ndarray, n: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """Gradients and their weights of ``n`` times each row by (sum, node of the level, feature, bin); ``feature`` and ``cut`` are the growing tree's."""
        p = self.of_binned(b)
        first = 2**level - 1
        node = self._node(feature, cut, b, level) - first
        out = np.empty((2, 2**level, b.shape[1], BINS + 1), np.int64)
        for i, w in enumerate((y - p, np.maximum(p * (1 - p), 1e-9))):
            w = np.rint(w * _UNIT).astype(np.int64) * n
            for j in range(b.shape[1]):
                sums = np.zeros(2**level * (BINS + 1), np.int64)
                np.add.at(sums, node * (BINS + 1) + b[:, j], w)
                out[i, :, j] = sums.reshape(2**level, BINS + 1)
        return out

    def grow(self, histograms) -> None:
        """One more tree: feature and bin of every inner node, value of every leaf, in heap order. ``histograms(feature, cut, level)`` sums them over all rows."""
        feature, cut, leaves = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64), []
        for level in range(DEPTH):
            g, h = np.cumsum(histograms(feature, cut, level) / _UNIT, axis=3)
            leaves = []
            for k in range(2**level):
                i, best = 2**level - 1 + k, 1e-6
                for j in range(g.shape[1]):
                    gs, hs = g[k, j], h[k, j]
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    if gain.max() > best + 1e-9:
                        best, feature[i], cut[i] = gain.max(), j, int(gain.argmax())
                gs, hs = g[k, feature[i]], h[k, feature[i]]
                leaves += [gs[cut[i]] / (hs[cut[i]] + 1), (gs[-1] - gs[cut[i]]) / (hs[-1] - hs[cut[i]] + 1)]
        self.trees.append((feature, cut, RATE * np.array(leaves)))

    @staticmethod
    def _node(feature: np.ndarray, cut: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return node

    def of_binned(self, b: np.ndarray) -> np.ndarray:
        score = np.full(len(b), self.bias)
        for feature, cut, value in self.trees:
            score += value[self._node(feature, cut, b, DEPTH) - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-score))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.of_binned(self.binned(x))


class Model:
    """Trees and thresholds; without trees it adds nothing to the base spans."""

    def __init__(self, trees: Trees | None, thresholds: dict[int, float] | None = None):
        self.trees, self.thresholds = trees or None, [(thresholds or {}).get(k, 2.0) for k in range(len(KINDS))]

    def spans(self, text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
        """Base spans, and all spans, by kind and start."""
        base = base_spans(text)
        every = {k: list(v) for k, v in base.items()}
        if self.trees is None:
            return base, every
        cover = bytearray(len(text))  # characters inside taken spans
        for a, b in (x for v in base.values() for x in v):
            cover[a:b] = b"\1" * (b - a)
        new = [c for c in candidates(text) if cover.find(1, c[1], c[2]) < 0]
        score: list[float] = []
        for i in range(0, len(new), AT_ONCE):
            score += self.trees.predict(np.array([features(text, *c) for c in new[i : i + AT_ONCE]])).tolist()
        for s, (k, a, b) in sorted(zip(score, new), key=lambda r: (-r[0], r[1][1], -r[1][2], r[1][0])):
            if s >= self.thresholds[k] and cover.find(1, a, b) < 0:
                every[KINDS[k]].append((a, b))
                cover[a:b] = b"\1" * (b - a)
        return base, {k: sorted(v) for k, v in every.items()}


_LABELLED = struct(x="binary", label="boolean", held="boolean", n="long")
_BINNED = struct(b="binary", kind="int", label="boolean", held="boolean", n="long")
#: Distinct candidates that a task sums up, and distinct binned ones from which on the driver sees histograms only.
_AT_ONCE, _FEW = 100_000, 50_000


def labelled(docs: DataFrame) -> DataFrame:
    """(x, label, held, n): the labelled candidates of all documents, equal ones counted; features as 16-bit numbers, which
    the generators' lengths keep small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def counted() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.bool_(), pa.bool_(), pa.int64()))], names=_LABELLED.names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                for source, x, good in examples(text):
                    counts[packed.pack(f"<{FEATURES}h", *map(int, x)), good, zlib.crc32(f"{doc}:{source}".encode()) % 3 == 0] += 1
                if len(counts) > _AT_ONCE:
                    yield counted()
        if counts:
            yield counted()

    return docs.select("doc_id", "text").mapInArrow(run, _LABELLED).groupBy("x", "label", "held").agg(F.sum("n").alias("n"))


def _matrix(batch: pa.RecordBatch, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype).reshape(batch.num_rows, FEATURES).astype(np.int64)


def _value_counts(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each feature its values (lengths, counts and flags: a few hundred at most), how often each occurs, and with a true label."""
    kinds = struct(feature="int", value="int", n="long", good="long")

    def fn(batch: pa.RecordBatch) -> dict:
        x, n = _matrix(batch, "x", "<i2"), batch.column("n").to_numpy()
        good, out = n * batch.column("label").to_numpy(zero_copy_only=False), {c: [] for c in kinds.names}
        for j in range(FEATURES):
            v, at = np.unique(x[:, j], return_inverse=True)
            sums = np.zeros((2, len(v)), np.int64)
            for s, w in zip(sums, (n, good)):
                np.add.at(s, at, w)
            for c, part in zip(kinds.names, (np.full(len(v), j), v, *sums)):
                out[c] += part.tolist()
        return out

    found = map_batches(rows, fn, kinds).groupBy("feature", "value").agg(F.sum("n"), F.sum("good")).orderBy("feature", "value").collect()
    return [tuple(np.array([r[i] for r in found if r[0] == j], np.int64) for i in (1, 2, 3)) for j in range(FEATURES)]


def quantiles(values: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``np.quantile`` of sorted values that occur ``counts`` times each."""
    end = np.cumsum(counts)
    at = (end[-1] - 1) * q
    low, high = (values[np.searchsorted(end, f(at).astype(np.int64), "right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (at - np.floor(at))


def _thresholds(scored: DataFrame) -> dict[int, float]:
    """(kind, score, n, good) -> each kind's smallest score from which on precision is ``PRECISION`` or more. Running sums over
    range partitions: the driver sees a number a partition and kind."""
    order = [F.col("kind"), F.col("score").desc()]
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(scored.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "scored")
    bases, run = [], {}
    for r in sorted(rows.groupBy("part", "kind").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect(), key=lambda r: r.part):
        before = run.get(r.kind, (0, 0))
        bases.append((r.part, r.kind, *before))
        run[r.kind] = (before[0] + r.n, before[1] + r.good)
    enough = [k for k, (n, good) in run.items() if n >= LEAST_HELD and good]
    if not enough:
        return {}
    base = F.broadcast(scored.sparkSession.createDataFrame(bases, "part int, kind int, n0 long, good0 long"))
    upto = W.partitionBy("part", "kind").orderBy(F.col("score").desc())
    sums = rows.join(base, ["part", "kind"]).select("kind", "score", (F.sum("n").over(upto) + F.col("n0")).alias("n"), (F.sum("good").over(upto) + F.col("good0")).alias("good"))
    precise = sums.filter(F.col("kind").isin(enough) & (F.col("good") / F.col("n") >= PRECISION))
    return {r.kind: r.score for r in precise.groupBy("kind").agg(F.min("score").alias("score")).collect()}


def fit(docs: DataFrame) -> Model:
    """A model from all documents; the same for the same table, however it is partitioned."""
    rows = written(labelled(docs), "labelled")
    counts = _value_counts(rows.filter("not held"))
    n, good = int(counts[0][1].sum()), int(counts[0][2].sum())
    if not 0 < good < n:
        return Model(None)
    cuts = [np.unique(quantiles(v, c, np.linspace(0, 1, BINS + 1)[1:-1])) for v, c, _ in counts]
    trees = Trees(cuts, float(np.log((good / n + 1e-6) / (1 - good / n + 1e-6))))

    def cut(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch, "x", "<i2")
        bins = trees.binned(x).astype(np.uint8)
        return {"b": [r.tobytes() for r in bins], "kind": x[:, 0]} | {c: batch.column(c) for c in ("label", "held", "n")}

    binned = map_batches(rows, cut, _BINNED).groupBy("b", "kind", "label", "held").agg(F.sum("n").alias("n"))
    binned = written(binned.coalesce(docs.sparkSession.sparkContext.defaultParallelism), "binned")
    train, few = binned.filter("not held").select("b", "label", "n"), None
    if train.count() <= _FEW:  # counts of distinct short vectors; there are a few thousand on most tables
        b, y, times = zip(*train.collect())
        few = np.frombuffer(b"".join(b), "u1").reshape(-1, FEATURES).astype(np.int64), np.array(y, float), np.array(times, np.int64)

    def histograms(feature: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        if few is not None:
            return trees.histograms(*few, feature, at, level)

        def fn(batch: pa.RecordBatch) -> dict:
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            return {"sums": [trees.histograms(_matrix(batch, "b", "u1"), y, batch.column("n").to_numpy(), feature, at, level).ravel()]}

        parts = map_batches(train, fn, struct(sums="array<long>")).toLocalIterator()  # one short array a batch
        return sum(np.array(r.sums, np.int64) for r in parts).reshape(2, 2**level, FEATURES, BINS + 1)

    for _ in range(TREES):
        trees.grow(histograms)

    def scores(batch: pa.RecordBatch) -> dict:
        n = batch.column("n").to_numpy()
        return {"kind": batch.column("kind"), "score": trees.of_binned(_matrix(batch, "b", "u1")), "n": n, "good": n * batch.column("label").to_numpy(zero_copy_only=False)}

    scored = map_batches(binned.filter("held"), scores, struct(kind="int", score="double", n="long", good="long"))
    return Model(trees, _thresholds(scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))))


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


FOUND = struct(doc_id="long", n_email="long", n_ip="long", n_card="long", n_phone="long", base_sha256="string", spans="string")


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Counts and digest of the base spans and all spans, one row per row of ``docs``; offsets count code points."""
    shipped = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def fn(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in texts_of(batch):
            base, every = shipped.value.spans(text)
            rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | dict(zip(FOUND.names[1:], map(list, zip(*rows))))

    return map_batches(docs.select("doc_id", "text"), fn, FOUND)


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Every span replaced by its kind; of overlapping spans the earliest, then longest, names the whole stretch."""
    out, end = [], 0
    for a, b, k in sorted(((a, b, k) for k, v in spans.items() for a, b in v), key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if a >= end:
            out += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with all spans redacted; same rows and columns (``n_chars`` follows the new text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    names = docs.columns

    def fn(batch: pa.RecordBatch) -> dict:
        texts = []
        for raw in batch.column("text"):
            text = raw.as_py()
            texts.append(text and redacted(text, shipped.value.spans(text)[1]))
        out = dict(zip(names, batch.columns)) | {"text": texts}
        return out | ({"n_chars": [None if t is None else len(t) for t in texts]} if "n_chars" in names else {})

    return map_batches(docs, fn, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
