"""Secrets in texts: fixed rules, and a character convolutional network over every other candidate.

The rules give the base spans. A candidate is a maximal run of ``LEAST`` or more characters that tokens and
keys are made of. The network reads the candidate with what stands before and after it: character
embeddings, one convolution, the strongest and the mean answer of each filter over the candidate and the
strongest over the text before it, a hidden layer, one score. A candidate longer than ``INSIDE`` is read in
overlapping windows, of which the highest score counts. The network is trained on labelled findings: those
that the caller gives, else candidates that a rule confirms against those that none does. So that it learns
what secrets look like and not only the words of the rules, each confirmed finding also appears in another
finding's surroundings, and with its characters drawn anew in the formats of ``FORMATS``; some of the
others also stand behind a rule's keyword. A quarter of the documents is kept for calibration: Platt
scaling of the scores, and for each shape of candidate the highest threshold that still finds ``RECALL`` of
its secrets. The network adds spans that no base span overlaps; base spans stay.

Model and thresholds come from the findings of all documents, not from a sample; findings that are equal
with their surroundings count once. They are dealt to groups of about ``GROUP`` by a hash, and groups are
trained on tasks, each from the same weights; the driver gets only the mean of the weights (local SGD). The
first round has one group, the next ones two, four and so on until each group was used once; then all
groups go together until there were ``ROUNDS``. Scores of the calibration part come to
the driver as counts by shape, class and step of 1/``STEPS`` of the log odds. Sums are of whole numbers and
the groups are sorted, so partitions don't change the model. Null texts are empty. Rows with null or
repeated ids are scanned like others. Where there is no finding of one class in one of the parts (an empty
table, too), nothing is added to the base. Columns besides the two that are named are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import byte_slices, forget, small_batches, written

#: Kinds in the order of the result; ``learned`` is the network's.
KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
_ACCESS, _HEX = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")

#: Characters of candidates and their least number; characters read before, in one window of, and after a candidate.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
LEAST, BEFORE, INSIDE, AFTER = 12, 16, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Sizes of the network.
EMBED, REACH, FILTERS, HIDDEN = 8, 5, 24, 16
#: Classes of characters: ASCII by code, then other letters, other characters, and none.
LETTER, OTHER, NONE, CLASSES = 128, 129, 130, 131
#: Share of the secrets of a shape that the threshold must find, and secrets that a shape needs for a threshold of its own.
RECALL, OWN = 0.98, 30
#: Findings and characters of candidates in a group; rounds of training at least; steps of a unit of log odds, and the bound of these.
GROUP, GROUP_CHARS, ROUNDS, STEPS, FAR = 8192, 16 << 20, 6, 64, 32
#: Longest secret that is drawn anew or put elsewhere; of longer ones a stretch is.
LONGEST = 64
#: Formats in which confirmed findings are drawn anew: characters, and an opening.
FORMATS = (
    ("0123456789abcdef", ""),
    ("0123456789ABCDEF", ""),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", ""),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ""),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "sk-"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA"),
)
_KEYWORDS = ('token = "', "password: ", "api_key=", "secret='")


class Model(NamedTuple):
    """Weights, Platt's line and the threshold of each shape (hex, mixed, digits, letters)."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    line: tuple[float, float]
    thresholds: dict[str, float]


_PARTS = Model._fields[:7]


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules' findings; ``low`` is the text with A-Z in lower case."""
    found = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def shape(s: str) -> str:
    if s.isdigit():
        return "digits"
    if s.isalpha():
        return "letters"
    return "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "mixed"


def _classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.minimum(code, OTHER).astype(np.uint8)
    far = np.flatnonzero(code >= 128)
    out[far] = [LETTER if text[i].isalpha() else OTHER for i in far]
    return out


def _windows(classes: np.ndarray, start: int, end: int) -> list[tuple[np.ndarray, int]]:
    """The windows of one candidate, each with how many of its characters are inside: surroundings, ``INSIDE`` places, surroundings."""
    steps = [start] if end - start <= INSIDE else [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]
    out = []
    for at in steps:
        n = min(INSIDE, end - at)
        w = np.full(WIDTH, NONE, np.uint8)
        lead = classes[max(0, at - BEFORE) : at]
        w[BEFORE - len(lead) : BEFORE] = lead
        w[BEFORE : BEFORE + n] = classes[at : at + n]
        trail = classes[at + n : at + n + AFTER]
        w[BEFORE + INSIDE : BEFORE + INSIDE + len(trail)] = trail
        out.append((w, n))
    return out


# --- the network ----------------------------------------------------------------------------------


def _masks(n: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Where filters are answered inside candidates of ``n`` characters, and before them."""
    t = np.arange(places)[None, :]
    inside = (t >= BEFORE) & (t <= BEFORE + np.maximum(n - REACH, 0)[:, None])
    return inside.astype(np.float32), np.broadcast_to(t < BEFORE, inside.shape).astype(np.float32)


def _forward(p: dict[str, np.ndarray], codes: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Answers of all layers; places after the longest candidate are left out, as nothing reads them."""
    size, places = len(codes), BEFORE + max(int(n.max()) - REACH, 0) + 1
    read = p["embed"][codes[:, : places + REACH - 1]].reshape(size, -1)
    # Row by row the characters that a filter reads at each place, side by side.
    seen = np.lib.stride_tricks.sliding_window_view(read, REACH * EMBED, axis=1)[:, ::EMBED].reshape(size * places, REACH * EMBED)
    answer = (seen @ p["filters"].reshape(REACH * EMBED, FILTERS) + p["bias"]).reshape(size, places, FILTERS)
    answer = np.maximum(answer, 0)
    inside, before = _masks(n, places)
    a = answer[:, BEFORE:] * inside[:, BEFORE:, None]
    best, lead = a.argmax(axis=1), answer[:, :BEFORE].argmax(axis=1)
    mean = a.sum(axis=1) / inside.sum(axis=1)[:, None]
    pooled = np.concatenate([np.take_along_axis(a, best[:, None], 1)[:, 0], mean, np.take_along_axis(answer, lead[:, None], 1)[:, 0]], axis=1)
    h = np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0)
    return {"seen": seen, "answer": answer, "inside": inside, "best": best + BEFORE, "lead": lead, "pooled": pooled, "h": h, "logit": h @ p["out"] + p["out_bias"][0]}


def _gradients(p: dict[str, np.ndarray], codes: np.ndarray, n: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    s = _forward(p, codes, n)
    size, places = s["answer"].shape[:2]
    d = (1 / (1 + np.exp(-s["logit"])) - label) / size
    g = {"out": s["h"].T @ d, "out_bias": np.array([d.sum()])}
    dh = np.outer(d, p["out"]) * (s["h"] > 0)
    g["hidden"], g["hidden_bias"] = s["pooled"].T @ dh, dh.sum(axis=0)
    dp = dh @ p["hidden"].T
    da = dp[:, None, FILTERS : 2 * FILTERS] * (s["inside"] / s["inside"].sum(axis=1, keepdims=True))[:, :, None]
    rows, cols = np.arange(size)[:, None], np.arange(FILTERS)[None, :]
    da[rows, s["best"], cols] += dp[:, :FILTERS]
    da[rows, s["lead"], cols] += dp[:, 2 * FILTERS :]
    da *= s["answer"] > 0
    flat = da.reshape(-1, FILTERS).astype(p["filters"].dtype, copy=False)
    g["bias"], g["filters"] = flat.sum(axis=0), (s["seen"].T @ flat).reshape(REACH, EMBED, FILTERS)
    dseen = (flat @ p["filters"].reshape(REACH * EMBED, FILTERS).T).reshape(size, places, REACH, EMBED)
    dread = np.zeros((size, places + REACH - 1, EMBED), dseen.dtype)
    for r in range(REACH):
        dread[:, r : r + places] += dseen[:, :, r]
    at = codes[:, : places + REACH - 1].astype(np.int64)[:, :, None] * EMBED + np.arange(EMBED)
    g["embed"] = np.bincount(at.ravel(), dread.ravel(), CLASSES * EMBED).reshape(CLASSES, EMBED)
    return g


def _untrained(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *size, fan: rng.normal(0, np.sqrt(2 / fan), size).astype(np.float32)
    return {
        "embed": draw(CLASSES, EMBED, fan=2), "filters": draw(REACH, EMBED, FILTERS, fan=REACH * EMBED), "bias": np.zeros(FILTERS, np.float32),
        "hidden": draw(3 * FILTERS, HIDDEN, fan=3 * FILTERS), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, fan=HIDDEN), "out_bias": np.zeros(1, np.float32),
    }


def fit_network(codes: np.ndarray, n: np.ndarray, label: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.004, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Adam on the log loss, from ``start`` if given; the seed is fixed, so equal findings give equal networks."""
    rng = np.random.default_rng(7)
    p = _untrained(rng) if start is None else dict(start)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for i in range(0, len(order), batch):
            rows, step = order[i : i + batch], step + 1
            for k, g in _gradients(p, codes[rows], n[rows], label[rows]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def _logits(p: dict[str, np.ndarray], codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of windows; those of like length are read together."""
    out, order = np.zeros(len(codes)), np.argsort(n, kind="stable")
    for i in range(0, len(codes), 256):
        rows = order[i : i + 256]
        out[rows] = _forward(p, codes[rows], n[rows])["logit"]
    return out


def _platt(logit: np.ndarray, label: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated log odds, towards smoothed labels; each score stands ``count`` times.

    Newton steps are halved until the loss falls: whole ones run away where the classes are far apart.
    """
    n1 = count[label == 1].sum()
    t = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (count.sum() - n1 + 2))
    x, prior = np.stack([logit, np.ones_like(logit)], axis=1), np.array([1.0, 0.0])
    loss = lambda w: float((count * (np.logaddexp(0, x @ w) - t * (x @ w))).sum() + 5e-7 * ((w - prior) ** 2).sum())
    line = prior
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ line, -35, 35)))
        step = np.linalg.solve((x * (count * q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (count * (q - t)) + 1e-6 * (line - prior))
        now = loss(line)
        while not loss(line - step) < now and np.abs(step).max() > 1e-12:
            step = step / 2
        if np.abs(step).max() <= 1e-12:
            break
        line = line - step
    return float(line[0]), float(line[1])


def _dressed(found: list[tuple[str, str, str, int]], rng: np.random.Generator) -> list[tuple[str, str, str, int]]:
    """The findings (before, candidate, after, label) with their variants, see above; both classes come out alike in number.

    Without a finding of one class the variants that need one are left out.
    """
    yes, no = [x for x in found if x[3]], [x for x in found if not x[3]]
    pick = lambda xs: xs[rng.integers(len(xs))]
    out = list(found)
    for _ in range(max(len(no), len(yes)) // 2 if yes and no else 0):
        around, secret = pick(no), pick(yes)[1]
        if len(secret) > LONGEST:
            at = rng.integers(len(secret) - LONGEST + 1)
            secret = secret[at : at + LONGEST]
        out.append((around[0], secret, around[2], 1))
    for _ in range(max(len(no), len(yes))):
        around = pick(no if no and (not yes or rng.random() < 0.7) else yes)
        letters, opening = FORMATS[rng.integers(len(FORMATS))]
        out.append((around[0], opening + "".join(letters[i] for i in rng.integers(len(letters), size=rng.integers(20, LONGEST + 1))), around[2], 1))
    for x in no[::2]:
        out.append((x[0] + _KEYWORDS[rng.integers(len(_KEYWORDS))], x[1], x[2], 0))
    return out


def _coded(found: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, sizes, owner = [], [], []
    for i, (lead, s, trail, _) in enumerate(found):
        for w, n in _windows(_classes(lead + s + trail), len(lead), len(lead) + len(s)):
            codes.append(w)
            sizes.append(n)
            owner.append(i)
    return np.array(codes, np.uint8).reshape(-1, WIDTH), np.array(sizes), np.array(owner)


def _counted(p: dict[str, np.ndarray], found: list[tuple[str, str, str, int]]) -> Counter[tuple[str, int, int]]:
    """How many findings have each (shape, label, step of the log odds)."""
    codes, n, owner = _coded(found)
    best = np.full(len(found), -np.inf)
    np.maximum.at(best, owner, _logits(p, codes, n))
    steps = np.clip(np.floor(best * STEPS), -FAR * STEPS, FAR * STEPS).astype(int).tolist()
    return Counter((shape(x[1]), x[3], step) for x, step in zip(found, steps, strict=True))


def _calibrated(p: dict[str, np.ndarray], counts: dict[tuple[str, int, int], int]) -> Model | None:
    """The model with its line and thresholds; a threshold is the lower end of its step, so rounding loses no secret. ``None`` if scores don't rise with the label."""
    label, step, count = (np.array(x, float) for x in zip(*((k[1], k[2], n) for k, n in sorted(counts.items())), strict=True))
    line = _platt((step + 0.5) / STEPS, label, count)
    if line[0] <= 0:
        return None

    def lowest(shapes: set[str]) -> tuple[float, int]:
        """Threshold, and how many secrets it rests on."""
        have = Counter()
        for (kind, is_secret, at), n in counts.items():
            if is_secret and kind in shapes:
                have[at] += n
        total, passed = sum(have.values()), 0
        for at in sorted(have):
            passed += have[at]
            if passed > int((1 - RECALL) * total):
                break
        return (float(1 / (1 + np.exp(-(line[0] * at / STEPS + line[1])))) if total else 1.0), total

    kinds = ("hex", "mixed", "digits", "letters")
    pooled, own = lowest(set(kinds))[0], {k: lowest({k}) for k in kinds}
    return Model(*(p[k] for k in _PARTS), line, {k: s if n >= OWN else pooled for k, (s, n) in own.items()})


def train(training: list[tuple[str, str, str, int]], calibration: list[tuple[str, str, str, int]]) -> Model | None:
    """A calibrated model from findings (before, candidate, after, label); ``None`` without findings of both classes in both lists."""
    if any(len({x[3] for x in part}) < 2 for part in (training, calibration)):
        return None
    fit, held = _dressed(training, np.random.default_rng(11)), _dressed(calibration, np.random.default_rng(12))
    codes, n, owner = _coded(fit)
    p = fit_network(codes, n, np.array([x[3] for x in fit], np.float32)[owner])
    return _calibrated(p, _counted(p, held))


def model_scores(model: Model, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Calibrated scores of windows."""
    p = dict(zip(_PARTS, model[:7], strict=True))
    return 1 / (1 + np.exp(-(model.line[0] * _logits(p, codes, n) + model.line[1])))


# --- on Spark -------------------------------------------------------------------------------------


def _texts(b: pa.RecordBatch, place: int) -> Iterator[tuple[int, int, list[str], list[str]]]:
    texts = pc.fill_null(b.column(place), "")
    for start, stop in byte_slices(texts):
        part = texts.slice(start, stop - start)
        yield start, stop, part.to_pylist(), pc.ascii_lower(part).to_pylist()


_FINDING = "held boolean, label int, lead string, found string, trail string"


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = b.column(0).to_pylist()
        for start, _, texts, lows in _texts(b, 1):
            rows = []
            for i, (text, low) in enumerate(zip(texts, lows, strict=True)):
                base = base_spans(text, low)
                for m in _CANDIDATE.finditer(text):
                    s, e = m.span()
                    # A rule's match begins at the keyword, so a candidate is confirmed if it ends inside one.
                    hit = any(x < e and s < y for _, x, y in base)
                    rows.append((held[start + i], int(hit), text[max(0, s - BEFORE) : s], m[0], text[e : e + AFTER]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["held", "label", "lead", "found", "trail"])


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``held, label, lead, found, trail``: the candidates of all documents, labelled by the rules."""
    small_batches(docs.sparkSession)
    filled = docs.filter(F.coalesce(F.col(text), F.lit("")) != "")
    return filled.select((F.pmod(F.xxhash64(F.lit("held"), F.col(key)), F.lit(4)) == 0).alias("held"), text).mapInArrow(_labelled, _FINDING)


def _listed(t: pa.Table) -> list[tuple[str, str, str, int]]:
    return sorted(zip(*(t.column(c).to_pylist() for c in ("lead", "found", "trail", "label")), strict=True))


def _groups(chars: int, n: int) -> int:
    return max(1, -(-n // GROUP), -(-chars // GROUP_CHARS))


def _rounds(groups: int) -> list[tuple[int, int]]:
    """The groups (from, to) that are trained together: one, two, four and so on until each was used, then all."""
    out, at = [], 0
    while at < groups:
        out.append((at, min(groups, 2 * at + 1)))
        at = out[-1][1]
    return out + [(0, groups)] * (ROUNDS - len(out))


def _improved(p: dict[str, np.ndarray], turn: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        fit = _dressed(_listed(t), np.random.default_rng([11, turn, key[0].as_py()]))
        codes, n, owner = _coded(fit)
        q = fit_network(codes, n, np.array([x[3] for x in fit], np.float32)[owner], epochs=1, rate=0.004 * max(0.25, 0.8**turn), start=p)
        flat = np.concatenate([q[k].ravel() for k in _PARTS]).astype(float)
        return pa.table({"n": pa.array([t.num_rows], pa.int64()), "weights": pa.array([np.rint(flat * (1 << 24)).astype(np.int64)], pa.list_(pa.int64()))})

    return run


def _measured(p: dict[str, np.ndarray]):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        counts = _counted(p, _dressed(_listed(t), np.random.default_rng([12, key[0].as_py()])))
        shapes, labels, steps = zip(*counts, strict=True)
        return pa.table({"shape": pa.array(shapes, pa.string()), "label": pa.array(labels, pa.int32()), "step": pa.array(steps, pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def fit_model(found: DataFrame) -> Model | None:
    """A model from all findings (``held, label, lead, found, trail``); groups of them are trained on tasks, means and counts come to the driver."""
    state = written(found.select("held", "label", "lead", "found", "trail").distinct(), "findings")
    have = {(r["held"], r["label"]): (r["chars"], r["n"]) for r in state.groupBy("held", "label").agg(F.sum(F.length("found")).alias("chars"), F.count("*").alias("n")).collect()}
    if any((held, label) not in have for held in (False, True) for label in (0, 1)):
        forget(state)
        return None
    groups = {held: _groups(*(a + b for a, b in zip(have[held, 0], have[held, 1], strict=True))) for held in (False, True)}
    dealt = lambda held: state.filter(F.col("held") == held).withColumn("part", F.pmod(F.xxhash64("label", "lead", "found", "trail"), F.lit(groups[held])).cast("int"))
    # Groups are few rows and much work; given numbers of partitions aren't merged, and with four for each group few share one.
    spread = lambda df, n: df.repartition(4 * n, "part")
    p = _untrained(np.random.default_rng(7))
    for turn, (low, high) in enumerate(_rounds(groups[False])):
        part = dealt(False).filter(F.col("part").between(low, high - 1))
        each = spread(part, high - low).groupBy("part").applyInArrow(_improved(p, turn), "n long, weights array<long>")
        # Whole numbers add up to the same in any order.
        sums = each.select("n", F.posexplode("weights").alias("at", "weight")).groupBy("at").agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n") / (1 << 24)).alias("mean"))
        flat = np.array([r["mean"] for r in sorted(sums.collect(), key=lambda r: r["at"])])
        if len(flat):
            ends = np.cumsum([p[k].size for k in _PARTS])
            p = {k: flat[end - p[k].size : end].reshape(p[k].shape).astype(np.float32) for k, end in zip(_PARTS, ends, strict=True)}
    counts = spread(dealt(True), groups[True]).groupBy("part").applyInArrow(_measured(p), "shape string, label int, step int, n long")
    model = _calibrated(p, {(r["shape"], r["label"], r["step"]): r["n"] for r in counts.groupBy("shape", "label", "step").agg(F.sum("n").alias("n")).collect()})
    forget(state)
    return model


def _scan(model: Model | None):
    kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, texts, lows in _texts(b, 1):
                spans: list[list[tuple[str, int, int, float | None]]] = []
                codes, sizes, owner, asked = [], [], [], []
                for i, (text, low) in enumerate(zip(texts, lows, strict=True)):
                    base = base_spans(text, low)
                    spans.append([(k, s, e, None) for k, s, e in base])
                    if model is None:
                        continue
                    classes = None
                    for m in _CANDIDATE.finditer(text):
                        s, e = m.span()
                        if any(x < e and s < y for _, x, y in base):
                            continue
                        classes = _classes(text) if classes is None else classes
                        for w, n in _windows(classes, s, e):
                            codes.append(w)
                            sizes.append(n)
                            owner.append(len(asked))
                        asked.append((i, s, e))
                if asked:
                    best = np.zeros(len(asked))
                    np.maximum.at(best, np.array(owner), model_scores(model, np.array(codes, np.uint8), np.array(sizes)))
                    for (i, s, e), score in zip(asked, best.tolist(), strict=True):
                        if score >= model.thresholds[shape(texts[i][s:e])]:
                            spans[i].append(("learned", s, e, score))
                rows = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in sorted(r, key=lambda x: (x[1], KINDS.index(x[0])))] for r in spans]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), pa.array(rows, pa.list_(kinds))], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, model: Model | None = None, found: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans(kind, start, end, score)`` of each document, by start and kind; places are code points, the end exclusive.

    Without a model one is fitted on ``found`` (see ``findings``), without those on what the rules confirm.
    """
    if model is None:
        model = fit_model(findings(docs, key=key, text=text) if found is None else found)
    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(_scan(model), "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
